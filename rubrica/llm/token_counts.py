"""Exact token counts by a histogram of encoded lengths.

Every whole document is encoded and counted under its length. Suffix sums over the distinct lengths then answer, for
every context limit, how many documents exceed it, how many tokens they hold, how many tokens remain when documents are
truncated at it, and which quantile it is. Between two neighbouring lengths the answers follow from the lower one:
`truncated(limit) = tokens_up_to + limit * docs_longer`.

Lengths are counted in each task before they are shuffled, so the work after that is one small row per distinct length.
Sums run inside blocks of lengths and are offset by the sums of later blocks, so no task gets all lengths.

Defined results: a null or empty text has length 0; bytes that are no UTF-8 count as U+FFFD; rows that repeat a doc_id
count each; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import utf8
from rubrica.llm.encoding import byte_encoder
from rubrica.session import cut_lineage

#: Lengths in a block of the suffix sums.
BLOCK = 4096


def _lengths(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = byte_encoder(path).encode_ordinary, Counter()
        for batch in batches:
            counts.update(len(encode(t.as_py().decode(errors="replace"))) for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return run


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length. path names the tokenizer's file as executors see it."""
    counted = docs.select(utf8().alias("text")).mapInArrow(_lengths(path), "n_tokens long, n_docs long")
    return cut_lineage(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))  # read twice, encoded once


def context_table(lengths: DataFrame) -> DataFrame:
    """For each distinct length as a context limit: n_docs of it, docs_longer, tokens_longer, tokens_up_to,
    truncated_tokens, total_docs, total_tokens, and quantile, the share of documents that fit."""
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocked = lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = blocked.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = sums.select(
        "block",
        F.coalesce(F.sum("docs").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("tokens").over(later), zero).alias("later_tokens"),
        F.sum("docs").over(every).alias("total_docs"),
        F.sum("tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    longer = blocked.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), zero)).withColumn("tokens_in", F.coalesce(F.sum(tokens).over(inside), zero))
    out = longer.join(offsets, "block").withColumn("docs_longer", F.col("docs_in") + F.col("later_docs")).withColumn("tokens_longer", F.col("tokens_in") + F.col("later_tokens"))
    up_to = F.col("total_tokens") - F.col("tokens_longer")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        up_to.alias("tokens_up_to"),
        (up_to + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        (1 - F.col("docs_longer") / F.col("total_docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_fitting, docs_longer, truncated_tokens) for any limits, from the table alone."""
    wanted = table.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    held = F.col("n_tokens") <= F.col("context")
    docs = F.coalesce(F.sum(F.when(held, F.col("n_docs"))), F.lit(0))
    below = F.coalesce(F.sum(F.when(held, F.col("n_docs") * F.col("n_tokens"))), F.lit(0))
    longer = F.coalesce(F.sum(F.when(~held, F.col("n_docs"))), F.lit(0))
    exploded = table.select("n_tokens", "n_docs", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context"))
    summed = exploded.groupBy("context").agg(docs.alias("docs_fitting"), longer.alias("docs_longer"), (below + F.col("context") * longer).alias("truncated_tokens"))
    return wanted.distinct().join(summed, "context", "left").na.fill(0)
