"""What several operators of this subpackage share: reading, grouping sorted rows in a task, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.session import cut_lineage

#: A word: a maximal run of anything but ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def utf8(text: str = "text"):
    """The text as bytes, null as empty: what goes to Python workers, which then decode only where they must."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by integer keys, regrouped so that no group is cut; with the first row of each group."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        first = starts(t)
        if len(first) > 1:
            yield t.slice(0, first[-1]), first[:-1]
        rest = t.slice(first[-1])
    if rest is not None:
        yield rest, starts(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (u, v), two columns of one integer type: (id, root), root the smallest id.

    Large-star and small-star rounds: each joins every link with the smallest neighbour of its ends, so a node with
    very many links is split by the skew join, and no component is ever gathered. Each round is checkpointed.
    Nodes without links do not appear.
    """
    pairs = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = cut_lineage(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
