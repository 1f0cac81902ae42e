"""Reading JSON payloads and unwrapping them into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rubrica.functions import variants as v
from rubrica.operators.flatten import document_id

BOM = "\ufeff"


def read_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Payloads as (batch_id, payload VARIANT), NULL where the text is no JSON.

    A payload is one line, so that large files are split over tasks, or without `lines` a whole file. A line's id is its file
    and its number in it, from 0: the number of lines in the file's earlier splits and its place in its own, so it is the same
    however files are split or a read is repeated. For this the lines are counted once per split; the counts, one row a split,
    are what is broadcast (100 TB in splits of 128 MB make some 80 MB).
    """
    file = F.col("_metadata.file_path").alias("file")
    if not lines:
        raw = spark.read.text(path, wholetext=True).select("value", file)
        return raw.select(F.col("file").alias("batch_id"), _payload("value").alias("payload"))
    rows = numbered(spark, path, "\n").select(F.concat_ws("#", "file", F.col("number").cast("string")).alias("batch_id"), "value")
    return rows.select("batch_id", _payload("value").alias("payload"))


def numbered(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Texts between separators (file, number from 0, value, size of the file) in splits, numbered as if read in one."""
    raw = spark.read.text(path, lineSep=separator).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    splits = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(placed), ["file", "start"]).select(
        "file", (F.col("id") + F.col("shift")).alias("number"), "value", "size"
    )


def _payload(body: str) -> Column:
    return F.try_parse_json(F.regexp_replace(body, f"^{BOM}", ""))


def parse_payloads(texts: DataFrame, batch_id: str, body: str) -> DataFrame:
    """Payloads of a text column."""
    return texts.select(
        F.col(batch_id).alias("batch_id"),
        _payload(body).alias("payload"),
    )


def unwrap_payload(payloads: DataFrame) -> DataFrame:
    """Documents of each payload (batch_id, pos, id, doc, is_object): list, wrapper or a single object.

    Elements that are no objects are kept and flagged.
    """
    payload = F.col("payload")
    listed = F.coalesce(
        v.as_array(payload),
        F.try_variant_get(payload, "$.generatedQuestions", "array<variant>"),
        F.when(v.is_object(payload), F.array(payload)),
    )
    exploded = payloads.select("batch_id", F.posexplode(listed).alias("pos", "doc"))
    return exploded.select(
        "batch_id", "pos", document_id(F.col("doc"), F.col("pos")).alias("id"), "doc", v.is_object(F.col("doc")).alias("is_object")
    )


def limit_per_batch(documents: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first n documents of each batch. Positions count from 0, so this is a filter and no window."""
    if n <= 0:
        raise ValueError("n must be positive")
    return documents.filter(F.col(pos) < n)


def check_batch(batches: DataFrame, documents: DataFrame) -> DataFrame:
    """One bad issue for each batch without any document: a scalar payload, no JSON, or an empty list."""
    filled = documents.select("batch_id").distinct()
    return batches.join(filled, "batch_id", "left_anti").select(
        "batch_id",
        F.lit("bad").alias("severity"),
        F.lit("render_schema").alias("category"),
        F.lit("generatedQuestions").alias("location"),
        F.lit("There is no document to check.").alias("reason"),
        F.lit("Send an object, a list of objects or a wrapper with a list.").alias("suggestion"),
    )
