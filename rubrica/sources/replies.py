"""Reading model replies, which take the place of live calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPLY_SCHEMA = (
    "doc_id string, stage string, model_tier string, run_no int, round int, content string, latency double"
)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLY_SCHEMA).json(path)
