"""Writing results as JSON or Parquet; every task writes its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    results.write.mode(mode).format(fmt).save(path)


def repaired_only(results: DataFrame) -> DataFrame:
    """Only the repaired documents, without anything about how they came about."""
    return results.filter(F.col("new_doc").isNotNull()).select("new_doc")


def write_repaired(results: DataFrame, path: str, mode: str = "error") -> None:
    """One repaired document per line."""
    repaired_only(results).select(F.to_json("new_doc").alias("value")).write.mode(mode).text(path)


def write_report(rows: DataFrame, path: str, order: str, mode: str = "error") -> None:
    """Report rows as a pipe table, range-partitioned so that the files follow each other."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in rows.columns]), F.lit(" |"))
    rows.orderBy(order).select(line.alias("value")).write.mode(mode).text(path)
