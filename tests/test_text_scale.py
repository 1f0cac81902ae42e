"""Texts are dealt out and looked at once, whatever the row groups of their table."""

import pytest
from pyspark.sql import functions as F

from rubrica import dims
from rubrica.catalog import queries
from rubrica.catalog import relations as rel
from rubrica.functions import text as t


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    row = F.struct(F.when(F.col("id") > 3, F.col("id") % 97).alias("doc_id"), F.concat(F.lit("Line ,one\nSecond.line "), F.col("id") % 150).alias("text"))
    spark.range(300).select(row.alias("r")).select("r.*").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_texts_of_one_row_group_are_dealt_out(spark, tables):
    given = spark.read.parquet(f"{tables}/documents.parquet")
    dealt = rel.texts(spark, tables)
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    assert dealt.exceptAll(given.select("doc_id", "text")).isEmpty() and dealt.count() == given.count() == 300


def test_candidate_nodes_look_at_texts_once(spark, tables):
    plan = queries()["candidate_nodes"](spark, tables)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and "rlike" not in plan


def test_accentless_text_with_few_ranges(spark):
    letters = t.char_class(dims.ACCENTED)
    assert len(letters) < 50
    words = "one two three four five six"
    cases = {words: True, "one two three four five": False, words + " tạo": False, words + " Ỹ": False, words + " phương trình": True, "one two three four five x1y _six": False, words.upper(): True}
    found = spark.createDataFrame([(c,) for c in cases], "p string").select("p", t.accentless_text(F.col("p")).alias("hit")).collect()
    assert {r.p: r.hit for r in found} == cases
    every = spark.createDataFrame([(c,) for c in dims.ACCENTED + dims.ACCENTED.upper()], "c string")
    assert every.where(~F.lower("c").rlike(letters)).isEmpty()
    other = spark.createDataFrame([(chr(c),) for c in range(0x80, 0x2000)], "c string").select(F.lower("c").alias("c"))
    assert {r.c for r in other.where(F.col("c").rlike(letters)).distinct().collect()} == set(dims.ACCENTED)
