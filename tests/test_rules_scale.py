"""Findings and texts of documents are made behind the shuffle of keys, with no copies of members that are not read."""

from pyspark.sql import functions as F

import pytest

from rubrica.catalog import queries
from rubrica.functions import variants as v


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(60).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    return folder


def _filters(plan):
    nodes = [plan.simpleString(100_000)] if plan.nodeName() == "Filter" else []
    children = plan.children()
    return nodes + [f for i in range(children.size()) for f in _filters(children.apply(i))]


def test_structural_rows_filter_after_findings(spark, tables):
    plan = queries()["structural_rows"](spark, tables)._jdf.queryExecution().optimizedPlan()
    assert not [f[:200] for f in _filters(plan) if "named_struct" in f.lower() or "parse" in f.lower() or "transform(" in f.lower()]


def test_keyed_members(spark):
    """As the walk over all nodes gives them, in reading order and at any depth."""
    texts = ['{"b": [{"k": 1, "a": {"m": [2, {"k": true}]}}], "k": {"k": null}}', '{"x": [[["k"]]]}', '[{"m": 1}, {"k": []}]', '"k"', "3", "null", "{}"]
    x = F.parse_json("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = lambda found: F.transform(found, lambda n: F.struct(n["key"].alias("key"), n["ord"].alias("ord"), F.to_json(n["value"]).alias("value")))
    both = rows.select("t", told(v.keyed(x, "k", "m")).alias("some"), told(F.filter(v.nodes(x), lambda n: n["key"].isin("k", "m"))).alias("every")).collect()
    assert all(r.some == r.every for r in both)
    assert [len(r.some) for r in both] == [5, 0, 2, 0, 0, 0, 0]


def test_keys_and_text_of_plain_values(spark):
    texts = {'{"b": {"c": 1}, "a": null}': (["a", "b"], False, ""), "[1, {}]": (None, True, "1"), '" x "': (None, False, "x"), "true": (None, False, "true"), "1.50": (None, False, "1.5"), "null": (None, False, ""), '""': (None, False, "")}
    x = F.parse_json("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", v.keys(x).alias("k"), v.is_array(x).alias("a"), v.content_text(x).alias("c"))
    assert {r.t: (r.k, r.a, r.c) for r in rows.collect()} == texts
    assert [r.c for r in spark.range(1).select(v.content_text(F.lit(None).cast("variant")).alias("c")).collect()] == [""]
