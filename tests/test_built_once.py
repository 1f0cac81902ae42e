import pytest
from pyspark.sql import functions as F

from rubrica.catalog import queries
from rubrica.functions.expressions import kept, spread


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(40).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    texts = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("One  line .\nSecond, (("), F.col("id").cast("string")).alias("text"))
    texts.write.parquet(f"{folder}/documents.parquet")
    return folder


def _filters(plan):
    nodes = [plan.simpleString(100_000)] if plan.nodeName() == "Filter" else []
    children = plan.children()
    return nodes + [f for i in range(children.size()) for f in _filters(children.apply(i))]


@pytest.mark.parametrize("name", ["flatten_object", "census_counts", "accept_candidate", "guard_repaired_text", "hygiene_parens"])
def test_no_filter_builds_documents_or_findings_again(spark, tables, name):
    """What is built from a row is built once, and not in the tasks of the scan."""
    found = _filters(queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan())
    assert not [f[:200] for f in found if "named_struct" in f.lower() or "parsejson" in f.lower() or "regexp_replace" in f.lower() or "transform(" in f.lower()]


def test_spread_and_kept(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, xs array<string>")
    assert sorted(spread(rows, ["k"], F.col("xs"), "x", "i").collect(), key=str) == [(1, 0, "a"), (1, 1, None)]
    assert [tuple(r) for r in spread(rows, [], F.col("xs"), "x").collect()] == [("a",), (None,)]
    assert [r.k for r in kept(rows, F.size("xs") > 0).collect()] == [1]


def test_values_taken_out_in_one_step(spark):
    """Members by path, texts that count and brackets are as by single steps; the text of a tree needs no schema of it."""
    from rubrica.functions import variants as v

    texts = ['{"k": ["a", 1]}', '{"k": {"x": []}}', '{"k": "0"}', '{"k": 0}', '{"k": " [{ "}', '{"k": null}', '{"k": ""}', "[]", "7"]
    x = F.parse_json("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        F.size(v.listed(x, "k")).alias("n"),
        v.object_at(x, "k").alias("o"),
        v.truthy_at(x, "k").alias("one"),
        v.truthy_text(v.get(x, "k")).alias("two"),
        v._brackets(x).alias("b"),
        v.content_text(F.to_variant_object(F.struct(F.array(v.get(x, "k")).alias("content")))).alias("c"),
    )
    found = {r.t: (r.n, r.o, r.one, r.b, r.c) for r in rows.collect()}
    assert all(r.one == r.two for r in rows.collect())
    assert found == {
        '{"k": ["a", 1]}': (2, False, '["a",1]', 2, "a 1"),
        '{"k": {"x": []}}': (0, True, '{"x":[]}', 3, ""),
        '{"k": "0"}': (0, False, "0", 1, "0"),
        '{"k": 0}': (0, False, None, 1, "0"),
        '{"k": " [{ "}': (0, False, " [{ ", 3, "[{"),
        '{"k": null}': (0, False, None, 1, ""),
        '{"k": ""}': (0, False, None, 1, ""),
        "[]": (0, False, None, 1, ""),
        "7": (0, False, None, 0, ""),
    }
