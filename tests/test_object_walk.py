"""The walk over a document's JSON: findings by one Python pass, with the texts and numbers as variants have them."""

import json

from pyspark.sql import functions as F

from rubrica.operators import object_walk, rules_object


def _nodes(plan):
    children = plan.children()
    return 1 + sum(_nodes(children.apply(i)) for i in range(children.size()))


def _size(expression):
    children = expression.children()
    return 1 + sum(_size(children.apply(i)) for i in range(children.size()))


def test_findings_are_no_large_expression(spark):
    """Rules as thousands of interpreted nodes took some 1.4 CPU ms a document and most of the driver's memory."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.parse_json(F.lit("{}")).alias("doc"))
    found = rules_object.object_findings(docs)._jdf.queryExecution().optimizedPlan()
    expressions = found.expressions()
    assert sum(_size(expressions.apply(i)) for i in range(expressions.size())) + _nodes(found) < 100


def test_texts_are_those_of_variants(spark):
    values = ['"a\\u0001\\u001f\\"\\\\/\\n"', "1.50", "-0.0", "0.0000001", "1e3", "100000000000000000000", "true", '{"b": [1, null, {}], "a": "x"}', "[]", '[" ", 2.0]', "null"]
    x = F.parse_json("t")
    rows = spark.createDataFrame([(t,) for t in values], "t string").select("t", F.to_json(x).alias("j"), x.cast("string").alias("s")).collect()
    for r in rows:
        value = object_walk.reader()(r.j)
        assert object_walk.rendered(value) == r.j
        assert object_walk.truthy(value) == (None if r.s in (None, "", "0", "0.0", "-0.0", "false", "[]", "{}") else r.s)
        assert object_walk.counts(value) == (object_walk.truthy(value) is not None)


def test_whole_numbers_and_depth(spark):
    """1.0 is no integer though its JSON is `1`; a document as deep as the parser reads is walked whole."""
    asked = lambda i, n: {"id": f"x{i}", "type": "coordinate_input", "config": {"dimensions": n}}
    item = lambda i, n: {"interactions": [asked(i, n)], "answerSpecs": [{"interactionId": f"x{i}"}]}
    deep = '{"questionItems": [{"interactions": [{"id": "x", "type": "single_choice"}], "answerSpecs": [{"interactionId": "x", "z": ' + '{"a": [' * 490 + '{"correctOptionId": "A"}' + "]}" * 490 + "}]}]}"
    texts = [json.dumps({"questionItems": [item(0, 1.0), item(1, 1), item(2, 0), item(3, "1"), {"interactions": []}, item(4, 1)]}), deep, None, "null"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, t string").select("doc_id", F.try_parse_json("t").alias("doc"))
    found = {r.doc_id: [(f.rule, f.location) for f in r.found] for r in rules_object.object_findings(docs).collect()}
    dimensions = [location for rule, location in found[0] if rule == "G44"]
    assert dimensions == [f"/questionItems/{i}/answerSpecs/0/config/dimensions" for i in (0, 2, 3)]
    assert "G36" not in [rule for rule, _ in found[1]] and "G26" in [rule for rule, _ in found[1]]
    assert found[2] == found[3] == [("G01", "/item/0")]
