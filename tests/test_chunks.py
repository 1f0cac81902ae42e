"""Payloads cut into elements by chunks, against the JSON parser of Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rubrica.sources import chunks


def relation(spark, payloads):
    """Chunks of texts as the reader gives them: what lies between closing braces."""
    rows = []
    for name, text in payloads.items():
        parts = text.split("}")
        closed = len(parts) - (1 if parts[-1] == "" else 0)
        for n, part in enumerate(parts[:closed]):
            rows.append((name, n, part, n < len(parts) - 1))
    return spark.createDataFrame(rows, "batch_id string, n long, value string, closed boolean").repartition(7)


def read(spark, payloads):
    rows = chunks.split_elements(relation(spark, payloads)).select("batch_id", "pos", F.to_json("doc").alias("doc"), "parsed", "is_object").collect()
    found = {name: [] for name in payloads}
    for r in sorted(rows, key=lambda r: (r.batch_id, r.pos is None, r.pos)):
        assert r.pos in (None, len(found[r.batch_id]))
        found[r.batch_id].append(json.loads(r.doc) if r.parsed else "unread")
        assert r.is_object == (r.parsed and isinstance(found[r.batch_id][-1], dict))
    return found


def element(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 4)
    if kind == 0:
        return rng.randrange(100)
    if kind < 4:
        return "".join(rng.choice('ab"\\{}[],:\n é') for _ in range(rng.randrange(9)))
    if kind < 6:
        return [element(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": element(rng, depth + 1) for i in range(rng.randrange(4))} | ({"generatedQuestions": [{"a": 1}]} if rng.random() < 0.2 else {})


def test_lists_wrappers_and_objects(spark):
    rng = random.Random(3)
    payloads, want = {}, {}
    for at in range(60):
        listed = [element(rng) for _ in range(rng.randrange(6))]
        style = {"indent": rng.choice([None, 1]), "ensure_ascii": False}
        name = f"b{at}"
        if at % 3 == 0:
            payloads[name], want[name] = json.dumps(listed, **style) + "\n", listed
        elif at % 3 == 1:
            inner = {"x": {"generatedQuestions": [5], "y": '"generatedQuestions": ['}, "z": element(rng)}
            payloads[name] = json.dumps(inner | {"generatedQuestions": listed, "end": element(rng), "o": {"p": {}}}, **style)
            want[name] = listed
        else:
            single = {"only": element(rng), "s": listed, "in": {"generatedQuestions": listed}}
            payloads[name], want[name] = json.dumps(single, **style), [single]
    assert read(spark, payloads) == want


def test_odd_payloads(spark):
    found = read(
        spark,
        {
            "empty": "[]", "blank": " \n", "scalar": "5", "text": '"[{}]"', "no list": '{"generatedQuestions": 5}',
            "mark": '\ufeff[{"a": 1}]', "open": '[{"a": 1}', "cut": '[{"a": 1}, {"b": {"c": 2}', "tail": '[{"a": 1}] 7',
            "later": '[{"a": 1}] {}', "comma": '[{"a": 1},]', "none": '[{"a": 1} {"b": 2}]', "bad": '[{"a": 1}, {"b": x}, {"c": 3}]',
            "deep": '[{"a": 1}, {"b": ' + "[" * 1500 + "]" * 1500 + '}, {"c": 3}]', "object": '{"a": 1', "two": '{"a": 1} {"b": 1}',
        },
    )
    assert found == {
        "empty": [], "blank": [], "scalar": [], "text": [], "no list": [{"generatedQuestions": 5}],
        "mark": [{"a": 1}], "open": [{"a": 1}, "unread"], "cut": [{"a": 1}, "unread", "unread"], "tail": [{"a": 1}, "unread"],
        "later": [{"a": 1}, "unread"], "comma": [{"a": 1}, "unread"], "none": [{"a": 1}, "unread"], "bad": [{"a": 1}, "unread", {"c": 3}],
        "deep": [{"a": 1}, "unread", {"c": 3}], "object": ["unread", "unread"], "two": [{"a": 1}, "unread"],
    }


def test_empty_relation_and_issues(spark):
    assert chunks.split_elements(relation(spark, {"b": "[]"}).limit(0)).count() == 0
    issues = chunks.unparsed(chunks.split_elements(relation(spark, {"b": "[{}, {"}))).collect()
    assert [(r.batch_id, r.severity) for r in issues][0] == ("b", "bad")


@pytest.mark.parametrize("size", ["128m", "700"])
def test_files_in_splits(spark, tmp_path, size):
    listed = [{"id": f"d{n}", "t": "x}{" * (n % 23)} for n in range(600)]
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(listed, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"n": 1, "generatedQuestions": listed[:5]}), encoding="utf-8")
    (tmp_path / "c.json").write_text('{"a": 1', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = chunks.split_elements(chunks.read_chunks(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {}
    for r in sorted(rows, key=lambda r: (r.batch_id, r.pos is None, r.pos)):
        found.setdefault(r.batch_id.rsplit("/", 1)[1], []).append(r.id if r.parsed else None)
    assert found == {"a.json": [d["id"] for d in listed], "b.json": [d["id"] for d in listed[:5]], "c.json": [None, None]}
