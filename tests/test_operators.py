import json

import pytest
from fixtures import block, changed, choice_object, plan_record, variants
from pyspark.sql import functions as F

from rubrica.functions import variants as v
from rubrica.operators import census, contracts, coverage, flatten, hygiene, issues, ordering, repair, requests, rules_plan, sequence
from rubrica.plans import object_check
from rubrica.sources import documents, replies, sinks

PATCH = "array<struct<op:string,path:string,value:variant>>"


# --- order-dependent operators against plain windows -----------------------------------------------------------------


def test_split_operators_equal_plain_windows(spark):
    """A key with a third of all rows is numbered bucket by bucket with the same result as one window."""
    from pyspark.sql import Window

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.hash("id") % 700).alias("o"), "id"
    )
    bucket, order = [F.floor(F.col("o") / 16)], [F.col("o"), F.col("id")]
    got = ordering.split_row_number(df, ["k"], bucket, order, "n")
    got = ordering.split_lag(got, ["k"], bucket, order, ["id"], "prev_")
    got = ordering.split_running_sum(got, ["k"], bucket, order, F.col("id"), "total")
    w = Window.partitionBy("k").orderBy("o", "id")
    both = got.select(
        "*",
        F.row_number().over(w).alias("n2"),
        F.lag("id").over(w).alias("p2"),
        F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t2"),
    )
    wrong = both.filter((F.col("n") != F.col("n2")) | ~F.col("prev_id").eqNullSafe(F.col("p2")) | (F.col("total") != F.col("t2")))
    assert got.count() == 3000 and wrong.count() == 0


def test_canonical_issues_is_idempotent(spark):
    rows = [("d", i, s, "runtime", "/a", r, g, "x") for i, (s, r, g) in enumerate([("warning", "Re  peat", "long one"), ("bad", "re peat", "short"), ("bad", "other", "")])]
    df = spark.createDataFrame(rows, "doc_id string, pos int, severity string, category string, location string, reason string, suggestion string, repair_intent string")
    once = issues.canonical_issues(df).drop("n_merged")
    assert sorted(once.collect()) == sorted(issues.canonical_issues(once).drop("n_merged").collect())
    first = {r.pos: r for r in once.collect()}[0]
    assert (first.severity, first.reason, first.suggestion) == ("bad", "re peat", "short")


# --- hygiene ---------------------------------------------------------------------------------------------------------

TEXTS = {
    "H1": "ab",
    "H2": "Hai  lần trống.",
    "H3": "Một dấu .",
    "H4": "Một,hai",
    "H5": "Sao vậy!!",
    "H6": "Cho cho biết",
    "H7": "Ã lỗi mã hoá",
    "H8": "đ" * 651,
    "H9": "((mở ra",
}


def test_hygiene_rules(spark):
    rows = [(k, "/instruction/0/text", "instruction", s) for k, s in TEXTS.items()]
    rows += [("math", "/m", "stem", "Tính $a  ,b..c$ nhé."), ("newline", "/n", "stem", "Dòng một\n\nDòng hai.")]
    nodes = spark.createDataFrame(rows, "doc_id string, pointer string, role string, text string")
    found = hygiene.text_hygiene(nodes).collect()
    assert {r.doc_id: r.rule for r in found} == {k: k for k in TEXTS}
    fixed = {r.rule: r.corrected_text for r in found if r.corrected_text}
    assert fixed == {"H2": "Hai lần trống.", "H3": "Một dấu.", "H6": "Cho biết"}


# --- plans -----------------------------------------------------------------------------------------------------------

Q = ["question_plan", "plan", 0]
ITEM = Q + ["questionItems", 0]
X = ITEM + ["interactions", 0]


def p(path, value=..., drop=False):
    return changed(plan_record(), path, value, drop)


PLANS = {
    "valid": (plan_record(), []),
    "not an object": (3, ["L00"]),
    "id": (p(["_id"], ""), ["L01"]),
    "question": (p(["question"], " "), ["L02"]),
    "no plan": (p(["question_plan"], None), ["L03"]),
    "text plan": (p(["question_plan"], "x"), ["L04", "L05"]),
    "no list": (p(["question_plan", "plan"], {}), ["L05"]),
    "bare list": (p(["question_plan"], []), ["L06"]),
    "question shape": (p(Q, 1), ["L07"]),
    "order zero": (p(Q + ["questionOrder"], 0), ["L08"]),
    "order boolean": (p(Q + ["questionOrder"], True), ["L08"]),
    "order float": (p(Q + ["questionOrder"], 1.0), ["L08"]),
    "order null": (p(Q + ["questionOrder"], None), []),
    "alias with null wins": (changed(p(Q + ["questionStatement"], None), Q + ["question_statement"], "s"), ["L09"]),
    "items shape": (p(Q + ["questionItems"], {}), ["L10"]),
    "no items": (p(Q + ["questionItems"], []), ["L11"]),
    "item shape": (p(ITEM, None), ["L12"]),
    "requirement": (p(ITEM + ["requirement"], [" "]), ["L13"]),
    "interactions shape": (p(ITEM + ["interactions"], drop=True), ["L14"]),
    "no interactions": (p(ITEM + ["interactions"], []), ["L15"]),
    "interaction shape": (p(X, "x"), ["L16"]),
    "no type": (p(X + ["interactionType"], ""), ["L17"]),
    "type": (p(X + ["interactionType"], "essay"), ["L18"]),
    "interaction requirement": (p(X + ["interactionRequirement"], drop=True), ["L19"]),
    "repeated order": (p(ITEM + ["interactions"], plan_record()["question_plan"]["plan"][0]["questionItems"][0]["interactions"] * 2), ["L20"]),
}


def test_plan_rules(spark):
    records = variants(spark, [(k, d) for k, (d, _) in PLANS.items()], "record_id", "record")
    found = rules_plan.check_plan(records)
    got = {k: [] for k in PLANS}
    for r in found.orderBy("record_id", "ord").collect():
        got[r.record_id].append(r.rule)
    assert got == {k: e for k, (_, e) in PLANS.items()}
    rollup = rules_plan.plan_check_rollup(records)
    assert rollup.filter("structural_valid").count() == sum(not e for _, e in PLANS.values())
    assert {r.record_id for r in rules_plan.valid_records(records).collect()} == {k for k, (_, e) in PLANS.items() if not e}
    assert "Exchange" not in rollup._jdf.queryExecution().executedPlan().toString()


def test_strict_plan(spark):
    plan = plan_record()["question_plan"]
    cases = {
        "ok": (plan, []),
        "marker": (changed(plan, ["type"], "x"), ["marker"]),
        "root key": (changed(plan, ["note"], 1), ["unknown_key"]),
        "empty": (changed(plan, ["plan"], []), ["plan_list"]),
        "hedge": (changed(plan, ["plan", 0, "questionStatement"], "Có thể giải"), ["hedging"]),
        "patch key": (changed(plan, ["plan", 0, "before"], 1), ["banned_key", "unknown_key"]),
        "type": (changed(plan, ["plan", 0, "questionItems", 0, "interactions", 0, "interactionType"], "essay"), ["interaction_type"]),
    }
    df = variants(spark, [(k, d) for k, (d, _) in cases.items()], "record_id", "plan")
    got = {k: [] for k in cases}
    for r in rules_plan.check_plan_strict(df).collect():
        got[r.record_id].append(r.rule)
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(e) for k, (_, e) in cases.items()}


# --- patches ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "patches, expected",
    [
        ([("replace", "/a/1", "9")], '{"a":[1,9],"b":{"c":null}}'),
        ([("add", "/a/0", "0"), ("add", "/a/1", "5"), ("add", "/a/-", "7")], '{"a":[0,5,1,2,7],"b":{"c":null}}'),
        ([("remove", "/a/0"), ("remove", "/b/c")], '{"a":[2],"b":{}}'),
        ([("add", "/b/x~1y", '"k"')], '{"a":[1,2],"b":{"c":null,"x/y":"k"}}'),
        ([("replace", "/b/none", "1")], None),
        ([("replace", "/a/0", "3"), ("remove", "/a/7")], None),
        ([("add", "/a/3", "1")], None),
        ([("remove", "")], None),
        ([("replace", "", '{"n":1}')], '{"n":1}'),
        ([("replace", "b", "1")], None),
    ],
)
def test_patches(spark, patches, expected):
    rows = [("d", '{"a":[1,2],"b":{"c":null}}', [(o, pt, (val[0] if val else None)) for o, pt, *val in patches])]
    df = spark.createDataFrame(rows, "doc_id string, body string, raw array<struct<op:string,path:string,value:string>>").select(
        "doc_id",
        F.parse_json("body").alias("doc"),
        F.transform("raw", lambda x: F.struct(x["op"].alias("op"), x["path"].alias("path"), F.try_parse_json(x["value"]).alias("value"))).cast(PATCH).alias("patches"),
    )
    row = repair.patch_documents(df).select(F.to_json("new_doc").alias("n"), "patch_error").first()
    assert row.n == expected and (row.patch_error is None) == (expected is not None)


def test_repair_rounds_keep_the_last_success(spark):
    doc = choice_object()
    del doc["instruction"]
    docs = variants(spark, [("fixed", doc), ("stuck", doc), ("broken", doc)])
    note = '[{"id": "b", "type": "text", "text": "Đọc kỹ đề bài."}]'
    rows = [
        ("fixed", 1, [("add", "/instruction", note)]),
        ("stuck", 1, [("add", "/extra", "1")]),
        ("stuck", 2, [("remove", "/none", None)]),
        ("broken", 1, [("remove", "/questionItems", None)]),
    ]
    patches = spark.createDataFrame(rows, "doc_id string, round int, raw array<struct<op:string,path:string,value:string>>").select(
        "doc_id",
        "round",
        F.transform("raw", lambda x: F.struct(x["op"].alias("op"), x["path"].alias("path"), F.try_parse_json(x["value"]).alias("value"))).cast(PATCH).alias("patches"),
    )
    got = {r.doc_id: (r.stop_reason, r.loop_count, r.repair_status) for r in object_check.repair_rounds(docs, patches, 3).collect()}
    assert got == {
        "fixed": ("recheck_good", 1, "repaired"),
        "stuck": ("needs_manual_review", 2, "repaired"),
        "broken": ("needs_manual_review", 1, "needs_manual_review"),
    }


# --- replies ---------------------------------------------------------------------------------------------------------


def test_split_reply_must_be_lossless(spark):
    docs = variants(spark, [("d", choice_object())])
    blocks = docs.select("doc_id", requests.solution_blocks(F.col("doc")).alias("blocks"))
    path = "/solutions/0/solutionContent/0/text"
    states = lambda *parts: json.dumps({"states": [{"solution_index": 0, "order": i, "source_path": path, "source_text": s} for i, s in enumerate(parts)]})
    cases = [
        (states("2 + 3", " = 5"), None),
        (states("2 + 3 = 6"), f"text changed at {path}"),
        (states("2 + 3 = 5", ""), f"empty state at {path}"),
        ('{"states": []}', "a source block was skipped"),
        ("```json\n" + states("no") + "\n```\n```json\n" + states("2 + 3 = 5") + "\n```", None),
        ("plain words", contracts.NO_OBJECT),
    ]
    rows = spark.createDataFrame([("d", i, c) for i, (c, _) in enumerate(cases)], "doc_id string, n int, content string")
    got = contracts.check_split_replies(rows.join(blocks, "doc_id")).orderBy("n").collect()
    assert [r.error for r in got] == [e for _, e in cases]


def test_judge_stage_end_to_end(spark):
    docs = variants(spark, [("d", choice_object())])
    path = "/solutions/0/solutionContent/0/text"
    split = json.dumps({"states": [{"order": 0, "source_path": path, "source_text": "2 + 3 = 5"}]})
    stage = {"stage": 1, "from_order": 0, "to_order": 1, "kiem_tra_so_hoc": None, "kiem_tra_lap_luan": "ok", "trang_thai_buoc": False, "reason": "wrong"}
    bad = json.dumps({"stage_results": [stage], "reason": "r", "suggestion": "s", "verdict": "bad"})
    rows = [("d", "split", "fast", 1, split), ("d", "judge", "fast", 1, bad), ("d", "judge", "fast", 2, bad)]
    given = spark.createDataFrame(rows, "doc_id string, stage string, model_tier string, run_no int, content string")
    row = object_check.judge_stage(docs, given).first()
    assert (row.decision, row.is_good, row.confirmed, row.to_order) == ("agreement", False, True, 1)


def test_anchor_contexts_skip_essays_and_take_the_first_spec(spark):
    doc = choice_object()
    item = doc["questionItems"][0]
    item["answerSpecs"].append({"interactionId": "x1", "type": "single_choice", "expected": {"correctOptionId": "B"}})
    item["interactions"].append({"id": "x2", "type": "essay", "config": {}, "display": {}})
    rows = requests.anchor_contexts(variants(spark, [("d", doc)])).collect()
    assert [(r.iid, r.spec_path, len(r.options)) for r in rows] == [("x1", "/questionItems/0/answerSpecs/0", 3)]


def test_mentions(spark):
    rows = [("câu a chưa có", "a)"), ("phần thứ hai", "a)"), ("Thiếu Phần B.", "phần b"), ("xét b) trước", "(b)"), ("tính tổng và hiệu", "tổng hiệu")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(coverage.mentions(F.col("t"), F.col("s"))).collect()] == [True, False, True, True, True]


def test_census_of_one_object(spark):
    found = {(r.facet, r.name, r.key): r.n for r in census.key_census(variants(spark, [("d", choice_object())], name="record")).collect()}
    assert found[("count", "interactions", None)] == 1
    assert found[("expected_shape", "dict", None)] == 1
    assert found[("config_key", "single_choice", "options")] == 1
    assert found[("block_type", "text", None)] == 4


def test_census_lists_any_number_of_keys(spark):
    """2500 free keys of one interaction type are listed whole, in order, in lines of at most 1000."""
    doc = choice_object()
    doc["questionItems"][0]["interactions"][0]["config"] = {f"k{n:05d}": 1 for n in range(2500)}
    report = census.census_report(census.key_census(variants(spark, [("d", doc)], name="record")))
    lines = report.where("section = 'Config Keys By Interaction Type'").orderBy("part").collect()
    assert [(r.name, r.part, r.value.count(",") + 1) for r in lines] == [("single_choice", 0, 1000), ("single_choice", 1, 1000), ("single_choice", 2, 500)]
    assert ", ".join(r.value for r in lines).split(", ") == [f"k{n:05d}" for n in range(2500)]


# --- sources and sinks -------------------------------------------------------------------------------------------------


def test_read_unwrap_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("﻿" + json.dumps([choice_object(), 3]), encoding="utf-8")
    (tmp_path / "in" / "b.json").write_text(json.dumps({"_id": "w", "generatedQuestions": []}), encoding="utf-8")
    (tmp_path / "in" / "c.json").write_text("not json", encoding="utf-8")
    payloads = documents.read_documents(spark, str(tmp_path / "in"), lines=False)
    docs = documents.unwrap_payload(payloads)
    assert sorted((r.pos, r.id, r.is_object) for r in docs.collect()) == [(0, "q1", True), (1, "item[1]", False)]
    assert documents.check_batch(payloads.select("batch_id"), docs).count() == 2
    assert documents.limit_per_batch(docs, 1).count() == 1
    results = docs.select("id", F.when(F.col("is_object"), F.col("doc")).alias("new_doc"))
    sinks.write_repaired(results, str(tmp_path / "out"))
    assert documents.read_documents(spark, str(tmp_path / "out"), lines=True).filter(v.is_object(F.col("payload"))).count() == 1
    sinks.write_results(results.select("id"), str(tmp_path / "res"))
    sinks.write_report(results.select("id"), str(tmp_path / "rep"), "id")
    assert spark.read.text(str(tmp_path / "rep")).count() == 2
    (tmp_path / "reply.json").write_text('{"doc_id": "d", "stage": "judge", "content": "{}", "latency": 0.5}\n')
    assert replies.read_replies(spark, str(tmp_path / "reply.json")).first().latency == 0.5


def test_line_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [json.dumps({"_id": f"d{n}", "pad": "x" * (n % 97)}) for n in range(4000)]
    (tmp_path / "a.json").write_text("\ufeff" + "\n".join(lines), encoding="utf-8")
    (tmp_path / "b.json").write_text("\r\n".join(lines[:50]) + "\n\n7\n", encoding="utf-8")
    ids = {}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "9k", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = documents.read_documents(spark, str(tmp_path))
            ids[size] = sorted((r.batch_id.rsplit("/", 1)[1], r.name) for r in read.select("batch_id", F.try_variant_get("payload", "$._id", "string").alias("name")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids["128m"] == ids["9k"] == ids["1k"] and len(ids["1k"]) == 4052
    assert dict(ids["1k"])["a.json#3999"] == "d3999" and dict(ids["1k"])["b.json#49"] == "d49"


def test_quantile_buckets_spread_a_hot_key(spark):
    """A key with a third of all rows, all within one thousandth of the range, takes a few buckets' worth and no more a bucket."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") / 9000).otherwise(F.col("id") * 1.0).alias("at"), "id")
    bucketed = df.withColumn("b", ordering.quantile_bucket(df, "at", 64))
    most = bucketed.groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert most < 3 * 9000 / 64
    numbered = ordering.split_row_number(df, ["k"], [ordering.quantile_bucket(df, "at", 64)], [F.col("at"), F.col("id")], "n")
    hot = numbered.where("k = 7").orderBy("at", "id").collect()
    assert [r.n for r in hot] == list(range(1, len(hot) + 1))


def test_check_text_equals_the_relations(spark):
    """Issues and request from the row are those of the rules and candidates over node relations, from one scan."""
    texts = list(TEXTS.values())
    docs = {"clean": ["Một câu đúng."], "all": texts, "some": ["Một câu đúng.", texts[3], "Câu khác."], "empty": []}
    rows = [(k, [(f"/instruction/{i}/text", "instruction" if i == 0 else "solution", x) for i, x in enumerate(xs)]) for k, xs in docs.items()]
    df = spark.createDataFrame(rows, "doc_id string, nodes array<struct<pointer:string,role:string,text:string>>")
    checked = hygiene.check_text(df)
    assert checked._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    nodes = df.select("doc_id", F.posexplode("nodes").alias("pos", "n")).select("doc_id", "pos", "n.*")
    issues = hygiene.text_hygiene(nodes)
    want = sorted((r.doc_id, r.rule, r.severity, r.location, r.reason, r.suggestion, r.corrected_text) for r in issues.collect())
    got = sorted((r.doc_id, *r.i) for r in checked.select("doc_id", F.explode("issues").alias("i")).collect())
    assert got == want and len({w[1] for w in want}) > 7
    asked = hygiene.spelling_request(hygiene.candidate_nodes(nodes, issues))
    want = sorted(map(str, asked.drop("doc_id").collect()))
    assert sorted(str(r.q) for r in checked.select(F.explode("request").alias("q")).collect()) == want and want
    assert {r.doc_id: len(r.request) for r in checked.collect()}["clean"] == 0


def test_text_nodes_follow_nested_content(spark):
    doc = choice_object()
    doc["instruction"] = [{"id": "o", "type": "box", "content": [block("inner"), {"content": [block("deeper")]}]}, block("after")]
    nodes = flatten.text_nodes(variants(spark, [("d", doc)])).orderBy("pos").collect()
    assert [(n.pointer, n.text) for n in nodes[:3]] == [
        ("/instruction/0/content/0/text", "inner"),
        ("/instruction/0/content/1/content/0/text", "deeper"),
        ("/instruction/1/text", "after"),
    ]
    assert [n.role for n in nodes] == ["instruction"] * 3 + ["stem"] + ["option"] * 3 + ["hint", "solution"]


def test_problem_anchor_prefers_equations(spark):
    rows = [("d", 0, "/i", "instruction", "a long instruction text"), ("d", 1, "/s", "stem", "x = 1"), ("d", 2, "/t", "stem", "y = 2"), ("d", 3, "/o", "option", "a = b = c")]
    nodes = spark.createDataFrame(rows, "doc_id string, pos int, pointer string, role string, text string")
    assert tuple(sequence.problem_anchor(nodes).first()) == ("d", "/s", "x = 1")
