"""The object flow over a ledger of replies: order of the gates, resuming, selection of what to repair, and judged re-checks."""

import copy
import json
import random

import pytest
from fixtures import block, changed, choice_object, variants
from pyspark.sql import functions as F

from rubrica.operators import consensus, requests, sequence
from rubrica.plans import object_flow
from rubrica.plans.object_flow import Options, advance

LEDGER = "doc_id string, round int, stage string, model_tier string, run_no int, content string, at long"
TEXT = "/solutions/0/solutionContent/0/text"


def split(text="2 + 3 = 5"):
    return json.dumps({"states": [{"order": 0, "source_path": TEXT, "source_text": text}]})


def judgement(verdict="good", ok=True, reason=None):
    stage = {"stage": 1, "from_order": 0, "to_order": 1, "kiem_tra_so_hoc": None, "kiem_tra_lap_luan": "seen", "trang_thai_buoc": ok, "reason": "" if ok else "wrong step"}
    told = "" if verdict == "good" else reason or "The step is wrong."
    return json.dumps({"stage_results": [stage], "reason": told, "suggestion": told, "verdict": verdict})


BAD = judgement("bad", False)


def resolved(fixes=(), issues=(), status="resolved", option="A"):
    return json.dumps(
        {
            "resolver_status": status,
            "final_answer": {"matched_option_id": option, "evidence_from_solution": "so it is five"},
            "answerSpec_matches_solution": status == "resolved" and not fixes,
            "fields_to_fix": [{"path": p, "value": x} for p, x in fixes],
            "issues": [dict(zip(("severity", "category", "location", "reason", "suggestion", "repair_intent"), i)) for i in issues],
        }
    )


FIX = resolved([("/questionItems/0/answerSpecs/0/expected/correctOptionId", "A")], [("bad", "solution_anchor_consistency", "/questionItems/0", "The spec differs.", "Align it.", "align_fields_to_solution")])
HINT = resolved((), [("warning", "hint_quality", "/questionItems/0/hints", "The hint misleads.", "Change it.", "align_hint_to_solution")])
MANUAL = resolved((), [("needs_review", "solution_quality", "/solutions", "Two answers.", "Look at it.", "needs_manual_review")], "needs_manual_review")
FINE = resolved()


def rows(doc, number, **slots):
    return [(doc, number, *object_flow.SLOTS[name], content, at) for at, (name, content) in enumerate(slots.items())]


def judged(doc, number=0, one=None, two=None, **more):
    good = judgement()
    return rows(doc, number, split_fast=split(), judge_fast_1=one or good, judge_fast_2=two or one or good, **more)


def both(reply):
    return {"resolve_fast_1": reply, "resolve_fast_2": reply}


def wrong_spec():
    return changed(choice_object(), ["questionItems", 0, "answerSpecs", 0, "expected", "correctOptionId"], "B")


def run(spark, docs, ledger, options=Options()):
    flow = advance(variants(spark, list(docs.items())), spark.createDataFrame(ledger, LEDGER), options)
    results = {r.doc_id: r for r in flow.results.collect()}
    open_ = {}
    for r in flow.requests.collect():
        assert r.request and json.loads(r.request)
        open_.setdefault(r.doc_id, set()).add((r.round, r.stage, r.model_tier, r.run_no))
    return flow, results, open_


def patches(*given, status="repaired"):
    return json.dumps({"repair_status": status, "patches": [dict(zip(("op", "path", "value"), p)) for p in given]})


def test_gates_come_in_order(spark):
    """Structure before splitter, splitter before judge, judge before resolver; a blocker keeps a document from the resolver."""
    docs = {k: choice_object() for k in ("new", "split", "one run", "judged", "asked once", "resolved", "doubted", "unsure", "no judge", "no split", "strong split")}
    docs["broken"] = changed(choice_object(), ["questionItems", 0, "id"], "")
    ledger = [
        *rows("split", 0, split_fast=split()),
        *rows("one run", 0, split_fast=split(), judge_fast_1=judgement()),
        *judged("judged"),
        *judged("asked once", resolve_fast_1=FINE),
        *judged("resolved", **both(FINE)),
        ("resolved", 0, "judge", "fast", 1, BAD, 99),  # of replies to one request, the first one counts
        ("resolved", 0, "gossip", "fast", 1, BAD, 0),
        ("other", 0, "split", "fast", 1, BAD, 0),
        *judged("doubted", one=BAD, **both(FINE)),  # resolver replies that nobody asked for change nothing
        *judged("unsure", one="no idea", two=judgement()),
        *judged("no judge", one="no idea", judge_strong="no idea"),
        *rows("no split", 0, split_fast=split("changed"), split_strong="no idea"),
        *rows("strong split", 0, split_fast="no idea", split_strong=split()),
    ]
    flow, got, open_ = run(spark, docs, ledger, Options(rounds=0))
    judges = {(0, "judge", "fast", 1), (0, "judge", "fast", 2)}
    resolvers = {(0, "resolve", "fast", 1), (0, "resolve", "fast", 2)}
    assert open_ == {
        "new": {(0, "split", "fast", 1)},
        "split": judges,
        "one run": {(0, "judge", "fast", 2)},
        "judged": resolvers,
        "asked once": {(0, "resolve", "fast", 2)},
        "unsure": {(0, "judge", "strong", 1)},
        "strong split": judges,
    }
    assert {k: r.open_stage for k, r in got.items() if r.open_stage} == {"new": "split", "split": "judge", "one run": "judge", "judged": "resolve", "asked once": "resolve", "unsure": "judge", "strong split": "judge"}
    assert {k: r.is_good for k, r in got.items() if not r.open_stage} == {"resolved": True, "doubted": False, "no judge": False, "no split": False, "broken": False}
    kinds = {}
    for r in flow.issues.collect():
        kinds.setdefault(r.doc_id, set()).add(r.category)
    assert kinds == {"doubted": {"solution_quality"}, "no judge": {"runtime"}, "no split": {"runtime"}, "broken": {"render_schema"}}
    places = {r.doc_id: r.location for r in flow.issues.collect()}
    assert places["doubted"] == TEXT
    summary = object_flow.summary(flow).first()
    assert (summary.total, summary.good, summary.judge_calls, summary.judge_fallbacks, summary.judge_agreements) == (5, 1, 4, 2, 2)
    shown = object_flow.publish(flow).collect()
    assert sorted((r.doc_id, r.is_good, r.issue.category if r.issue else None) for r in shown) == [
        ("broken", False, "render_schema"), ("doubted", False, "solution_quality"), ("no judge", False, "runtime"), ("no split", False, "runtime"), ("resolved", True, None),
    ]


RESUMED = judged("d", **both(FIX)) + judged("d", 1, **both(FINE))


@pytest.fixture(scope="module")
def repaired(spark):
    """One run over documents at all places of the repair, each test looks at its own."""
    wrong = ("good", "wrong", "resolver", "open", "broken judge")
    hints = ("hint", "hint done", "hint out of scope", "hint failed", "hint bad text")
    docs = {k: wrong_spec() for k in wrong} | {k: choice_object() for k in (*hints, "manual", "disagree", "fine", "doubted")}
    docs |= {f"after {n}": wrong_spec() for n in range(len(RESUMED) + 1)}
    docs["schema"] = changed(choice_object(), ["questionItems", 0, "interactions", 0, "display"], 3)
    docs["schema done"] = copy.deepcopy(docs["schema"])
    ledger = [r for k in wrong for r in judged(k, **both(FIX))]
    ledger += judged("good", 1, **both(FINE)) + judged("wrong", 1, one=BAD) + judged("resolver", 1, **both(MANUAL)) + judged("broken judge", 1, one="?", judge_strong="?")
    hint = "/questionItems/0/hints/0/content/0/text"
    ledger += [r for k in hints for r in judged(k, **both(HINT))]
    ledger += rows("hint done", 0, repair_strong=patches(("replace", hint, "Add the numbers.")))
    ledger += rows("hint out of scope", 0, repair_strong=patches(("replace", "/questionItems/0/stem/0/text", "New.")))
    ledger += rows("hint failed", 0, repair_strong=patches(status="failed"))
    ledger += rows("hint bad text", 0, repair_strong=patches(("replace", hint, "Twice  blank .")))
    ledger += judged("manual", resolve_fast_1=MANUAL, resolve_fast_2=MANUAL)
    ledger += judged("disagree", resolve_fast_1=FINE, resolve_fast_2=HINT, resolve_strong="?")
    ledger += rows("schema done", 0, repair_fast=patches(("replace", "/questionItems/0/interactions/0/display", {})))
    # replies for rounds these never reach
    ledger += judged("fine", **both(FINE)) + judged("fine", 1, one=BAD) + judged("doubted", one=BAD) + judged("doubted", 1, **both(FINE))
    ledger += [(f"after {n}", *r[1:]) for n in range(len(RESUMED) + 1) for r in RESUMED[:n]]
    return run(spark, docs, ledger)


def test_resuming_is_the_same_as_running_at_once(repaired):
    """Replies come one by one; at any time the ledger alone says what is open, and what is appended next was asked for."""
    _, got, open_ = repaired
    seen = [(got[f"after {n}"].open_stage, got[f"after {n}"].round) for n in range(len(RESUMED) + 1)]
    assert seen == [("split", 0), ("judge", 0), ("judge", 0), ("resolve", 0), ("resolve", 0), ("split", 1), ("judge", 1), ("judge", 1), ("resolve", 1), ("resolve", 1), (None, 1)]
    for n, reply in enumerate(RESUMED):
        assert tuple(reply[1:5]) in open_[f"after {n}"]
    row = got[f"after {len(RESUMED)}"]
    assert (row.is_good, row.repair_status, row.stop_reason, row.loop_count) == (False, "repaired", "recheck_good", 1)


def test_a_wrong_answer_after_a_repair_is_never_good(repaired):
    _, got, open_ = repaired
    cases = {"good": "recheck_good", "wrong": "max_loop_reached", "resolver": "max_loop_reached", "broken judge": "max_loop_reached", "open": None}
    assert {k: got[k].stop_reason for k in cases} == cases
    assert open_["open"] == {(1, "split", "fast", 1)} and not set(open_) & (set(cases) - {"open"})
    for k in cases:
        assert json.loads(got[k].new_doc.toJson())["questionItems"][0]["answerSpecs"][0]["expected"] == {"correctOptionId": "A"}


def test_only_changed_documents_enter_the_next_round(repaired):
    _, got, open_ = repaired
    assert {k: (got[k].stop_reason, got[k].loop_count, got[k].repair_status) for k in ("fine", "doubted")} == {
        "fine": ("already_good", 0, "skipped"), "doubted": ("needs_manual_review", 1, "needs_manual_review")
    }
    assert got["fine"].is_good and not got["doubted"].is_good and not set(open_) & {"fine", "doubted"}


def test_selection_and_repair(repaired):
    """A manual solution problem comes before its clean-up and that before anything else; scoped repairs ask the tier of their intent."""
    _, got, open_ = repaired
    asked = {"hint": {(0, "repair", "strong", 1)}, "schema": {(0, "repair", "fast", 1)}, "hint done": {(1, "split", "fast", 1)}, "schema done": {(1, "split", "fast", 1)}}
    assert {k: open_[k] for k in asked} == asked
    ended = {"hint out of scope": "needs_manual_review", "hint failed": "failed", "hint bad text": "failed", "manual": "needs_manual_review", "disagree": "needs_manual_review"}
    assert {k: got[k].repair_status for k in ended} == ended
    assert got["manual"].decision == got["disagree"].decision == "manual_solution" and got["hint failed"].decision == "request"


def test_without_fallback_or_with_one_resolver_run(spark):
    docs = {k: choice_object() for k in ("split", "judge", "resolver", "once")}
    ledger = rows("split", 0, split_fast="?") + judged("judge", one="?") + judged("resolver", resolve_fast_1=FINE, resolve_fast_2=HINT) + judged("once", resolve_fast_1=FINE)
    _, got, _ = run(spark, docs, ledger, Options(fallback=False, rounds=0))
    assert {k: (r.open_stage, r.is_good) for k, r in got.items()} == {"split": (None, False), "judge": (None, False), "resolver": (None, False), "once": ("resolve", None)}
    _, got, _ = run(spark, docs, ledger, Options(resolver_runs=1, rounds=0))
    assert got["once"].is_good and got["once"].resolver_attempts == 1


def test_lenient_mode_lets_warnings_pass(spark):
    ledger = judged("d", **both(HINT))
    _, got, _ = run(spark, {"d": choice_object()}, ledger, Options(strict=False, rounds=0))
    assert got["d"].is_good


def test_no_documents_and_no_replies(spark):
    empty = spark.createDataFrame([], "doc_id string, body string").select("doc_id", F.parse_json("body").alias("doc"))
    flow = advance(empty, spark.createDataFrame([], LEDGER))
    assert flow.results.count() == flow.requests.count() == flow.issues.count() == 0


# --- the checks inside a row against those over relations ---------------------------------------------------------------------


def test_row_checks_equal_relation_checks(spark):
    rng = random.Random(3)
    docs, expected_rows, heads, stages = [], [], [], []
    for n in range(300):
        doc, steps = f"d{n}", rng.randint(0, 3)
        want = [(0, k, k + 1) for k in range(steps)]
        given = []
        for k in range(rng.choice([steps, steps, steps, max(0, steps - 1), steps + 1])):
            sol, a, b = want[k] if k < steps and rng.random() < 0.9 else (rng.randint(0, 1), k, k + rng.randint(1, 2))
            given.append((sol, b if rng.random() < 0.95 else 0, a, b, rng.choice(["why", "why", "why", " "]), rng.random() < 0.8, rng.choice(["r", "r", ""])))
        head = (rng.choice(["good", "good", "bad", "uncertain", "odd"]), rng.choice(["r", "r", ""]), rng.choice(["s", "s", " "]))
        docs.append((doc, *head, given, want))
        expected_rows += [(doc, k, *w) for k, w in enumerate(want)]
        heads.append((doc, *head))
        stages += [(doc, k, *s) for k, s in enumerate(given)]
    stage = "sol int, stage int, from_order int, to_order int, reasoning string, ok boolean, reason string"
    relation = sequence.check_transitions(
        spark.createDataFrame(heads, "doc_id string, verdict string, reason string, suggestion string"),
        spark.createDataFrame(stages, f"doc_id string, k long, {stage}"),
        spark.createDataFrame(expected_rows, "doc_id string, k long, sol int, from_order int, to_order int"),
    )
    want = {r.doc_id: (r.error, r.bad_sol, r.bad_from, r.bad_to) for r in relation.collect()}
    fields = stage.replace(" int", ":int").replace(" string", ":string").replace(" boolean", ":boolean").replace(", ", ",")
    df = spark.createDataFrame(docs, f"doc_id string, verdict string, reason string, suggestion string, stages array<struct<{fields}>>, expected array<struct<sol:int,from_order:int,to_order:int>>")
    one = df.select("doc_id", sequence.judged_transitions(F.struct("verdict", "reason", "suggestion", "stages"), F.col("expected")).alias("x"))
    got = {r.doc_id: (r.x.error, *((r.x.sol, r.x.from_order, r.x.to_order) if r.x.error is None else (None,) * 3)) for r in one.collect()}
    assert got == want and len({w[0] for w in want.values()}) > 7


def test_contexts_in_the_row_equal_the_relation(spark):
    doc = choice_object()
    item = doc["questionItems"][0]
    item["interactions"] += [{"id": "x2", "type": "essay", "config": {}, "display": {}}, {"id": "x3", "type": "short_answer", "config": {}}, 7]
    item["answerSpecs"].append({"interactionId": "x1", "type": "single_choice", "expected": {}})
    doc["questionItems"] += [5, {"id": "i2", "interactions": [{"id": "x3", "type": "short_answer"}]}]
    doc["answerSpecs"] = [{"interactionId": "x3", "expected": {"correctValue": "1"}}]
    docs = variants(spark, [("d", doc), ("empty", {}), ("list", [1])])
    relation = {(r.doc_id, r.iid, r.itype, r.spec_path, len(r.options or [])) for r in requests.anchor_contexts(docs).collect()}
    listed = docs.select("doc_id", F.explode(requests.context_list(F.col("doc"))).alias("c"))
    assert {(r.doc_id, r.c.iid, r.c.itype, r.c.spec_path, len(r.c.options or [])) for r in listed.collect()} == relation and len(relation) == 3


def test_decisions_over_pairs_keep_their_columns(spark):
    assert set(consensus.judge_decision()) == {"n_valid", "decision", "is_good", "confirmed", "is_runtime", "chosen_run", "from_order", "to_order"}
    assert set(consensus.resolver_decision()) == {"fallback_reason", "agreement", "fallback_called", "attempts", "used"}


@pytest.mark.parametrize("text", [["a = b", "x"], []])
def test_anchor_in_the_row(spark, text):
    doc = choice_object()
    doc["instruction"] = [block(t) for t in text]
    docs = variants(spark, [("d", doc)])
    from rubrica.operators import flatten

    want = [tuple(r)[1:] for r in sequence.problem_anchor(flatten.text_nodes(docs)).collect()]
    got = docs.select(sequence.anchor_of(flatten.text_nodes_of("doc")).alias("a")).first().a
    assert [tuple(got)] == want


def test_plans_that_join_hold_no_checks(spark, monkeypatch):
    """Spark plans again, on the driver, after each shuffle; what it plans then must be small, so documents and replies are checked apart from joins."""
    plans, cut = [], object_flow.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", ""))
        return cut(df)

    monkeypatch.setattr(object_flow, "cut_lineage", noted)
    docs = cut(variants(spark, [("d", choice_object())]))
    replies = cut(object_flow.answers(spark.createDataFrame(judged("d", **both(FINE)), LEDGER)))
    checked, _ = object_flow.check(docs, replies, Options())
    assert [r.is_good for r in checked.collect()] == [True]
    heavy = [p for p in plans if "variantget" in p or "parsejson" in p]
    assert heavy and [p[:300] for p in heavy if "join " in p] == []
