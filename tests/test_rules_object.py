import pytest
from fixtures import block, changed, choice_object, object_of, variants

from rubrica.operators import rules_object

ITEM = ["questionItems", 0]
INTER = ITEM + ["interactions", 0]
SPEC = ITEM + ["answerSpecs", 0]


def c(path, value=..., drop=False):
    return changed(choice_object(), path, value, drop)


def essay(**more):
    doc = object_of("essay", None, **more)
    doc["questionItems"][0]["answerSpecs"] = []
    doc["questionItems"][0]["stem"] = [block("Explain in full sentences why this holds.")]
    return doc


def many(ids):
    doc = choice_object()
    doc["questionItems"][0]["interactions"][0]["type"] = "multiple_choice"
    spec = doc["questionItems"][0]["answerSpecs"][0]
    spec["type"], spec["expected"] = "multiple_choice", {"correctOptionIds": ids}
    return doc


def coordinate(dimensions=2, slot="p"):
    return object_of(
        "coordinate_input",
        {"coordinates": [{"slotId": slot}]},
        {"dimensions": dimensions, "slots": [{"id": "p"}]},
    )


def two_interactions(second):
    doc = choice_object()
    doc["questionItems"][0]["interactions"].append(second)
    return doc


def no_items_no_instruction():
    doc = choice_object()
    del doc["instruction"], doc["questionItems"]
    return doc


OPTIONS = INTER + ["config", "options"]
SAME = {"id": "x1", "type": "single_choice", "config": {"options": [{"id": "A"}, {"id": "B"}]}, "display": {}}

# name: (document, expected sorted rule codes)
CASES = {
    "valid": (choice_object(), []),
    "scalar document": (7, ["G01"]),
    "null document": (None, ["G01"]),
    "no instruction": (c(["instruction"], drop=True), ["G02"]),
    "null instruction": (c(["instruction"], None), ["G02"]),
    "text instruction": (c(["instruction"], "x"), ["G03"]),
    "scalar block": (c(["instruction", 0], "x"), ["G04"]),
    "block id": (c(["instruction", 0, "id"], " "), ["G05"]),
    "block type": (c(["instruction", 0, "type"], drop=True), ["G06"]),
    "blank text": (c(["instruction", 0, "text"], "  "), ["G07"]),
    "blank solution text is allowed": (c(["solutions", 0, "solutionContent", 0, "text"], ""), []),
    "graph without display": (c(ITEM + ["stem", 0], {"id": "g", "type": "graph"}), ["G08"]),
    "solutions shape": (c(["solutions"], {}), ["G09"]),
    "solution shape": (c(["solutions", 0], 3), ["G10"]),
    "no items": (c(["questionItems"], []), ["G11"]),
    "nothing": (no_items_no_instruction(), ["G02", "G11", "G12"]),
    "item shape": (c(ITEM, 5), ["G13"]),
    "item id": (c(ITEM + ["id"], ""), ["G14"]),
    "stem": (c(ITEM + ["stem"], drop=True), ["G15"]),
    "hints shape": (c(ITEM + ["hints"], "h"), ["G16"]),
    "hint shape": (c(ITEM + ["hints", 0], "h"), ["G17"]),
    "hint block": (c(ITEM + ["hints", 0, "content", 0, "id"], None), ["G05"]),
    "no interactions stops the item": (c(ITEM + ["interactions"], []), ["G18"]),
    "interaction shape": (two_interactions(4), ["G19"]),
    "interaction id": (c(INTER + ["id"], ""), ["G20", "G33"]),
    "alias of interaction id": (changed(c(INTER + ["id"], drop=True), INTER + ["interactionId"], "x1"), []),
    "repeated interaction": (two_interactions(SAME), ["G21"]),
    "interaction type": (c(INTER + ["type"], drop=True), ["G22"]),
    "unknown type": (c(INTER + ["type"], "riddle"), ["G23", "G35"]),
    "config": (c(INTER + ["config"], []), ["G24", "G26"]),
    "display": (c(INTER + ["display"], drop=True), ["G25"]),
    "no options": (c(OPTIONS, []), ["G26"]),
    "one option": (c(OPTIONS, [{"id": "A", "text": "a"}]), ["G27"]),
    "repeated option ids": (c(OPTIONS + [1, "id"], "A"), ["G28"]),
    "option without id": (c(OPTIONS + [1, "id"], ""), ["G29"]),
    "option text ignoring case": (c(OPTIONS + [1, "content", 0, "text"], "FIVE"), ["G30"]),
    "no spec": (c(ITEM + ["answerSpecs"], []), ["G31"]),
    "document level spec": (
        changed(c(ITEM + ["answerSpecs"], []), ["answerSpecs"], choice_object()["questionItems"][0]["answerSpecs"]),
        [],
    ),
    "spec shape": (c(SPEC, 4), ["G31", "G32"]),
    "orphan spec": (c(SPEC + ["interactionId"], "zz"), ["G31", "G33"]),
    "spec without reference": (c(SPEC + ["interactionId"], ""), ["G31", "G34"]),
    "spec type": (c(SPEC + ["type"], "ordering"), ["G35"]),
    "single without answer": (c(SPEC + ["expected"], {}), ["G36"]),
    "single with two answers": (c(SPEC + ["expected"], {"correctOptionId": ["A", "B"]}), ["G37"]),
    "single with unknown answer": (c(SPEC + ["expected"], {"correctOptionId": "E"}), ["G38"]),
    "answers at any depth": (c(SPEC + ["expected"], [{"deep": {"correctOptionId": "A"}}]), []),
    "multi without answers": (many([]), ["G39"]),
    "multi with one answer": (many(["A"]), ["G40"]),
    "multi with unknown answers": (many(["A", "E", "F"]), ["G41", "G41"]),
    "true false without boolean": (object_of("true_false", {"value": "yes"}), ["G42"]),
    "true false": (object_of("true_false", {"value": False}), []),
    "short answer without value": (object_of("short_answer", {"x": 1}), ["G43"]),
    "short answer with empty value": (object_of("short_answer", [{"correctValue": ""}]), []),
    "dimensions zero": (coordinate(0), ["G44"]),
    "dimensions text": (coordinate("2"), ["G44"]),
    "dimensions null": (coordinate(None), []),
    "unknown slot": (coordinate(2, "r"), ["G45"]),
    "essay with solution": (essay(), []),
    "essay with nothing": (essay(solutions=[]), ["G31", "G47"]),
    "essay with rubric": (essay(solutions=[], rubric={"points": 3}), []),
    "short essay stem": (changed(essay(), ITEM + ["stem"], [block("Explain.")]), ["G46"]),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = variants(spark, [(name, doc) for name, (doc, _) in CASES.items()])
    rows = rules_object.check_object(docs).orderBy("doc_id", "ord").collect()
    out = {}
    for row in rows:
        out.setdefault(row.doc_id, []).append(row)
    return out


@pytest.mark.parametrize("name", CASES)
def test_rule(found, name):
    assert sorted(r.rule for r in found.get(name, [])) == CASES[name][1]


def test_severity_and_location(found):
    spec = found["no spec"][0]
    assert (spec.severity, spec.location) == ("bad", "/questionItems/0/answerSpecs")
    assert {r.severity for r in found["essay with nothing"]} == {"needs_review"}
    assert found["option text ignoring case"][0].location == "/questionItems/0/interactions/0/config/options"
    assert found["repeated interaction"][0].location == "/questionItems/0/interactions/1"
    assert [r.rule for r in found["nothing"]] == ["G02", "G11", "G12"]


def test_rollup_and_summary(spark):
    docs = variants(spark, [("a", choice_object()), ("b", c(["questionItems"], [])), ("c", c(["instruction"], None))])
    rollup = rules_object.check_object_rollup(docs)
    assert "Exchange" not in rollup._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.n_items, r.n_interactions, r.n_issues, r.n_bad, r.valid) for r in rollup.collect()}
    assert got == {"a": (1, 1, 0, 0, True), "b": (0, 0, 1, 1, False), "c": (1, 1, 1, 0, True)}
    total = rules_object.check_objects_summary(rollup).first()
    assert tuple(total) == (3, 2, 2, 2, 1, False)
    counts = rules_object.payload_counts(docs).first()
    assert tuple(counts) == (3, 2, 2, 2)
