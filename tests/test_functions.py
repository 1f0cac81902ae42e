import pytest
from pyspark.sql import functions as F

from rubrica.functions import pointers, text as t, variants as v


def values(spark, rows, make):
    """`make` over a column of texts, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select("i", make(F.col("s")).alias("x")).orderBy("i").select("x").collect()]


def test_to_pointer(spark):
    cases = {
        "$": "",
        "/$": "",
        "/$/a/b": "/a/b",
        "$/a": "/a",
        "$.a[0].b[1][2]": "/a/0/b/1/2",
        "generatedQuestion": "",
        "generatedQuestion.questionItems[0].stem": "/questionItems/0/stem",
        "generatedQuestions": "generatedQuestions",
        "input": "input",
        " /x ": "/x",
        "a[x]": "a[x]",
        "issues[3]": "/issues/3",
        None: "",
    }
    assert values(spark, list(cases), pointers.to_pointer) == list(cases.values())


def test_content_text_reads_any_depth_in_key_order(spark):
    cases = {
        '[{"text":" a "},{"content":[{"text":"b"},3,true,null,{"name":"n","label":"l"}]},"c"]': "a b 3 true l n c",
        '{"content": [{"content": [{"content": ["deep"]}]}], "id": "no"}': "deep",
        "null": "",
        '" q "': "q",
        "[]": "",
        '{"value": 0, "title": " "}': "0",
    }
    assert values(spark, list(cases), lambda s: v.content_text(F.parse_json(s))) == list(cases.values())


def test_math_round_trip_and_numbering(spark):
    rows = ["a $x$ b $$y$$ c ```z\n```", "none", "$1$$2$", "cost 5$", "".join(f"${i}$ " for i in range(12))]
    assert values(spark, rows, lambda s: t.restore_math(t.protect_math(s), t.math_segments(s))) == rows
    assert values(spark, rows[:1], t.protect_math) == ["a __MATH_SEGMENT_0__ b __MATH_SEGMENT_1__ c __MATH_SEGMENT_2__"]


def test_reply_parsing(spark):
    cases = {
        '{"a":1}': '{"a":1}',
        'so ```json\n{"b":2}\n``` there': '{"b":2}',
        'words {"c":{"d":1}} words': '{"c":{"d":1}}',
        '{"a":1}\n{"b":2}': None,
        '{"a":1} } ': None,
        "[1]": None,
        "plain": None,
        '```\n[1]\n``` {"z":1}': '{"z":1}',
    }
    assert values(spark, list(cases), lambda s: F.to_json(v.parse_reply(s))) == list(cases.values())


def test_presence_null_and_alias(spark):
    rows = ['{"a": null, "b": 2}', '{"b": 2}', '{"a": 1, "b": 2}']
    assert values(spark, rows, lambda s: F.to_json(v.present_alias(F.parse_json(s), "a", "b"))) == ["null", "2", "1"]
    truthy = ['"x"', '""', "0", "0.0", "false", "true", "[]", "{}", "null", '"0"', '"false"', "[1]"]
    got = values(spark, truthy, lambda s: v.truthy_text(F.parse_json(s)))
    assert got == ["x", None, None, None, None, "true", None, None, None, "0", "false", "[1]"]


def test_choices_take_config_first(spark):
    rows = ['{"config": {"answers": [1]}, "options": [2]}', '{"statements": [3]}', "{}", '{"config": [], "items": [4]}']
    assert values(spark, rows, lambda s: F.to_json(v.choices(F.parse_json(s)))) == ["[1]", "[3]", "[]", "[4]"]


def test_nodes_escape_keys_and_keep_order(spark):
    row = ['{"a": [1, {"b/c": "x"}], "z~": null}']
    got = values(spark, row, lambda s: F.transform(v.nodes(F.parse_json(s)), lambda n: F.concat_ws(" ", n["pointer"], n["kind"])))
    assert got == [["object", "/a array", "/a/0 integer", "/a/1 object", "/a/1/b~1c string", "/z~0 null"]] or got == [
        [" object", "/a array", "/a/0 integer", "/a/1 object", "/a/1/b~1c string", "/z~0 null"]
    ]
    assert values(spark, row, lambda s: F.to_json(v.at_pointer(F.parse_json(s), F.lit("/a/1/b~1c")))) == ['"x"']


def test_context_and_deepest_paths(spark):
    got = values(spark, ["/solutions/2/x"], lambda s: pointers.context_paths(F.lit("solution_quality"), s))
    assert got == [["/solutions/2/x", "/instruction", "/questionItems", "/solutions/2"]]
    got = values(spark, ["/a"], lambda s: pointers.deepest_paths(F.array(s, F.lit("/a/b"), F.lit("/ab"), F.lit("$.c"))))
    assert got == [["/a/b", "/ab", "/c"]]


@pytest.mark.parametrize("n, expected", [("0", 1), ("-4", 1), ("2", 2), ("9", 3), ("x", 3), (None, 3)])
def test_clamp(spark, n, expected):
    assert values(spark, [n], lambda s: t.clamp(s, 3)) == [expected]


def test_accentless_and_generic(spark):
    rows = ["the quick brown fox jumps over lazy dogs", "tính giá trị của biểu thức sau đây", "phương trình the quick brown fox jumps over lazy dogs", "too short"]
    assert values(spark, rows, lambda s: t.accentless_text(t.protect_math(s))) == [True, False, True, False]
    assert values(spark, ["clarity", "", "The second part is not planned"], lambda s: t.generic_summary(s, F.lit(""))) == [True, False, False]
