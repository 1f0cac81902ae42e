import numpy as np

from rubrica.llm import language_id

SF = "/root/testdata/sf0.01"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 30):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n
        assert (code.min(axis=0) == 0).all() and (code.max(axis=0) == 1).all()
    assert language_id.codewords(1).shape == (1, 0)
    distance = min((a != b).sum() for i, a in enumerate(language_id.codewords(4)) for b in language_id.codewords(4)[:i])
    assert distance == 4  # one wrong bit never decides


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.languages(docs.select("doc_id", "text", "lang")).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, None, "en", 1), (2, "12 !?", "en", 1), (3, "the cat", None, 1), (None, "le chat", "fr", 1), (4, "x " * 60_000, "en", 1), (4, "x", "en", 1)]
    out = language_id.languages(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2)] == [("und", 0.0)] * 2
    unlabelled = spark.createDataFrame([(1, "some text", None, 1)], schema)
    assert language_id.languages(unlabelled).first().lang_pred == "und"
    assert language_id.languages(unlabelled.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "some text", "en", 1) for i in range(9)], schema)
    assert {(r.lang_pred, r.score) for r in language_id.languages(one).collect()} == {("en", 1.0)}


def test_numbers_of_other_kinds_are_no_letters(spark):
    texts = ["²", "½ ①", "Ⅷ", "12 _ !", "語", "a"]
    rows = [(10 + i, t, None) for i, t in enumerate(texts)] + [(100 + i, "the cat and the dog", "en") for i in range(9)] + [(200 + i, "le chat et le chien", "fr") for i in range(9)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[10 + i] == ("und", 0.0) for i in range(6)] == [True] * 4 + [False] * 2
