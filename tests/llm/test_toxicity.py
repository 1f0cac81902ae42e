import random
import zlib

import numpy as np

from rubrica.llm import toxicity

SF = "/root/testdata/sf0.1"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_index_is_exact():
    rng = np.random.default_rng(1)

    def one():
        at = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        return at, w / np.linalg.norm(w)

    examples = [one() for _ in range(700)]
    index = toxicity.BlockMaxIndex(examples, rng.integers(0, 2, 700), np.ones(700), 40)
    dense = np.zeros((700, 40))
    for row, i in enumerate(index.order):
        dense[row, examples[i][0]] = examples[i][1]
    for _ in range(60):
        at, w = one()
        cosines = dense[:, at] @ w
        _, got = index.nearest(at, w)
        assert np.allclose(got, np.sort(cosines)[::-1][: toxicity.NEAREST])


def test_held_out_rows(spark):
    out = toxicity.toxicity(table(spark, "documents").select("doc_id", "text"), table(spark, "labels"))
    truth = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    rows = out.collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    found = [p for p, t in held if t]
    assert sum(found) / len(found) > 0.7


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (2, "you moron", 2.0), (None, "x", 1.0), (7, "word " * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 5
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_evidence_and_filter(spark):
    rng = random.Random(1)
    words = ["stone", "river", "cloud", "tree", "house", "green"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" grumblefritz" if i % 3 == 0 else "")) for i in range(300)]
    docs.append((1000, "a GRUMBLEfritz here"))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.evidence(df, model).collect()}
    assert "grumblefritz" in got[1000].features and got[1000].examples and got[1000].score > 0.5
    clean = toxicity.clean_documents(df, labels)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(300) if i % 3]
