from collections import Counter, defaultdict

import pytest
from test_mixing import expected as mixed
from test_simhash import expected as near

import corpus_pipeline
from rubrica.llm import toxicity

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "a text without id", None, "src1", 3), (10**6 + 2, "word " * 30_000, "en", "src0", 9)]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    return given.unionByName(spark.createDataFrame(odd, given.schema)).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_toxicity(spark, docs):
    kept = STAGES["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in rows(docs) if model.score((r[1] or "").encode())[0] < 0.5]
    assert kept.columns == docs.columns and Counter(rows(kept)) == Counter(want)
    assert len(want) > 900


def test_exact(spark, docs):
    best = defaultdict(list)
    for r in rows(docs):
        best["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")].append(r)
    want = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in best.values()]
    assert Counter(rows(STAGES["exact dedup"](spark, docs, SF))) == Counter(want)


def test_near(spark, docs):
    some = docs.where("doc_id IS NULL OR doc_id % 7 < 2")
    data = rows(some)
    label = {d: c for d, _, c in near([(r[0], r[1]) for r in data])}
    want = [r for r in data if r[0] is None or r[0] == label[r[0]]]
    assert Counter(rows(STAGES["SimHash near-dedup"](spark, some, SF))) == Counter(want)


def test_mixing(spark, docs):
    got = Counter(r[0] for r in rows(STAGES["mixing sources"](spark, docs, SF)))
    taken = {d: (t, n) for d, n, _, _, t in mixed([(r[0], r[3], r[1]) for r in rows(docs)])}
    assert set(got) <= set(taken)
    for d, (t, n) in taken.items():
        assert (abs(got[d] - t / n) <= 0.5) if n else (got[d] == 1), (d, t, n, got[d])


def test_whole_run(spark):
    small = "/root/testdata/sf0.001"
    out = rows(corpus_pipeline.run(spark, small))
    kept = spark.read.parquet(f"{small}/documents.parquet")
    for stage in list(STAGES.values())[:-1]:
        kept = stage(spark, kept, small)
    times = Counter(r.doc_id for r in kept.select("doc_id").collect())
    lengths = {r[0]: r[4] for r in out}
    assert set(lengths) == set(times)
    assert Counter({d: n * lengths[d] for d, n in times.items()}) == sum((Counter({r[0]: r[2]}) for r in out), Counter())
