import random

import pytest

from rubrica.llm import substrings

W = 20


def brute(rows):
    first, out = {}, []
    docs = [(d if d is not None else substrings.LAST, d, (t or "").encode().split()) for d, t in rows]
    for doc, _, w in docs:
        for i in range(len(w) - W + 1):
            k = tuple(w[i : i + W])
            first[k] = min(first.get(k, (doc, i)), (doc, i))
    for doc, d, w in docs:
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] < (doc, i):
                gone.update(range(i, i + W))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(15, 70))] for _ in range(8)]
    out = []
    for i in range(70):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [word() for _ in range(rng.randint(0, 40))] + rng.choice(passages)
        out.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t "]).join(w)))
    out += [(20_000, "x " * 300), (20_001, "x " * 25), (20_002, "a b " * 5000), (20_003, None), (20_003, ""), (None, out[0][1]), (None, out[1][1])]
    out += [(30_000, out[2][1]), (30_000, out[2][1]), (30_001, " ".join(passages[0]) + " " + " ".join(passages[0]))]
    out += [(40_000 + i, " ".join(passages[1] + [f"end{i}"])) for i in range(40)]
    return out


@pytest.mark.parametrize("bits, often", [(substrings.BITS, substrings.OFTEN), (6, 4096), (substrings.BITS, 1), (substrings.BITS, 20), (6, 20)])
def test_equals_brute_force(spark, bits, often):
    data = rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, doc int").repartition(5)
    got = sorted((tuple(r)[:3] + (bytes(r.kept),) for r in substrings.without_repeats(df, bits=bits, often=often).collect()), key=repr)
    assert got == brute(data)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_minimizer_sends_one_row_of_a_window(spark):
    """The edge of a passage that all documents share: runs differ, so none is settled whole, but windows are."""
    shared = " ".join(f"s{i}" for i in range(30))
    df = spark.createDataFrame([(i, " ".join(f"a{i}x{k}" for k in range(25)) + " " + shared) for i in range(400)], "doc_id long, text string").coalesce(1)
    few, many = ([tuple(r) for r in substrings.without_repeats(df, often=often).select("doc_id", "n_words", "n_removed").collect()] for often in (1, 10_000))
    assert sorted(few) == sorted(many) == [(i, 55, 30 if i else 0) for i in range(400)]
    maps = spark.sparkContext.broadcast(substrings.repeated_minimizers(df, often=1))
    runs = substrings.keyed(df).select("doc", "tag", "text").mapInArrow(substrings._runs(W, substrings.KMER, substrings.BITS, maps), substrings.RUN)
    assert runs.where("marked = 0").groupBy("m").count().selectExpr("max(count)").first()[0] == 1
