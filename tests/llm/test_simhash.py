import random

import xxhash
from pyspark.sql import functions as F

from rubrica.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def expected(rows):
    fps = [brute(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", ids.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    out = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.choice([2, 3, 60, 300]))]
        rows.append((i * 3, " ".join(words)))
        for k in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"x{k}"
            rows.append((1000 - len(rows), "\t".join(copy).upper()))
    rows += [(5000, None), (5001, ""), (5001, ""), (None, " \n"), (None, "a b c d e"), (7000, "é" * 3 + " w" * 30_000)]
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_split_buckets_connect_the_same(spark):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = {base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(400)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {tuple(r) for r in simhash.components(simhash.block_links(df)).collect()}
    split = {tuple(r) for r in simhash.components(simhash.block_links(df, part=50)).collect()}
    assert whole == split and len({r for _, r in whole}) == 1


def test_keep_one_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other words in here now", None), (None, "a b c d e f", "z")], "doc_id long, text string, component_id string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
