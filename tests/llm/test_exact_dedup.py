import hashlib
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [(1, "Abc É"), (2, "aBC É"), (9, "abc é"), (3, None), (4, ""), (4, ""), (None, "x"), (None, "X"), (7, "x"), (None, "alone"), (5, "long " * 40_000), (6, "LONG " * 40_000)]
ROWS += [(100 + i, f"copy {i % 7}") for i in range(60)]


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string")
    out = exact_dedup.duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1000, 40_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    built = exact_dedup.build_filter(np.append(keys, keys[:1]))
    assert exact_dedup.may_contain(keys, *built).all()
    others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert exact_dedup.may_contain(others, *built).mean() < 0.012
    assert len(built[-1]) < 1.3 * n + 300 if n >= 1000 else True


def test_screen_lets_all_known_digests_through(spark):
    held = spark.range(3000).select(F.pmod("id", F.lit(2)).cast("int").alias("snapshot"), F.pmod("id", F.lit(3)).cast("int").alias("bucket"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    new = spark.range(2000, 6000).select(F.pmod("id", F.lit(3)).cast("int").alias("bucket"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    passed = exact_dedup.screen(new, exact_dedup.build_filters(held))
    assert passed.join(held, "digest", "left_semi").count() == 1000
    assert passed.count() < 1100


def test_keep_one_keeps_columns(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, keep_id string")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [r[0] for r in expected(ROWS) if r[3]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
