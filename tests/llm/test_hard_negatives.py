"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rubrica.llm import hard_negatives as hn


def brute_force(rows, anchor=lambda v: v % 5 == 0, positives=5, negatives=10):
    """rows: (vec_id, vector, label); by definition, with Python's integers."""
    sound = [(v, [math.floor(256 * float(np.float32(x))) for x in e], y) for v, e, y in rows if v is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (v, q, y) in enumerate(sound):
        if not anchor(v):
            continue
        others = [(sum(a * b for a, b in zip(q, r)), w, z) for j, (w, r, z) in enumerate(sound) if j != i and len(r) == len(q)]
        for ps, p, _ in sorted((o for o in others if o[2] == y), key=lambda o: (-o[0], o[1]))[:positives]:
            near = sorted((o for o in others if o[2] != y and 30 * ps <= 100 * o[0] <= 90 * ps), key=lambda o: (-o[0], o[1]))
            out += [(v, p, k + 1, w, ps, s) for k, (s, w, _) in enumerate(near[:negatives])]
    return sorted(out)


def mined(spark, rows, **given):
    df = spark.createDataFrame([(v, e, y, 1, "x", 2) for v, e, y in rows], "vec_id long, embedding array<float>, label int, q int, s string, rid int")
    kept = hn.summaries(df, F.col("label"))
    return sorted(map(tuple, hn.mine(kept, kept.where("vec_id % 5 = 0"), **given).collect()))


def vectors(rng, n, dim=12, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [0.4 * rng.gauss(0, 1) + c for c in centres[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = vectors(rng, 300)
    rows += [(1000 + i, [0.5] * 12, i % 3) for i in range(60)]  # ties
    rows += [(1005, [0.5] * 12, 1), (1005, [0.5] * 12, 1)]  # repeated rows
    rows += [(2000, None, 1), (2005, [0.1] * 12, None), (None, [0.1] * 12, 1), (2010, [float("nan")] * 12, 1), (2015, [float("inf")] * 12, 1), (2020, [None] * 12, 1)]
    rows += [(3000, [1.0, 2.0, 3.0], 1), (3001, [1.0, 2.0, 2.0], 1), (3002, [0.5, 1.0, 1.0], 2), (3005, [], 1), (3006, [], 2), (3010, [0.0] * 12, 0)]
    want = brute_force(rows)
    assert want and mined(spark, rows) == want


def test_many_blocks_find_the_same(spark, monkeypatch):
    rows = vectors(random.Random(6), 400)
    monkeypatch.setattr(hn, "ROWS", 60)
    monkeypatch.setattr(hn, "ANCHORS", 25)
    assert mined(spark, rows) == brute_force(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(1, 2) * 2.0**20 for _ in range(4)], i % 3) for i in range(60)]
    want = brute_force(rows)
    assert max(r[4] for r in want) > 2**53 and mined(spark, rows) == want


def test_empty_table(spark):
    assert mined(spark, []) == []


def block(x, labels=None):
    n = len(x)
    kept = [np.concatenate([c for s in hn.LEVELS for c in hn.summary(x[i : i + 1], s)], axis=1) for i in range(n)]
    t = pa.table({"rid": np.arange(n), "vec_id": np.arange(n), "label": np.zeros(n, np.int64), "dim": np.full(n, x.shape[1], np.int32), "q": [r.tobytes() for r in x], "s": [k.tobytes() for k in kept]})
    return hn._Block(t, hn.LEVELS)


@pytest.mark.parametrize("dim", [1, 3, 16, 50, 64])
def test_bounds_hold_and_finer_ones_are_closer(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * (rng.normal(size=(40, dim)) + np.repeat(rng.normal(size=(40, 1)), dim, axis=1)))
    b = block(x)
    at, cols, scores = slice(0, 40), np.arange(40), x @ x.T
    widths = []
    for level in range(len(hn.LEVELS)):
        low, high = hn.bounds(b, b, at, cols, level)
        assert (low <= scores).all() and (scores <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)


def test_segments_leave_pairs_out():
    """On vectors whose segments are nearly flat, all but a few pairs go before exact scores."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(500, 16)), 4, axis=1) + 0.01 * rng.normal(size=(500, 64))))
    b = block(x)
    alive = ~np.eye(20, 500, dtype=bool)
    window = np.full((20, 1), np.inf)
    cols, left = hn._refine(b, b, slice(0, 20), alive, -window, window, 5)
    assert left.sum() < 0.05 * alive.sum()
