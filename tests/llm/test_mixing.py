import hashlib
import re
from collections import defaultdict

from rubrica.llm import mixing

ROWS = [(i, f"s{i % 4}" if i % 9 else None, "w " * (i * 7 % 50)) for i in range(120)]
ROWS += [(500, "hot", "a\tb\n" * 4000), (501, "hot", None), (501, "hot", None), (None, "s1", "x y"), (None, "s1", "x y z"), (502, "\U0001f600", ""), (503, "tiny", "one"), (504, "tiny", "two words")]


def expected(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for d, s, t in rows]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped = dict.fromkeys(names, 0.0), set()
    left = 1.5 * sum(total.values())
    while True:  # as the rule is worded: what exceeds twice a source goes to the others by weight
        rest = sum(weight[s] for s in names if s not in capped)
        for s in names:
            goal[s] = 2.0 * total[s] if s in capped else left * weight[s] / rest
        over = {s for s in names if s not in capped and goal[s] > 2.0 * total[s]}
        if not over:
            break
        capped |= over
        left -= sum(2.0 * total[s] for s in over)
    out, at = [], defaultdict(int)
    key = lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or -1, r[2])
    for d, s, n in sorted(sized, key=key):
        taken = sum(max(0, min(n, int(goal[s] + 1e-9) - k * total[s] - at[s])) for k in (0, 1))
        at[s] += n
        out.append((d, n, total[s], round(goal[s], 6), taken))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, s, t, 1) for d, s, t in rows], "doc_id long, source string, text string, size int")


def test_equals_brute_force(spark):
    out = mixing.mix(frame(spark, ROWS))
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in out.collect()), key=repr)
    assert got == expected(ROWS)
    assert all(r[4] <= 2 * r[1] for r in got)


def test_equals_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()), key=repr)
    want = expected(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 and g[3] >= 0 for g, w in zip(got, want))


def test_positions_follow_the_schedules(spark):
    rows = mixing.mix(frame(spark, ROWS)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(0 <= r.position <= 1 for r in rows)


def test_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        pieces = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t0", "w0", "slope", "before"), p))) for p in mixing.segments(knots)))
        got = spark.range(0, 101).select(F.col("id") / 100, mixing.time_of(F.col("id") / 100, pieces)).collect()
        for share, t in got:
            area = sum(b + w0 * (min(t, t1) - t0) + slope * (min(t, t1) - t0) ** 2 / 2 - b for (t0, w0, slope, b), t1 in zip(mixing.segments(knots), [k[0] for k in knots[1:]]) if t > t0)
            assert abs(area - share) < 1e-9


def test_empty_table_and_documents(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    docs = frame(spark, ROWS)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    del times[None], times[501]  # ids of two rows
    assert max(times.values()) == 2 and times[502] == 1
