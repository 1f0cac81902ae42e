"""Hard negatives by segment summaries.

Every vector is cut into segments, coarse to fine, and the mean and the deviation of each segment are stored beside it. For two
vectors x and y with segments of width w, means m and deviations d, the inner product lies within

    sum of w * m_x * m_y   plus or minus   sum of w * d_x * d_y

since what is left of a segment without its mean has the length d * sqrt(w). So bounds of many scores are one product of two
short matrices. Rows that cannot be among an anchor's best are left out, the rest is bounded again by finer segments,
and only what the finest leave is scored exactly, in whole numbers.

Anchors, a stated query set, meet all rows in blocks: a task gets a block of rows and a block of anchors, both bounded, and returns
each anchor's best rows of that block; a block is dealt by a hash of the row, so labels or copies that a third of all rows
share are spread evenly. A first pass finds the positives; a second one, with their scores, the negatives below each.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors are compared
with those of their own number of components; rows that repeat a vec_id are rows of their own, and equal scores go by vec_id; an
anchor without positives, or a positive without negatives, has no rows; an empty table gives an empty result. Scores are exact at
any size; those beyond 64 bits are returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Segments of a vector, coarse to fine.
LEVELS = (1, 4, 16)
#: Anchors and rows of a block at most, but for the spread of a hash, and pairs bounded at a time.
ANCHORS, ROWS, PAIRS = 8192, 1 << 16, 1 << 21
#: Rows that are worth a block of their own, up to one block for each core.
LEAST_ROWS = 4096
WHOLE = 2.0**53
LONG = 2**63 - 1


def summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of vectors (n, dim), each times the root of the segment's width."""
    edges = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).round().astype(int)
    parts = [x[:, a:b] for a, b in zip(edges, edges[1:])]
    root = [max(p.shape[1], 1) ** 0.5 for p in parts]
    means = np.stack([p.mean(axis=1) * r if p.shape[1] else np.zeros(len(x)) for p, r in zip(parts, root)], axis=1)
    devs = np.stack([p.std(axis=1) * r if p.shape[1] else np.zeros(len(x)) for p, r in zip(parts, root)], axis=1)
    return means, devs


def _summarise(levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = np.asarray(vectors.value_lengths())
            flat, ends = np.asarray(vectors.flatten(), np.float64), np.cumsum(dims)
            q, s = [b""] * len(dims), [b""] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.floor(256 * flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                kept = np.concatenate([c for n in levels for c in summary(x, n)], axis=1)
                for k, row, short in zip(at, x, kept):
                    q[k], s[k] = row.tobytes(), short.tobytes()
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(q, pa.binary()), pa.array(s, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "q", "s"])

    return run


def summaries(embeddings: DataFrame, label: Column, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(rid, vec_id, label, dim, q, s) of the rows (vec_id, embedding) that take part: whole components and segment summaries."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.cast("array<double>").alias("vector"), sound.alias("sound"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND sound").drop("sound")
    kept = rows.mapInArrow(_summarise(levels), "vec_id long, label long, dim int, q binary, s binary")
    return cut_lineage(kept.withColumn("rid", F.monotonically_increasing_id()))


class _Block:
    """Rows or anchors of one block as arrays, by vec_id."""

    def __init__(self, t: pa.Table, levels: tuple[int, ...]):
        t = t.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        self.rid, self.vec_id, self.label = (t.column(c).to_numpy() for c in ("rid", "vec_id", "label"))
        n, dim = t.num_rows, t.column("dim")[0].as_py()
        self.q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.float64).reshape(n, dim)
        s = np.frombuffer(b"".join(t.column("s").to_pylist()), np.float64).reshape(n, -1)
        self.levels, at = [], 0
        for level in levels:
            width = min(level, max(dim, 1))
            self.levels.append((s[:, at : at + width], s[:, at + width : at + 2 * width]))
            at += 2 * width
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.most = np.abs(self.q).max(initial=0.0)


def bounds(a: _Block, b: _Block, at: slice, cols: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest that scores of anchors `at` with rows `cols` can be, a little wider than rounding needs."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    middle, spread = am[at] @ bm[cols].T, ad[at] @ bd[cols].T
    spread += np.outer(a.norm[at], b.norm[cols]) * 1e-9
    return middle - spread, middle + spread


def exact(a: _Block, b: _Block, at: slice, cols: np.ndarray) -> np.ndarray:
    """Whole scores: doubles while no sum can leave their whole numbers, else integers of any size."""
    if a.most * b.most * max(a.q.shape[1], 1) < WHOLE:
        return a.q[at] @ b.q[cols].T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a.q[at]) @ whole(b.q[cols]).T


def _kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of each row where the mask holds; minus infinity where fewer do."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(mask, values, -np.inf), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _refine(a: _Block, b: _Block, at: slice, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (their numbers) and a mask of pairs that may be among the k best scores within [low, high], windows (anchors, n).

    A pair goes when its window cannot hold it, or k others in the window are surely above it.
    """
    cols = np.flatnonzero(alive.any(axis=0))
    alive = alive[:, cols]
    for level in range(len(a.levels)):
        if not len(cols):
            break
        least, most = bounds(a, b, at, cols, level)
        wanted = np.zeros_like(alive)
        for lo, hi in zip(low.T[:, :, None], high.T[:, :, None]):
            sure = _kth(least, alive & (least >= lo) & (most <= hi), k)[:, None]
            wanted |= (most >= lo) & (least <= hi) & (most >= sure)
        alive &= wanted
        some = alive.any(axis=0)
        cols, alive = cols[some], alive[:, some]
    return cols, alive


def _chunks(a: _Block, b: _Block) -> Iterator[slice]:
    step = max(1, PAIRS // max(len(b.rid), 1))
    return (slice(i, i + step) for i in range(0, len(a.rid), step))


def _long(score) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


NEAREST = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
BELOW = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _nearest(levels: tuple[int, ...], k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            a, b = _Block(anchors, levels), _Block(rows, levels)
            for at in _chunks(a, b):
                alive = (a.label[at, None] == b.label) & (a.rid[at, None] != b.rid)
                any_score = np.full((len(alive), 1), np.inf)
                cols, alive = _refine(a, b, at, alive, -any_score, any_score, k)
                scores = exact(a, b, at, cols)
                for i, (mine, score) in enumerate(zip(alive, scores)):
                    here = cols[mine]
                    for n in np.argsort(-score[mine], kind="stable")[:k]:
                        r = here[n]
                        found.append((a.rid[at][i], a.vec_id[at][i], b.rid[r], b.vec_id[r], _long(score[mine][n])))
        return _table(found, NEAREST)

    return run


def _below(levels: tuple[int, ...], k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            a, b = _Block(anchors, levels), _Block(rows, levels)
            anchors = anchors.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
            given = [[int(p) for p in ps] for ps in anchors.column("positives").to_pylist()]
            most = max(map(len, given))
            # a window that holds nothing for places without a positive
            windows = [[(-(-low * p // 100), high * p // 100) for p in ps] + [(1, 0)] * (most - len(ps)) for ps in given]
            for at in _chunks(a, b):
                lows, highs = (np.array([[w[side] for w in ws] for ws in windows[at]], np.float64) for side in (0, 1))
                alive = a.label[at, None] != b.label
                cols, alive = _refine(a, b, at, alive, lows, highs, k)
                scores = exact(a, b, at, cols)
                for i, (mine, score) in enumerate(zip(alive, scores)):
                    here, score = cols[mine], score[mine]
                    order = np.argsort(-score, kind="stable")
                    falling = -score[order]
                    for nth, (lo, hi) in enumerate(windows[at][i]):
                        first, last = np.searchsorted(falling, -hi), np.searchsorted(falling, -lo, "right")
                        for n in order[first : min(last, first + k)] if lo <= hi else ():
                            found.append((a.rid[at][i], nth, b.rid[here[n]], b.vec_id[here[n]], _long(score[n])))
        return _table(found, BELOW)

    return run


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows, both as of `summaries`."""
    n_rows, n_anchors = rows.count(), anchors.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-n_rows // ROWS), min(cores, n_rows // LEAST_ROWS))
    anchor_blocks = max(1, -(-n_anchors // ANCHORS))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["dim", "row_block", "anchor_block"]
    all_rows = rows.withColumn("row_block", block(row_blocks)).withColumn("anchor_block", each(anchor_blocks)).groupBy(*keys)

    def meet(asked: DataFrame, function, schema: pa.Schema) -> DataFrame:
        own = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns apart from those of rows
        dealt = own.withColumn("anchor_block", block(anchor_blocks)).withColumn("row_block", each(row_blocks))
        columns = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in schema)
        return all_rows.cogroup(dealt.groupBy(*keys)).applyInArrow(function, columns)

    nearest = _best(meet(anchors, _nearest(levels, positives), NEAREST), ["anchor"], positives)
    nearest = cut_lineage(nearest.select("anchor", "anchor_id", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda p: p["positive_score"])
    asked = anchors.join(nearest.groupBy(F.col("anchor").alias("rid")).agg(scores.alias("positives")), "rid")
    below = _best(meet(asked, _below(levels, negatives, low, high), BELOW), ["anchor", "nth"], negatives)
    return below.join(nearest, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
