"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target in words and a weight schedule over training time 0..1, piecewise linear. The integral of
the schedule, scaled to the target, is the source's cumulative demand. A source is read in a fixed pseudo-random order,
again from the start where the target exceeds it; a document that begins after c words of its source is met at the time
at which the demand reaches c, which is the inverse of the integral. Documents are then range-sorted by that time.

Running sums never run over a whole source: rows are ordered by a hash of doc_id, summed inside each prefix of the
hash, and offset by the sums of smaller prefixes. All of it is DataFrame work in the JVM.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last;
rows that repeat a doc_id are separate documents next to each other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import WORD
from rubrica.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Knots (time, weight) of the schedule of each class of weight: heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hex digits of the hash that make a prefix: 65,536 for each source.
PREFIX = 4


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    """(row, key, source, doc_id, size, h, prefix): row holds the carried columns, key the source, never null."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.struct(*carried).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        "source",
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        h.alias("h"),
        F.substring(h, 1, PREFIX).alias("prefix"),
    )


def segments(knots) -> list[tuple[float, ...]]:
    """(t0, w0, slope, area before) of each piece of a schedule, scaled to area 1."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    return [(t0, w0 / area, slope / area, before / area) for t0, w0, slope, before in pieces]


def time_of(share, pieces):
    """The time at which the integral of a schedule reaches a share of its whole."""
    at = F.element_at(F.filter(pieces, lambda p: p["before"] <= share), -1)
    rest = F.greatest(share - at["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(at["w0"] * at["w0"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.when(rest > 0, F.least(at["t0"] + 2 * rest / (at["w0"] + root), F.lit(1.0))).otherwise(at["t0"])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES) -> DataFrame:
    """(key, source_size, target, pieces), one row per source.

    Weights repeat over the sources in code point order. Targets share `share` of all words by weight; none exceeds
    `most` times its source. That level of filling is found by one pass over the sources in order of saturation.
    The windows run over one small row per source.
    """
    total = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = F.pmod(rank, F.lit(len(weights)))
    plan = total.withColumn("kind", kind).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("kind") + 1).cast("int")))
    plan = plan.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    plan = plan.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / onward)
    # Levels fall from the first source that is not saturated on, so the largest that fits is that source's.
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything), F.lit(0.0))
    shapes = F.array(*(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t0", "w0", "slope", "before"), p))) for p in segments(s))) for s in schedules))
    return plan.withColumn("target", F.least("cap", F.col("weight") * level)).select(
        "key", "source_size", "target", F.element_at(shapes, (F.pmod("kind", F.lit(len(schedules))) + 1).cast("int")).alias("pieces")
    )


def _placed(rows: DataFrame, narrow: DataFrame, **choices) -> DataFrame:
    """Rows with source_size, target, and begin: the words of the source that come before."""
    plan = targets(narrow, **choices)
    sums = narrow.groupBy("key", "prefix").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "prefix", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("key", "prefix").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return summed.join(offsets, ["key", "prefix"]).join(plan, "key").withColumn("begin", F.col("earlier") + F.col("inside"))


def _take(copy: int):
    left = F.floor("target") - F.col("begin") - F.lit(copy) * F.col("source_size")
    return F.least(F.col("size"), F.greatest(left, F.lit(0))).cast("long")


def _position(copy: int):
    share = (F.col("begin") + F.lit(copy) * F.col("source_size")) / F.col("target")
    return F.when(F.col("target") > 0, time_of(F.least(share, F.lit(1.0)), F.col("pieces"))).otherwise(F.lit(1.0))


def mix(docs: DataFrame, **choices) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) for every row, range-sorted by position.

    taken counts words with repeats: whole passes over the source, then its beginning up to the target.
    """
    rows = cut_lineage(sized(docs, "doc_id").drop("row"))
    taken = _take(0) + _take(1)
    return _placed(rows, rows, **choices).select("doc_id", "size", "source_size", "target", taken.alias("taken"), _position(0).alias("position")).orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, **choices) -> DataFrame:
    """The documents as training meets them: whole, up to two times, in the order of their positions.

    A copy of which the target covers at least half is in, whole; a document without words is in once.
    """
    narrow = cut_lineage(sized(docs, "doc_id").drop("row"))
    placed = _placed(sized(docs, *docs.columns), narrow, **choices)
    copies = F.array(*(F.struct((2 * _take(k) >= F.col("size")).alias("taken"), (F.col("size") > 0).alias("words"), F.lit(k).alias("copy"), _position(k).alias("position")) for k in (0, 1)))
    chosen = placed.select("row", F.inline(copies)).where("CASE WHEN words THEN taken ELSE copy = 0 END")
    return chosen.repartitionByRange("position", F.xxhash64("row.doc_id")).sortWithinPartitions("position").select("row.*")
