"""Order-dependent operators that never bring all rows of one key into one task.

A plain window over a key sends every row of that key to one task, and one key may hold a large share of a
table. Here the rows of a key are cut into buckets that follow the order (`bucket` columns); a window runs inside
each bucket, and only one small row per bucket is combined over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _bucketed(df: DataFrame, bucket: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__bucket{i}" for i in range(len(bucket))]
    return df.withColumns(dict(zip(names, bucket))), names


def quantile_bucket(df: DataFrame, value: str, parts: int = 256) -> Column:
    """The part of the whole table's order that a row is in, by quantiles of a numeric column.

    Buckets by a unit of the value, as a day, hold what one key has in that unit; these hold about a `parts`-th of all rows, so a
    key with a third of them is spread over a third of the buckets, wherever its rows lie. Rows of one value stay together.
    """
    bounds = df.select(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first().q or []
    return _bounds_below(F.col(value), sorted(set(bounds)))


def _bounds_below(value: Column, bounds: list, first: int = 0) -> Column:
    """`first` and the number of sorted bounds that are not above the value, by halving; 0 of them for NULL.

    Plain comparisons: Spark copies what defines a column to the other side of a join on it, and with it a lambda, whose
    own columns that side does not have.
    """
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value >= F.lit(bounds[half]), _bounds_below(value, bounds[half + 1 :], first + half + 1)).otherwise(
        _bounds_below(value, bounds[:half], first)
    )


def split_running_sum(
    df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of `value` over the rows of the key up to and including this one."""
    rows, names = _bucketed(df.withColumn("__value", value), bucket)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    totals = rows.groupBy(*keys, *names).agg(F.sum("__value").alias("__total"))
    before = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, *names, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    local = rows.withColumn(
        "__local", F.sum("__value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        local.join(offsets, [*keys, *names])
        .withColumn(name, F.col("__local") + F.col("__offset"))
        .drop("__local", "__offset", "__value", *names)
    )


def split_row_number(
    df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], name: str
) -> DataFrame:
    """1-based position of each row within its key."""
    return split_running_sum(df, keys, bucket, order, F.lit(1).cast("bigint"), name)


def split_lag(
    df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], cols: list[str], prefix: str
) -> DataFrame:
    """The named columns of the row before this one within its key, NULL on the first row."""
    rows, names = _bucketed(df, bucket)
    rows = rows.withColumn("__order", F.struct(*order))
    inside = Window.partitionBy(*keys, *names).orderBy("__order")
    carried = F.struct(*[F.col(c) for c in cols])
    ends = rows.groupBy(*keys, *names).agg(F.max_by(carried, "__order").alias("__end"))
    across = Window.partitionBy(*keys).orderBy(*names)
    carry = ends.select(*keys, *names, F.lag("__end").over(across).alias("__carry"))
    local = rows.withColumn("__prev", F.lag(carried).over(inside))
    previous = F.coalesce(F.col("__prev"), F.col("__carry"))
    return (
        local.join(carry, [*keys, *names])
        .withColumns({f"{prefix}{c}": previous[c] for c in cols})
        .drop("__prev", "__carry", "__order", *names)
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """The first row of each key as an aggregate, so that map tasks already reduce a frequent key."""
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark limits each group before the shuffle as well as after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n)


def joined_top(
    df: DataFrame, keys: list[str], order: list[Column], text: str, n: int, separator: str, name: str
) -> DataFrame:
    """The first n texts of each key as one string; each key contributes at most n rows."""
    top = top_rows(df, keys, order, n)
    listed = F.array_sort(F.collect_list(F.struct("__rank", text)))
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s[text]), separator).alias(name)
    )


def first_seen(df: DataFrame, keys: list[str], text: str, order: Column, name: str = "pos") -> DataFrame:
    """Distinct texts of each key with the position at which each was first seen."""
    return df.filter(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.min(order).alias(name))


def pieces(
    df: DataFrame, keys: list[str], text: str, bucket: list[Column], order: list[Column], name: str, size: int = 1000
) -> DataFrame:
    """Texts of each key in order as pieces (…, part, name ARRAY) of at most `size` texts; buckets follow the order.

    Texts are numbered bucket by bucket and gathered piece by piece, so a list of any length is whole and no task or
    buffer holds more of it than a piece.
    """
    numbered = split_row_number(df, keys, bucket, order, "__n")
    part = F.floor((F.col("__n") - 1) / size).cast("int")
    gathered = numbered.groupBy(*keys, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("__n", text))).alias("__listed"))
    return gathered.select(*keys, "part", F.transform("__listed", lambda x: x[text]).alias(name))


def ordered_pieces(
    df: DataFrame, keys: list[str], text: str, pos: str, name: str, size: int = 1000, width: int = 1 << 16
) -> DataFrame:
    """Pieces in order of position, numbered in buckets of `width` positions."""
    at = F.col(pos).cast("bigint")
    return pieces(df, keys, text, [F.floor(at / width)], [at, F.col(text)], name, size)


def sorted_pieces(df: DataFrame, keys: list[str], text: str, name: str, size: int = 1000) -> DataFrame:
    """Pieces in order of the texts themselves, numbered in buckets of texts that begin alike."""
    return pieces(df, keys, text, [F.left(text, F.lit(2))], [F.col(text)], name, size)
