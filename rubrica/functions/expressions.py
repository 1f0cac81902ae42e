"""Large expressions are built once per application.

Building a column is a call into the JVM per node, so an expression with thousands of nodes is kept and used again. Only
expressions over fixed column names can be kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

_BUILT: dict = {}


def built_once(build):
    @wraps(build)
    def get(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, build.__module__, build.__qualname__, args)
        if key not in _BUILT:
            _BUILT[key] = build(*args)
        return _BUILT[key]

    return get


def spread(df: DataFrame, keep: list, array: Column, name: str, pos: str = "__pos") -> DataFrame:
    """The columns `keep` with one row per element of the array; empty and NULL arrays give none.

    An inner explode adds a test of the list's size that is moved down to the scan, where it makes the list, and all it is made
    from, again in as few tasks as the table has row groups.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
    return rows.drop(pos) if pos == "__pos" else rows


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds, tested after what it reads is built.

    A filter on a plain column is moved below what builds it and repeats that for every use; one on a generated column is not.
    """
    return df.select(*df.columns, F.explode_outer(F.array(condition)).alias("__kept")).where("__kept").select(*df.columns)
