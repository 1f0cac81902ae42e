"""Run registered queries and their SQL over the same tables and compare the results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def family(dtype: str) -> str:
    low = dtype.lower()
    if low.startswith(("varchar", "string")):
        return "text"
    if low.startswith("bool"):
        return "boolean"
    if low.startswith(("double", "float", "decimal")):
        return "number"
    if low.startswith(("bigint", "int", "hugeint", "smallint", "tinyint", "long")):
        return "integer"
    return low


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    """None when equal, else what differs."""
    start = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(got), seconds
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    types = {c[0]: family(str(c[1])) for c in cursor.description}
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), seconds
    mine = {n: family(t) for n, t in df.dtypes}
    off = {n: (mine[n], types[n]) for n in mine if mine[n] != types[n]}
    if off and want:
        return f"types {off}", len(got), seconds
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got), seconds
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} != {y}", len(got), seconds
    return None, len(got), seconds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    sqls = entry.oracle_sql()
    con = connect(sf)
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, seconds = compare(session, con, name, run, sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            problem, n, seconds = "ERROR " + str(exc)[:700], -1, 0
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={n} {seconds:.1f}s {'' if name in sqls else '(rows only) '}{(problem or '')[:900]}", flush=True)
