from pyspark.sql import functions as F

from rubrica.catalog import replies
from rubrica.operators import ordering


def test_pairs_of_runs_over_buckets_of_time(spark, tmp_path):
    """Rows are numbered in buckets of time and joined to one row a bucket; every event is in one pair."""
    events = spark.range(40_000).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp_micros(id * 7919 * 1000000 % 2592000000000)").cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 700).alias("user_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]), (F.col("id") % 5).cast("int") + 1).alias("event_type"),
        (F.col("id") / 7).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id").cast("string"), F.lit("}")).alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = replies.pair_runs(spark, str(tmp_path))
    assert found.agg(F.sum("n_runs"), F.max("n_runs"), F.count("*")).first()[:] == (40_000, 2, 700 * 29)


def test_quantile_bucket_follows_the_order(spark):
    """Buckets are no list function, whose lambda Spark would copy to the side of a join that lacks its columns."""
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id") % 97).alias("at"))
    bucket = ordering.quantile_bucket(rows, "at", 16)
    assert "filter(" not in str(bucket)
    found = rows.withColumn("b", bucket).groupBy("b").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("b").collect()
    assert [r.b for r in found] == list(range(len(found))) and len(found) > 10
    assert all(x.hi < y.lo for x, y in zip(found, found[1:]))
    assert rows.where("at IS NULL").select(bucket.alias("b")).first().b == 0
