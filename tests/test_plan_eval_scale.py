"""Plain values need no walk, and replies are built behind a shuffle of keys."""

from pyspark.sql import functions as F

from rubrica.catalog import queries
from rubrica.functions import variants as v


def test_plain_values_are_their_text(spark):
    texts = {'" x "': "x", "1.50": "1.5", "true": "true", "null": "", '{"text": [" a ", {"label": 2}]}': "a 2", '["b", [], {}]': "b"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("x"))
    assert {r.t: r.c for r in rows.select("t", v.content_text(F.col("x")).alias("c")).collect()} == texts


def test_replies_are_dealt_out(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries()["plan_eval_from_reply"](spark, str(tmp_path))
    assert "RepartitionByExpression [event_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 50
