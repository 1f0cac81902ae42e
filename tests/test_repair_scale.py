"""Documents are built and patched once a row, and what one row finds holds for all rows of its key."""

import pytest
from pyspark.sql import functions as F

from rubrica.catalog import queries
from rubrica.operators import repair


@pytest.mark.parametrize("name", ["accept_candidate", "guard_repaired_text"])
def test_documents_are_patched_once(spark, tmp_path, name):
    spark.range(20).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_one_bad_row_rejects_its_key(spark):
    """A key that comes twice is rejected by either row; rows without a key stand alone and are not rejected."""
    good = '{"instruction": [{"id": "b", "type": "text", "text": "Read."}], "questionItems": [{"id": "i", "stem": [], "interactions": [{"id": "x", "type": "essay", "config": {}, "display": {}}]}], "solutions": [1]}'
    rows = [(1, good, '{"a": 1}'), (1, good, good), (2, '{"a": 1}', '{"a": 1}'), (None, good, '{"a": 1}'), (3, good, None)]
    patched = spark.createDataFrame(rows, "doc_id int, old string, new string").select(
        "doc_id", F.parse_json("old").alias("doc"), F.try_parse_json("new").alias("new_doc"), F.when(F.col("new").isNull(), "add /a").alias("patch_error")
    )
    found = sorted(((r.doc_id, r.manual_reason) for r in repair.accept_candidates(patched).collect()), key=str)
    assert found == [(1, "invalid_after_patch"), (1, "unchanged"), (2, "unchanged"), (3, "patch_failed"), (None, None)]

    block = lambda s: '{"instruction": [{"id": "b", "type": "text", "text": "' + s + '"}]}'
    texts = [(1, block("Read."), block("Read .")), (1, block("Read."), block("Read.")), (None, block("Read."), block("Read .")), (2, block("Read ."), block("Read ."))]
    repaired = spark.createDataFrame(texts, "doc_id int, old string, new string").select(
        "doc_id", F.parse_json("old").alias("doc"), F.parse_json("new").alias("new_doc"), F.lit("repaired").alias("repair_status")
    )
    told = sorted(((r.doc_id, r.repair_status, r.n_text_issues) for r in repair.guard_repaired_text(repaired).collect()), key=str)
    assert told == [(1, "failed", 1), (1, "failed", 1), (2, "repaired", 0), (None, "repaired", 0)]
