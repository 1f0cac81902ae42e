"""Issue operators over events as issues of forty documents, so each document holds very many."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica import dims
from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.operators import issues as ops, rollup, rules_object

KEY_SQL = "doc_id, category, location, repair_intent, lower(reason)"


@query(
    "drop_metadata_issues",
    rel.with_sql("issues", "SELECT doc_id, pos FROM issues WHERE pos % 6 IN (0, 5)"),
)
def drop_metadata_issues(spark, sf):
    found = rel.issues(spark, sf)
    spoiled = found.withColumns(
        {
            "category": F.when(F.col("pos") % 6 == 1, "difficulty_fit").otherwise(F.col("category")),
            "reason": F.when(F.col("pos") % 6 == 2, F.lit("The DIFFICULTY is off")).when(F.col("pos") % 6 == 3, F.lit("Độ khó sai")).otherwise(F.col("reason")),
            "location": F.when(F.col("pos") % 6 == 4, "/bloom").otherwise(F.col("location")),
        }
    )
    return ops.drop_metadata_issues(spoiled).select("doc_id", "pos")


@query(
    "blocking_strict",
    rel.with_sql("issues", "SELECT doc_id, count(*) AS n_blocking FROM issues GROUP BY doc_id"),
)
def blocking_strict(spark, sf):
    return ops.blocking_documents(rel.issues(spark, sf), strict=True)


@query(
    "blocking_lenient",
    rel.with_sql("issues", "SELECT doc_id, count(*) AS n_blocking FROM issues WHERE severity = 'bad' GROUP BY doc_id"),
)
def blocking_lenient(spark, sf):
    return ops.blocking_documents(rel.issues(spark, sf), strict=False)


@query(
    "structural_gate",
    rel.object_sql("SELECT k AS doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.k = d.k AND f.severity = 'bad')"),
)
def structural_gate(spark, sf):
    return rules_object.clear_documents(rel.objects(spark, sf)).select("doc_id")


def manual_issues(spark, sf):
    """As `issues`, with some solution problems left to a person, and documents whose solution problems are of another kind."""
    manual = (F.col("category") == "solution_quality") & (F.col("pos") % 4 == 0)
    found = rel.issues(spark, sf).withColumn("repair_intent", F.when(manual, dims.MANUAL).otherwise(F.col("repair_intent")))
    return relabelled(found, 3, "solution_quality", "pedagogical_quality")


def relabelled(found, every, category, other):
    """In every so many documents, issues of one category as issues of another, so that documents differ."""
    there = (F.col("doc_id") % every == 0) & (F.col("category") == category)
    return found.withColumn("category", F.when(there, other).otherwise(F.col("category")))


def relabelled_sql(every, category, other, name):
    return f"SELECT * REPLACE (CASE WHEN doc_id % {every} = 0 AND category = '{category}' THEN '{other}' ELSE category END AS category) FROM {name}"


MANUAL_SQL = (
    "SELECT doc_id, pos, severity, CASE WHEN doc_id % 3 = 0 AND category = 'solution_quality' THEN 'pedagogical_quality' ELSE category END AS category, "
    "location, reason, suggestion, CASE WHEN category = 'solution_quality' AND pos % 4 = 0 THEN 'needs_manual_review' ELSE repair_intent END AS repair_intent FROM issues"
)


@query(
    "solution_gate",
    rel.with_sql(
        "issues",
        f"SELECT doc_id, gate, pos FROM (SELECT doc_id, pos, {rel.GATE} AS gate, row_number() OVER (PARTITION BY doc_id ORDER BY {rel.GATE}, pos) AS n "
        f"FROM mi WHERE {rel.GATE} IS NOT NULL) t WHERE n = 1",
        mi=MANUAL_SQL,
    ),
)
def solution_gate(spark, sf):
    return ops.solution_gate(manual_issues(spark, sf)).select("doc_id", "gate", "pos")


@query(
    "select_repair_issue",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, category, repair_intent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, a, b, pos) AS n FROM ("
        f"SELECT *, CASE WHEN {rel.GATE} IS NOT NULL THEN 0 WHEN repair_intent IN ('align_fields_to_solution', 'align_hint_to_solution', "
        f"'clean_solution_reasoning', 'fix_schema') THEN 1 ELSE 2 END AS tier, coalesce({rel.GATE}, {rel.SEVERITY_RANK}) AS a, "
        f"CASE WHEN {rel.GATE} IS NOT NULL THEN 0 ELSE {rel.CATEGORY_RANK} END AS b FROM mixed) x) t WHERE n = 1",
        mi=MANUAL_SQL,
        mixed=relabelled_sql(4, "runtime", "render_schema", "mi"),
    ),
)
def select_repair_issue(spark, sf):
    mixed = relabelled(manual_issues(spark, sf), 4, "runtime", "render_schema")
    return ops.select_repair_issue(mixed).select("doc_id", "pos", "category", "repair_intent")


@query(
    "normalize_issues",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN 'needs_review' ELSE severity END AS severity, "
        "CASE WHEN pos % 7 = 0 THEN 'solution_anchor_consistency' WHEN pos % 7 = 1 THEN 'runtime' ELSE category END AS category, "
        "CASE WHEN pos % 3 = 0 THEN '/issues/' || pos ELSE location END AS location, "
        "CASE WHEN pos % 2 = 0 THEN 'The issue gives no clear reason.' ELSE reason END AS reason, "
        "CASE WHEN pos % 7 = 0 THEN 'align_fields_to_solution' WHEN pos % 7 = 1 THEN 'needs_manual_review' ELSE repair_intent END AS repair_intent FROM issues",
    ),
)
def normalize_issues(spark, sf):
    raw = rel.raw_issues(spark, sf).withColumns(
        {
            "severity": F.when(F.col("pos") % 5 == 0, "fatal").otherwise(F.col("severity")),
            "category": F.when(F.col("pos") % 7 == 0, "answer_validity").when(F.col("pos") % 7 == 1, "gossip").otherwise(F.col("category")),
            "location": F.when(F.col("pos") % 3 == 0, " ").otherwise(F.concat(F.lit("$"), "location")),
            "reason": F.when(F.col("pos") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "reason")),
        }
    )
    return ops.normalize_issues(raw).select("doc_id", "pos", "severity", "category", "location", "reason", "repair_intent")


@query("default_intent", rel.with_sql("issues", "SELECT doc_id, pos, category, repair_intent FROM issues"))
def default_intent(spark, sf):
    return rel.raw_issues(spark, sf).select("doc_id", "pos", "category", ops.default_intent(F.col("category")).alias("repair_intent"))


@query(
    "fail_closed",
    rel.with_sql("runs", "SELECT doc_id, 'runtime' AS category, 'needs_review' AS severity, 'invalid reply ' || event_id AS failed_reason FROM runs WHERE verdict IS NULL"),
)
def fail_closed(spark, sf):
    replies = rel.runs(spark, sf).withColumn(
        "error", F.when(F.col("verdict").isNull(), F.concat(F.lit("invalid reply "), F.col("event_id").cast("string")))
    )
    return ops.fail_closed(replies).select("doc_id", "category", "severity", "failed_reason")


@query(
    "merge_issues",
    rel.with_sql(
        "issues nodes",
        "SELECT source, severity, category, count(*) AS n FROM (SELECT 0 AS source, severity, category FROM issues "
        "UNION ALL SELECT 1, 'needs_review', 'spelling_wording' FROM nodes) t GROUP BY source, severity, category",
    ),
)
def merge_issues(spark, sf):
    """Rule issues and reply issues as one relation."""
    lines = rel.nodes(spark, sf).select(
        "doc_id",
        "pos",
        F.lit("unclear").alias("severity"),
        F.lit("spelling_wording").alias("category"),
        F.col("pointer").alias("location"),
        F.lit("check").alias("reason"),
        F.lit("").alias("suggestion"),
    )
    merged = ops.merge_issues(rel.raw_issues(spark, sf), lines)
    return merged.groupBy("source", "severity", "category").agg(F.count("*").alias("n"))


@query(
    "canonical_issues",
    rel.with_sql(
        "issues",
        "SELECT doc_id, category, location, repair_intent, min(pos) AS pos, count(*) AS n_merged, "
        f"CASE min({rel.SEVERITY_RANK}) WHEN 0 THEN 'bad' WHEN 1 THEN 'needs_review' ELSE 'warning' END AS severity, "
        "arg_min(reason, pos) AS reason, arg_min(trim(suggestion), length(trim(suggestion)) * 1000000000 + pos) AS suggestion "
        f"FROM issues GROUP BY {KEY_SQL}",
    ),
)
def canonical_issues(spark, sf):
    found = ops.canonical_issues(rel.issues(spark, sf))
    return found.select("doc_id", "category", "location", "repair_intent", "pos", "n_merged", "severity", "reason", "suggestion")


@query(
    "dedupe_issues",
    rel.with_sql(
        "issues",
        f"SELECT doc_id, pos, severity FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY pos) AS n FROM issues) t WHERE n = 1",
    ),
)
def dedupe_issues(spark, sf):
    return ops.dedupe_issues(rel.issues(spark, sf), ["pos", "severity"]).select("doc_id", "pos", "severity")


@query(
    "issue_order",
    rel.with_sql(
        "issues",
        f"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY {rel.SEVERITY_RANK}, {rel.CATEGORY_RANK}, pos) AS rank FROM issues",
    ),
)
def issue_order(spark, sf):
    return ops.issue_order(rel.issues(spark, sf), width=64).select("doc_id", "pos", "rank")


@query(
    "blocking_reasons",
    rel.with_sql(
        "issues",
        "SELECT doc_id, kind, text, CAST(min([turn, pos])[1] AS INT) AS turn, min([turn, pos])[2] AS pos FROM ("
        "SELECT doc_id, 'reason' AS kind, reason AS text, pos, 1 AS turn FROM issues WHERE severity = 'bad' "
        "UNION ALL SELECT doc_id, 'suggestion', suggestion, pos, 1 FROM issues i WHERE doc_id IN (SELECT doc_id FROM issues WHERE severity = 'bad') "
        "UNION ALL SELECT doc_id, 'reason', location, pos, 0 FROM issues UNION ALL SELECT doc_id, 'suggestion', suggestion, pos, 0 FROM issues WHERE severity <> 'bad') t "
        "GROUP BY doc_id, kind, text",
    ),
)
def blocking_reasons(spark, sf):
    """The documents bring places as reasons, and the suggestions of issues that do not block."""
    found = rel.issues(spark, sf)
    places = found.select("doc_id", F.lit("reason").alias("kind"), F.col("location").alias("text"), "pos")
    own = places.unionByName(found.filter(F.col("severity") != "bad").select("doc_id", F.lit("suggestion").alias("kind"), F.col("suggestion").alias("text"), "pos"))
    return ops.blocking_reasons(own, found, strict=False).select("doc_id", "kind", "text", "turn", "pos")


@query(
    "batch_reasons",
    rel.with_sql(
        "issues",
        "SELECT kind, text, min(pos) AS at FROM (SELECT 'reason' AS kind, reason AS text, pos FROM issues UNION ALL SELECT 'suggestion', suggestion, pos FROM issues) t GROUP BY kind, text",
    ),
)
def batch_reasons(spark, sf):
    found = rel.issues(spark, sf)
    long = found.select(
        "pos", F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("text")), F.struct(F.lit("suggestion").alias("kind"), F.col("suggestion").alias("text")))).alias("t")
    ).select("pos", "t.*")
    return rollup.batch_reasons(long, F.col("pos"))


@query(
    "result_status",
    rel.with_sql(
        "q issues",
        "SELECT q.doc_id, coalesce(s.status, 'good') AS status, coalesce(s.n, 0) AS n_issues FROM q LEFT JOIN (SELECT doc_id, count(*) AS n, "
        f"CASE min({rel.SEVERITY_RANK}) WHEN 0 THEN 'bad' WHEN 1 THEN 'needs_review' ELSE 'warning' END AS status FROM issues GROUP BY doc_id) s ON s.doc_id = q.doc_id",
    ),
)
def result_status(spark, sf):
    return rollup.result_status(rel.q(spark, sf).select("doc_id"), rel.issues(spark, sf))


@query(
    "repair_status",
    rel.with_sql(
        "q issues",
        "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'repaired' WHEN status = 'F' THEN 'failed' WHEN EXISTS (SELECT 1 FROM issues i "
        "WHERE i.doc_id = q.doc_id AND i.repair_intent = 'needs_manual_review') THEN 'needs_manual_review' ELSE 'skipped' END AS repair_status FROM q",
    ),
)
def repair_status(spark, sf):
    results = rel.q(spark, sf).select(
        "doc_id", (F.col("doc_id") % 5 == 0).alias("has_new_doc"), F.when(F.col("status") == "F", "failed").alias("repair_status")
    )
    return rollup.document_repair_status(results, rel.issues(spark, sf)).select("doc_id", "repair_status")
