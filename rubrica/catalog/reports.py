"""Summaries and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.operators import consensus, issues as issue_ops, rollup, rules_object

STATUS = f"CASE min({rel.SEVERITY_RANK}) WHEN 0 THEN 'bad' WHEN 1 THEN 'needs_review' ELSE 'warning' END"


def rate(part, whole):
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round_even(CAST({part} AS DOUBLE) / {whole}, 4) END"


_COUNTS = {
    "calls": "count(*) FILTER (WHERE s_a > 0)",
    "fallbacks": "count(*) FILTER (WHERE s_a > 0 AND s_f)",
    "dual_runs": "count(*) FILTER (WHERE s_a > 0 AND s_r = 2)",
    "agreements": "count(*) FILTER (WHERE s_a > 0 AND s_r = 2 AND s_d = 'agreement')",
    "disagreements": "count(*) FILTER (WHERE s_a > 0 AND s_r = 2 AND s_d = 'disagreement')",
    "run_1_invalid": "count(*) FILTER (WHERE s_a > 0 AND s_r = 2 AND s_d = 'run_1_invalid')",
    "run_2_invalid": "count(*) FILTER (WHERE s_a > 0 AND s_r = 2 AND s_d = 'run_2_invalid')",
}


def _stage(s):
    return ", ".join(f"{c.replace('s_', s[0] + '_')} AS {s}_{n}" for n, c in _COUNTS.items())


def _rates(s):
    return (
        f"{rate(f'{s}_fallbacks', f'{s}_calls')} AS {s}_fallback_rate, {rate(f'{s}_agreements', f'{s}_dual_runs')} AS {s}_agreement_rate, "
        f"{rate(f'{s}_disagreements', f'{s}_dual_runs')} AS {s}_disagreement_rate"
    )


@query(
    "quality_summary",
    rel.with_sql(
        "q inter spec runs",
        f"SELECT *, {_rates('judge')}, {_rates('resolver')} FROM (SELECT count(*) AS total, count(*) FILTER (WHERE st = 'good') AS good, count(*) FILTER (WHERE st = 'bad') AS bad, "
        "count(*) FILTER (WHERE st = 'needs_review') AS needs_review, count(*) FILTER (WHERE st = 'warning') AS warning, count(*) FILTER (WHERE rs = 'repaired') AS repaired, "
        f"count(*) FILTER (WHERE rs = 'failed') AS repair_failed, bool_and(st = 'good') AS is_good, {_stage('judge')}, {_stage('resolver')} FROM r) t",
        found="SELECT doc_id, CASE WHEN itype IN ('essay', 'short_answer') THEN 'needs_review' ELSE 'bad' END AS severity FROM inter i WHERE NOT EXISTS "
        "(SELECT 1 FROM spec s WHERE s.doc_id = i.doc_id AND s.item = i.item AND s.ref_iid = i.iid) UNION ALL "
        "SELECT doc_id, 'bad' FROM spec s WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.doc_id = s.doc_id AND i.item = s.item AND i.iid = s.ref_iid) UNION ALL "
        "SELECT doc_id, 'bad' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, iid ORDER BY pos) AS n FROM inter) x WHERE n > 1",
        w="SELECT doc_id, pair, CASE WHEN v1 IS NULL THEN 'run_1_invalid' WHEN v2 IS NULL THEN 'run_2_invalid' WHEN v1 = v2 THEN 'agreement' ELSE 'disagreement' END AS d FROM "
        "(SELECT doc_id, pair, max(CASE WHEN run_no = 1 THEN verdict END) AS v1, max(CASE WHEN run_no = 2 THEN verdict END) AS v2 FROM runs GROUP BY doc_id, pair) p",
        g="SELECT doc_id, pair // 2 AS g, max(CASE WHEN pair % 2 = 0 THEN d END) AS jd, max(CASE WHEN pair % 2 = 1 THEN d END) AS zd FROM w GROUP BY 1, 2",
        r="SELECT q.doc_id, coalesce(f.st, 'good') AS st, CASE WHEN q.status = 'F' THEN 'repaired' WHEN q.status = 'P' THEN 'failed' ELSE 'skipped' END AS rs, "
        "CASE WHEN g.jd IS NULL THEN 0 WHEN g.jd IN ('agreement', 'disagreement') THEN 3 ELSE 4 END AS j_a, g.jd IN ('run_1_invalid', 'run_2_invalid') AS j_f, 2 AS j_r, g.jd AS j_d, "
        "CASE WHEN g.zd IS NULL THEN 0 WHEN g.zd = 'agreement' THEN 2 ELSE 3 END AS r_a, g.zd <> 'agreement' AS r_f, 2 AS r_r, g.zd AS r_d FROM q "
        f"LEFT JOIN (SELECT doc_id, {STATUS} AS st FROM found GROUP BY doc_id) f ON f.doc_id = q.doc_id LEFT JOIN g ON g.doc_id = q.doc_id",
    ),
)
def quality_summary(spark, sf):
    """Integrity issues of all documents, deduplicated, with the decisions over their runs, as one row.

    Pairs of runs alternate: even ones judge, odd ones resolve. A document counts once for each two pairs.
    """
    inter, spec, docs = rel.inter(spark, sf), rel.spec(spark, sf), rel.q(spark, sf)
    place = lambda id_: F.concat(F.lit("/"), "item", F.lit("/"), F.col(id_).cast("string"))
    found = (
        rules_object.missing_specs(inter, spec).select("doc_id", F.lit("answer_internal_consistency").alias("category"), "severity", place("iid").alias("location"), F.lit("no spec").alias("reason"))
        .unionByName(rules_object.orphan_specs(spec, inter).select("doc_id", F.lit("answer_internal_consistency").alias("category"), F.lit("bad").alias("severity"), place("ref_iid").alias("location"), F.lit("no interaction").alias("reason")))
        .unionByName(
            rules_object.repeated_interactions(rel.inter(spark, sf, with_pos=True)).select(
                "doc_id", F.lit("render_schema").alias("category"), F.lit("bad").alias("severity"), place("iid").alias("location"), F.lit("repeated id").alias("reason")
            )
        )
        .withColumns({"pos": F.lit(0), "suggestion": F.lit(""), "repair_intent": issue_ops.default_intent(F.col("category"))})
    )
    statuses = rollup.result_status(docs, issue_ops.canonical_issues(found))
    runs = rel.runs(spark, sf).select(
        "doc_id", "pair", "run_no", F.col("verdict").isNotNull().alias("valid"), F.col("verdict").alias("signature"), F.lit(False).alias("unsure")
    )
    decided = consensus.reconcile_resolver(runs, ["doc_id", "pair"])
    decision = F.when(F.col("agreement"), "agreement").otherwise(F.col("fallback_reason"))
    invalid = F.coalesce(F.col("fallback_reason").isin("run_1_invalid", "run_2_invalid"), F.lit(False))

    def of_pair(parity, name, called, attempts):
        """Columns of one stage from the row of its pair."""
        pick = lambda value: F.max(F.when(F.col("pair") % 2 == parity, value))
        return [
            pick(F.lit(attempts) + called.cast("int")).alias(f"{name}_attempts"),
            pick(called).alias(f"{name}_fallback"),
            pick(F.lit(2)).alias(f"{name}_runs"),
            pick(F.col("agreement")).alias(f"{name}_agreement"),
            pick(decision).alias(f"{name}_decision"),
        ]

    stages = decided.groupBy("doc_id", F.floor(F.col("pair") / 2).alias("turn")).agg(
        *of_pair(0, "judge", invalid, 3), *of_pair(1, "resolver", F.col("fallback_called"), 2)
    )
    repaired = docs.select(
        "doc_id",
        F.when(F.col("status") == "F", "repaired").when(F.col("status") == "P", "failed").otherwise("skipped").alias("repair_status"),
    )
    results = (
        statuses.join(stages, "doc_id", "left")
        .join(repaired, "doc_id")
        .withColumn("is_good", F.col("status") == "good")
    )
    return rollup.quality_summary(results)


def report_inputs(spark, sf):
    issues = rel.issues(spark, sf)
    docs = rel.q(spark, sf).select("doc_id", F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc|"), F.col("doc_id").cast("string"))).alias("id"))
    return rollup.result_status(docs, issues), issues


_ISS = "SELECT * FROM issues"


@query(
    "report_summary",
    rel.with_sql(
        "q issues",
        "SELECT count(*) AS total, count(*) FILTER (WHERE st = 'good') AS good, count(*) FILTER (WHERE st <> 'good') AS with_issues, count(*) FILTER (WHERE st = 'bad') AS bad, "
        "count(*) FILTER (WHERE st = 'needs_review') AS needs_review, count(*) FILTER (WHERE st = 'warning') AS warning, count(*) FILTER (WHERE doc_id % 3 = 0) AS repaired, "
        "0::BIGINT AS manual_review, count(*) FILTER (WHERE doc_id % 3 = 1) AS repair_failed, 7::BIGINT AS skipped FROM (SELECT q.doc_id, coalesce(s.st, CASE WHEN q.doc_id % 100 = 99 THEN 'bad' ELSE 'good' END) AS st "
        f"FROM q LEFT JOIN (SELECT doc_id, {STATUS} AS st FROM ({_ISS}) i GROUP BY doc_id) s ON s.doc_id = q.doc_id) t",
    ),
)
def report_summary(spark, sf):
    """Counts of a report; documents that are not good without any issue are bad; `skipped` is given."""
    statuses, _ = report_inputs(spark, sf)
    results = statuses.select(
        "doc_id",
        rollup.report_status(F.col("status"), F.col("doc_id") % 100 != 99).alias("status"),
        F.when(F.col("doc_id") % 3 == 0, "repaired").when(F.col("doc_id") % 3 == 1, "failed").otherwise("skipped").alias("repair_status"),
    )
    return rollup.report_summary(results, {"skipped": 7})


@query(
    "report_rows",
    rel.with_sql(
        "q issues",
        "SELECT q.doc_id + 1 AS row, 0::INT AS part, CASE WHEN q.doc_id % 2 = 0 THEN 'doc\\|' || q.doc_id ELSE 'item[' || q.doc_id || ']' END AS id, coalesce(s.st, 'good') AS status, 'skipped' AS repair, "
        "coalesce(l.issues, '') AS issues, coalesce(array_to_string(r.texts, '; '), '') AS reasons, coalesce(array_to_string(g.texts, '; '), '') AS suggestions FROM q "
        f"LEFT JOIN (SELECT doc_id, {STATUS} AS st FROM i GROUP BY doc_id) s ON s.doc_id = q.doc_id "
        "LEFT JOIN (SELECT doc_id, string_agg(label || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, '; ' ORDER BY pos) AS issues FROM (SELECT doc_id, category || '(' || severity || ')' AS label, min(pos) AS pos, count(*) AS n "
        "FROM i GROUP BY 1, 2) a GROUP BY doc_id) l ON l.doc_id = q.doc_id "
        "LEFT JOIN (SELECT doc_id, list(text ORDER BY pos) AS texts FROM (SELECT doc_id, reason AS text, min(pos) AS pos FROM i GROUP BY 1, 2) a GROUP BY doc_id) r ON r.doc_id = q.doc_id "
        "LEFT JOIN (SELECT doc_id, list(text ORDER BY pos) AS texts FROM (SELECT doc_id, trim(suggestion) AS text, min(pos) AS pos FROM i GROUP BY 1, 2) a GROUP BY doc_id) g ON g.doc_id = q.doc_id",
        i=_ISS,
    ),
)
def report_rows(spark, sf):
    statuses, issues = report_inputs(spark, sf)
    return rollup.report_rows(statuses.withColumn("repair_status", F.lit("skipped")), issues)


@query(
    "public_result",
    rel.with_sql(
        "q issues",
        "SELECT q.doc_id, q.status <> 'P' AS is_good, i.severity, i.category, i.location, i.reason, i.repair_intent FROM q LEFT JOIN i ON i.doc_id = q.doc_id",
        i=_ISS,
    ),
)
def public_result(spark, sf):
    docs = rel.q(spark, sf).select("doc_id", (F.col("status") != "P").alias("is_good"), F.lit(None).cast("string").alias("new_doc"))
    shown = rollup.public_result(docs, rel.issues(spark, sf))
    return shown.select("doc_id", "is_good", *[F.col(f"issue.{c}").alias(c) for c in ("severity", "category", "location", "reason", "repair_intent")])


@query(
    "public_result_debug",
    rel.with_sql(
        "q issues",
        "SELECT q.doc_id, CASE WHEN q.doc_id % 3 = 0 THEN 'failed' END AS repair_status, nullif(q.doc_id % 4, 0) AS loop_count, CASE WHEN q.doc_id % 3 = 0 THEN 'failed' END AS stop_reason "
        "FROM q LEFT JOIN issues i ON i.doc_id = q.doc_id",
    ),
)
def public_result_debug(spark, sf):
    failed = F.col("doc_id") % 3 == 0
    docs = rel.q(spark, sf).select(
        "doc_id",
        F.lit(True).alias("is_good"),
        F.lit(None).cast("string").alias("new_doc"),
        F.when(failed, "failed").otherwise("skipped").alias("repair_status"),
        (F.col("doc_id") % 4).alias("loop_count"),
        F.when(failed, "failed").otherwise("").alias("stop_reason"),
    )
    return rollup.public_result(docs, rel.issues(spark, sf), debug=True).select("doc_id", "repair_status", "loop_count", "stop_reason")
