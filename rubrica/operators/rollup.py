"""Statuses, batch summaries and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import text as t
from rubrica.operators import issues as issue_ops, ordering


def worst_status(issues: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The most severe status of each group; an unknown one counts as much as a warning."""
    rank = t.lookup(dims.PLAN_STATUS_RANK, F.col(status), dims.UNKNOWN_STATUS_RANK)
    return issues.groupBy(*keys).agg(F.max_by(status, rank).alias("worst"), F.max(rank).alias("worst_rank"))


def severity_status(rank: Column) -> Column:
    return t.lookup({0: "warning", 1: "needs_review", 2: "bad"}, rank, "good")


def result_status(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Status of every document by its most severe issue; good where there is none."""
    worst = issues.groupBy("doc_id").agg(
        F.max(issue_ops.severity_strength(F.col("severity"))).alias("rank"), F.count("*").alias("n_issues")
    )
    return documents.join(worst, "doc_id", "left").withColumns(
        {
            "status": severity_status(F.coalesce("rank", F.lit(-1))),
            "n_issues": F.coalesce("n_issues", F.lit(0).cast("bigint")),
        }
    ).drop("rank")


def report_status(status: Column, is_good: Column) -> Column:
    """As in reports: without any issue a document that is not good is bad."""
    return F.when((status == "good") & ~is_good, "bad").otherwise(status)


def repair_status(has_new_doc: Column, status: Column, any_manual: Column) -> Column:
    return (
        F.when(has_new_doc, "repaired")
        .when(status.isin("failed", dims.MANUAL), status)
        .when(any_manual, dims.MANUAL)
        .otherwise("skipped")
    )


def document_repair_status(results: DataFrame, issues: DataFrame) -> DataFrame:
    """results: (doc_id, has_new_doc, repair_status)."""
    manual = issues.groupBy("doc_id").agg(
        F.bool_or(F.col("repair_intent") == dims.MANUAL).alias("any_manual")
    )
    return results.join(manual, "doc_id", "left").withColumn(
        "repair_status",
        repair_status(
            F.col("has_new_doc"),
            F.coalesce("repair_status", F.lit("")),
            F.coalesce("any_manual", F.lit(False)),
        ),
    ).drop("any_manual")


STAGES = ("judge", "resolver")


def quality_summary(results: DataFrame) -> DataFrame:
    """One row of totals and rates over all results.

    Per stage s: s_attempts, s_fallback, s_runs, s_agreement, s_decision, where the decision is one of agreement,
    disagreement, run_1_invalid and run_2_invalid.
    """
    status = F.col("status")
    aggs = [
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("good", "bad", "needs_review", "warning")],
        F.count_if(F.col("repair_status") == "repaired").alias("repaired"),
        F.count_if(F.col("repair_status") == "failed").alias("repair_failed"),
        (F.count_if(~F.col("is_good")) == 0).alias("is_good"),
    ]
    for s in STAGES:
        called = F.col(f"{s}_attempts") > 0
        dual = called & (F.col(f"{s}_runs") == 2)
        agreed = F.coalesce(F.col(f"{s}_agreement"), F.lit(False))
        aggs += [
            F.count_if(called).alias(f"{s}_calls"),
            F.count_if(called & F.col(f"{s}_fallback")).alias(f"{s}_fallbacks"),
            F.count_if(dual).alias(f"{s}_dual_runs"),
            F.count_if(dual & agreed).alias(f"{s}_agreements"),
            *[
                F.count_if(dual & ~agreed & (F.col(f"{s}_decision") == d)).alias(f"{s}_{name}")
                for d, name in (
                    ("disagreement", "disagreements"),
                    ("run_1_invalid", "run_1_invalid"),
                    ("run_2_invalid", "run_2_invalid"),
                )
            ],
        ]
    rates = {}
    for s in STAGES:
        rates[f"{s}_fallback_rate"] = t.rate(F.col(f"{s}_fallbacks"), F.col(f"{s}_calls"))
        rates[f"{s}_agreement_rate"] = t.rate(F.col(f"{s}_agreements"), F.col(f"{s}_dual_runs"))
        rates[f"{s}_disagreement_rate"] = t.rate(F.col(f"{s}_disagreements"), F.col(f"{s}_dual_runs"))
    return results.agg(*aggs).withColumns(rates)


def report_summary(results: DataFrame, given: dict[str, int] | None = None) -> DataFrame:
    """Totals for a report; values computed elsewhere take the place of counted ones."""
    status, repair = F.col("status"), F.col("repair_status")
    counted = results.agg(
        F.count("*").alias("total"),
        F.count_if(status == "good").alias("good"),
        F.count_if(status != "good").alias("with_issues"),
        *[F.count_if(status == s).alias(s) for s in ("bad", "needs_review", "warning")],
        F.count_if(repair == "repaired").alias("repaired"),
        F.count_if(repair == dims.MANUAL).alias("manual_review"),
        F.count_if(repair == "failed").alias("repair_failed"),
        F.count_if(repair == "skipped").alias("skipped"),
    )
    return counted.withColumns({k: F.lit(n).cast("bigint") for k, n in (given or {}).items()})


def plan_summary(evaluations: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts by status, coverage, issue type and severity as one long table (facet, name, n)."""
    of_records = evaluations.select(
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("facet"), F.coalesce("overall_status", F.lit("unknown")).alias("name")),
                F.struct(F.lit("coverage").alias("facet"), F.coalesce("coverage_status", F.lit("unknown")).alias("name")),
            )
        ).alias("f")
    )
    of_issues = issues.select(
        F.explode(
            F.array(
                F.struct(F.lit("issue_type").alias("facet"), F.coalesce("issue_type", F.lit("unknown")).alias("name")),
                F.struct(F.lit("severity").alias("facet"), F.coalesce("severity", F.lit("unknown")).alias("name")),
            )
        ).alias("f")
    )
    count = lambda df: df.groupBy("f.facet", "f.name").agg(F.count("*").alias("n"))
    return count(of_records).unionByName(count(of_issues))


def plan_totals(evaluations: DataFrame) -> DataFrame:
    """One row: records, records per known status, whether the counts add up, records that are not ok."""
    status = F.col("overall_status")
    names = list(dims.PLAN_STATUS_RANK)
    totals = evaluations.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in names],
        F.count_if(status.isin(names)).alias("counted_status_total"),
        F.count_if(~status.eqNullSafe(F.lit("ok"))).alias("issue_records_count"),
    )
    return totals.withColumn(
        "count_consistency_valid", F.col("counted_status_total") == F.col("total_records")
    )


def _first_texts(issues: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    return ordering.first_seen(issues.withColumn("text", t.non_blank(text)), keys, "text", F.col("pos"))


def reason_list(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reasons of plan issues, each at the place it was first seen: summary, else evidence, else type."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return _first_texts(issues, F.coalesce(some("summary"), some("evidence"), some("issue_type")), keys)


def suggestion_list(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct suggestions of plan issues: the fix, else the action."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return _first_texts(issues, F.coalesce(some("suggested_fix"), some("recommended_action")), keys)


def reasons_or_summary(records: DataFrame, reasons: DataFrame) -> DataFrame:
    """Records without any reason take their summary as the only one."""
    bare = records.join(reasons.select("record_id").distinct(), "record_id", "left_anti").select(
        "record_id", t.non_blank(F.col("summary")).alias("text"), F.lit(0).alias("pos")
    )
    return reasons.select("record_id", "text", "pos").unionByName(bare.filter(F.col("text").isNotNull()))


def batch_reasons(reasons: DataFrame, order: Column) -> DataFrame:
    """Distinct reasons of a whole batch, each at the row where it first appears."""
    return reasons.filter(F.coalesce("text", F.lit("")) != "").groupBy("kind", "text").agg(F.min(order).alias("at"))


def report_rows(documents: DataFrame, issues: DataFrame, shown: int | None = None, size: int = 1000) -> DataFrame:
    """Report rows per document: id, status, repair, the issues in short, and all distinct reasons and suggestions.

    documents: (doc_id, index, id, status, repair_status). `shown` asks for the first reasons and suggestions only. A list of more
    than `size` texts goes on in further rows of the same document (`part`), so no list is cut and none has to fit into one
    buffer. The issues are distinct (category, severity) pairs with their numbers, as few as the format has.
    """
    keys = ["doc_id"]
    pair = F.concat(F.col("category"), F.lit("("), F.col("severity"), F.lit(")"))
    counted = issues.groupBy("doc_id", pair.alias("label")).agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    labelled = counted.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "label", "n"))),
                lambda x: F.when(x["n"] > 1, F.concat(x["label"], F.lit(" x"), x["n"].cast("string"))).otherwise(x["label"]),
            ),
            "; ",
        ).alias("issues")
    )

    def listed(column: str) -> DataFrame:
        seen = _first_texts(issues, F.col(column), keys)
        if shown is not None:
            seen = ordering.top_rows(seen, keys, [F.col("pos"), F.col("text")], shown).drop("__rank")
        return ordering.ordered_pieces(seen, keys, "text", "pos", column, size)

    parts = documents.select("doc_id", F.lit(0).alias("part"))
    lists = listed("reason").join(listed("suggestion"), ["doc_id", "part"], "full_outer")
    pieces = parts.join(lists, ["doc_id", "part"], "full_outer")
    joined = documents.join(pieces, keys).join(labelled, keys, "left")
    cell = lambda c: t.cell_text(F.array_join(c, "; "))
    return joined.select(
        (F.col("index") + 1).alias("row"),
        "part",
        t.cell_text(F.coalesce("id", F.concat(F.lit("item["), F.col("index").cast("string"), F.lit("]")))).alias("id"),
        "status",
        F.col("repair_status").alias("repair"),
        t.cell_text(F.when(F.col("part") == 0, F.col("issues"))).alias("issues"),
        cell(F.col("reason")).alias("reasons"),
        cell(F.col("suggestion")).alias("suggestions"),
    )


def public_result(documents: DataFrame, issues: DataFrame, debug: bool = False) -> DataFrame:
    """Documents as published, in long form: one row per document and issue with six issue fields.

    documents: (doc_id, is_good, new_doc, and for debug repair_status, patches, loop_count, stop_reason). A document
    without issues keeps one row. Group by doc_id where documents are known to be small.
    """
    base = ["doc_id", "is_good", "new_doc"]
    if debug:
        shown = {
            "repair_status": F.when(F.col("repair_status") != "skipped", F.col("repair_status")),
            "loop_count": F.when(F.col("loop_count") > 0, F.col("loop_count")),
            "stop_reason": F.nullif(F.col("stop_reason"), F.lit("")),
        }
        documents = documents.withColumns(shown)
        base += [c for c in ("repair_status", "patches", "loop_count", "stop_reason", "resolver") if c in documents.columns]
    six = issues.select(
        "doc_id",
        "pos",
        F.struct("severity", "category", "location", "reason", "suggestion", "repair_intent").alias("issue"),
    )
    return documents.select(*base).join(six, "doc_id", "left")


NO_REASON = "The plan is not good enough, but no reason was given."


def plan_result(evaluations: DataFrame, reasons: DataFrame, suggestions: DataFrame, size: int = 1000) -> DataFrame:
    """Service rows with their lists: a good record has none and no plan; a bad one a reason, and a plan only if it is valid.

    evaluations: (record_id, is_good, candidate, candidate_valid, is_loop, loop_count); reasons, suggestions: (record_id, text,
    pos), distinct. Lists of more than `size` texts go on in further rows of the same record (`part`).
    """
    good = F.coalesce("is_good", F.lit(False))
    keys = ["record_id"]
    lists = ordering.ordered_pieces(reasons, keys, "text", "pos", "reasons", size).join(
        ordering.ordered_pieces(suggestions, keys, "text", "pos", "suggestions", size), [*keys, "part"], "full_outer"
    )
    bad = evaluations.where(~good).select("record_id")
    pieces = evaluations.select("record_id", F.lit(0).alias("part")).join(lists.join(bad, keys, "left_semi"), [*keys, "part"], "full_outer")
    none = F.array().cast("array<string>")
    first = F.col("part") == 0
    return evaluations.join(pieces, keys).select(
        "record_id",
        "part",
        good.alias("is_good"),
        F.coalesce("reasons", F.when(first & ~good, F.array(F.lit(NO_REASON))).otherwise(none)).alias("reasons"),
        F.coalesce("suggestions", none).alias("suggestions"),
        F.when(~good & F.col("candidate_valid"), F.col("candidate")).alias("new_plan"),
        F.coalesce("is_loop", F.lit(False)).alias("is_loop"),
        F.greatest(F.coalesce(F.col("loop_count").try_cast("int"), F.lit(0)), F.lit(0)).alias("loop_count"),
    )
