"""Issue relations: normalising, filtering, merging, deduplicating and ranking.

An issue is a row (doc_id, pos, severity, category, location, reason, suggestion, error_snippet,
required_context_paths, repair_intent); `pos` gives its place in its document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import pointers, text
from rubrica.operators import ordering

SOURCE_BITS = 48  # room for the positions of one source
KEY = ["doc_id", "category", "location", "repair_intent", "reason_key"]


def severity_strength(severity: Column) -> Column:
    return text.lookup(dims.SEVERITY_STRENGTH, severity, -1)


def severity_order(severity: Column) -> Column:
    return text.lookup(dims.SEVERITY_ORDER, severity, dims.UNRANKED)


def category_order(category: Column) -> Column:
    return text.lookup(dims.CATEGORY_ORDER, category, dims.UNRANKED)


def default_intent(category: Column) -> Column:
    return text.lookup(dims.DEFAULT_INTENT, category, dims.MANUAL)


def is_metadata_issue(category: Column, location: Column, reason: Column, suggestion: Column) -> Column:
    """Issues about metadata that is out of scope, by category or by wording."""
    low = F.lower(F.concat_ws(" ", location, reason, suggestion))
    return (F.coalesce(text.strip(category), F.lit("")) == dims.METADATA_CATEGORY) | text.contains_any(
        low, dims.METADATA_WORDS
    )


def is_metadata_text(value: Column) -> Column:
    return text.contains_any(F.lower(F.coalesce(value, F.lit(""))), dims.METADATA_TEXT_WORDS)


def drop_metadata_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(
        ~is_metadata_issue(F.col("category"), F.col("location"), F.col("reason"), F.col("suggestion"))
    )


def is_blocking(severity: Column, strict: bool) -> Column:
    return severity.isin(dims.STRICT_BLOCKING if strict else dims.LENIENT_BLOCKING)


def blocking_documents(issues: DataFrame, strict: bool) -> DataFrame:
    """Documents with at least one blocking issue, with the number of them."""
    return (
        issues.filter(is_blocking(F.col("severity"), strict))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_blocking"))
    )


def normalize_issues(issues: DataFrame) -> DataFrame:
    """Fill in every field of an issue from what is there. Metadata issues go first."""
    kept = drop_metadata_issues(issues)
    columns = kept.columns

    def given(name: str) -> Column:
        return text.strip(F.col(name)) if name in columns else F.lit(None).cast("string")

    def or_default(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(given(name), F.lit("")), default)

    category = text.lookup(dims.LEGACY_CATEGORY, given("category"), None)
    category = F.coalesce(category, given("category"))
    category = F.when(category.isin(dims.CATEGORIES), category).otherwise("runtime")
    severity = F.when(given("severity").isin(dims.SEVERITIES), given("severity")).otherwise("needs_review")
    located = kept.select(
        *[c for c in columns if c not in ("severity", "category", "location", "reason", "suggestion")],
        severity.alias("severity"),
        category.alias("category"),
        pointers.to_pointer(
            or_default("location", F.concat(F.lit("issues["), F.col("pos").cast("string"), F.lit("]")))
        ).alias("location"),
        or_default("reason", F.lit("The issue gives no clear reason.")).alias("reason"),
        or_default("suggestion", F.lit("Review by hand.")).alias("suggestion"),
    )
    given_paths = (
        F.array_distinct(
            F.filter(
                F.transform(F.col("required_context_paths"), pointers.to_pointer), lambda p: p.startswith("/")
            )
        )
        if "required_context_paths" in columns
        else F.lit(None).cast("array<string>")
    )
    paths = F.when(F.size(given_paths) > 0, given_paths).otherwise(
        pointers.context_paths(F.col("category"), F.col("location"))
    )
    return located.withColumns(
        {
            "error_snippet": F.coalesce(
                F.nullif(given("error_snippet"), F.lit("")),
                text.snippet(F.col("reason"), F.col("suggestion")),
            ),
            "required_context_paths": paths,
            "repair_intent": F.coalesce(
                F.nullif(given("repair_intent"), F.lit("")), default_intent(F.col("category"))
            ),
        }
    )


def merge_issues(*sources: DataFrame) -> DataFrame:
    """All issue sources as one normalised relation; the first source comes first in the order of `pos`."""
    shifted = [
        normalize_issues(s).withColumns(
            {"source": F.lit(i), "pos": F.lit(i << SOURCE_BITS).cast("bigint") + F.col("pos")}
        )
        for i, s in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shifted)


def canonical_issues(issues: DataFrame) -> DataFrame:
    """One row per logical issue: the first one's fields, the strongest severity, the shortest wording.

    One aggregate with partial results on the map side; a key that repeats very often costs one small state.
    """
    keyed = issues.withColumn("reason_key", text.collapse_ws(F.col("reason")))
    pos = F.col("pos")
    reason, suggestion = text.non_blank(F.col("reason")), text.non_blank(F.col("suggestion"))

    def shortest(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.struct(F.length(value), pos)))

    return (
        keyed.groupBy(*KEY)
        .agg(
            F.min(pos).alias("pos"),
            F.count("*").alias("n_merged"),
            F.max_by(F.col("severity"), F.struct(severity_strength(F.col("severity")))).alias("severity"),
            F.coalesce(shortest(reason), F.lit("")).alias("reason"),
            F.coalesce(shortest(suggestion), F.lit("")).alias("suggestion"),
        )
        .select(
            "doc_id", "pos", "severity", "category", "location", "reason", "suggestion", "repair_intent", "n_merged"
        )
    )


def dedupe_issues(issues: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the first of the issues with the same logical key."""
    keyed = issues.withColumn("reason_key", text.collapse_ws(F.col("reason")))
    return ordering.first_rows(keyed, KEY, [F.col("pos")], cols)


def issue_order(issues: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Number the issues of each document by severity, then category, then position."""
    ranked = issues.withColumns(
        {
            "severity_rank": severity_order(F.col("severity")),
            "category_rank": category_order(F.col("category")),
        }
    )
    bucket = [F.col("severity_rank"), F.col("category_rank"), F.floor(F.col("pos") / width)]
    return ordering.split_row_number(ranked, ["doc_id"], bucket, [F.col("pos")], "rank")


def gate_priority(category: Column, intent: Column) -> Column:
    """1 manual solution problem, 2 solution clean-up, 3 runtime problem; NULL does not block."""
    solution = category == "solution_quality"
    return (
        F.when(solution & (intent == dims.MANUAL), 1)
        .when(solution & (intent == "clean_solution_reasoning"), 2)
        .when(category == "runtime", 3)
    )


def solution_gate(issues: DataFrame) -> DataFrame:
    """The issue that keeps a document from answer alignment, one row per blocked document."""
    gated = issues.withColumn("gate", gate_priority(F.col("category"), F.col("repair_intent")))
    return ordering.first_rows(
        gated.filter(F.col("gate").isNotNull()),
        ["doc_id"],
        [F.col("gate"), F.col("pos")],
        ["gate", "pos", "category", "location", "repair_intent"],
    )


def select_repair_issue(issues: DataFrame) -> DataFrame:
    """The issue to repair next: a blocker, else the first repairable one, else the first one."""
    gate = gate_priority(F.col("category"), F.col("repair_intent"))
    rank = [severity_order(F.col("severity")), category_order(F.col("category")), F.col("pos")]
    first_blocker = F.when(gate.isNotNull(), F.struct(F.lit(0), gate, F.lit(0), F.col("pos")))
    repairable = F.col("repair_intent").isin(dims.REPAIRABLE_INTENTS)
    other = F.struct(F.when(repairable, 1).otherwise(2), *rank)
    choice = F.coalesce(first_blocker, other)
    return ordering.first_rows(
        issues, ["doc_id"], [choice], ["pos", "severity", "category", "location", "repair_intent"]
    )


def fail_closed(replies: DataFrame) -> DataFrame:
    """One runtime issue for each reply that could not be used; `error` says why."""
    return replies.filter(F.col("error").isNotNull()).select(
        "doc_id",
        F.lit(0).alias("pos"),
        F.lit("needs_review").alias("severity"),
        F.lit("runtime").alias("category"),
        F.lit("").alias("location"),
        F.lit("The reply could not be used.").alias("reason"),
        F.lit("Check by hand or run the service again.").alias("suggestion"),
        F.col("error").alias("failed_reason"),
    )


def blocking_reasons(documents: DataFrame, issues: DataFrame, strict: bool) -> DataFrame:
    """Reasons of blocking issues and suggestions of all issues of documents that are not good.

    Long form (doc_id, kind, text, pos): distinct texts at the position where each was first seen. `documents`
    may bring texts of its own (doc_id, kind, text, pos); those come first.
    """
    blocked = issues.filter(is_blocking(F.col("severity"), strict)).select("doc_id").distinct()
    reasons = issues.filter(is_blocking(F.col("severity"), strict)).select(
        "doc_id", F.lit("reason").alias("kind"), F.col("reason").alias("text"), "pos"
    )
    suggestions = (
        issues.filter(text.non_blank(F.col("suggestion")).isNotNull())
        .join(blocked, "doc_id", "left_semi")
        .select("doc_id", F.lit("suggestion").alias("kind"), F.col("suggestion").alias("text"), "pos")
    )
    own = documents.filter(~is_metadata_text(F.col("text")))
    listed = (
        own.withColumn("turn", F.lit(0))
        .unionByName(reasons.unionByName(suggestions).withColumn("turn", F.lit(1)))
        .groupBy("doc_id", "kind", "text")
        .agg(F.min(F.struct("turn", "pos")).alias("at"))
    )
    return listed.select("doc_id", "kind", "text", "at.turn", "at.pos")
