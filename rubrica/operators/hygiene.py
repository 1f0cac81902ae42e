"""Text hygiene on text nodes (doc_id, pointer, role, text, ...). Row-local: a scan and an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import text as t
from rubrica.functions.expressions import spread
from rubrica.operators import ordering
from rubrica.session import cut_lineage

# code: (severity, reason, suggestion)
RULES = {
    "H1": ("needs_review", "An important text is nearly empty.", "Say it in full."),
    "H2": ("warning", "Blanks repeat.", "Use single blanks."),
    "H3": ("warning", "A blank stands before punctuation.", "Remove the blank."),
    "H4": ("warning", "No blank follows punctuation.", "Add a blank."),
    "H5": ("warning", "Punctuation repeats.", "Keep one mark."),
    "H6": ("warning", "A word repeats: {}.", "Keep one."),
    "H7": ("needs_review", "The text looks wrongly decoded.", "Check the encoding."),
    "H8": ("needs_review", "The sentence is too long.", "Split it."),
    "H9": ("needs_review", "Parentheses do not match.", "Check the pairs."),
    "H10": ("needs_review", "The text seems to lack its accents.", "Check the spelling."),
}
SPACES = r"(?U)[^\S\r\n]{2,}"
SPACE_BEFORE = r"(?U)\s+([,.;:!?])"
NO_SPACE_AFTER = r"(?U)[,.;:!?](?=[^\s\d,.;:!?])"
REPEATED_MARK = r"([,.;!?])\1"
REPEATED_WORD = rf"(?iU)\b([{dims.WORD_CHARS}]+)\s+\1\b"
MIN_CHARS, MAX_CHARS = 5, 650


def rule_hits(text: Column, protected: Column, role: Column) -> Column:
    """The codes a text breaks with the corrected text where one can be given."""

    def hit(when: Column, code: str, fixed: Column | None = None, detail: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("rule"),
                (none if fixed is None else fixed).alias("corrected_text"),
                (none if detail is None else detail).alias("detail"),
            ),
        )

    marks = t.count_of(protected, ".") + t.count_of(protected, "?") + t.count_of(protected, "!")
    return F.array_compact(
        F.array(
            hit(role.isin("instruction", "stem") & (F.length(t.strip(protected)) < MIN_CHARS), "H1"),
            hit(protected.rlike(SPACES), "H2", F.regexp_replace(text, SPACES, " ")),
            hit(protected.rlike(SPACE_BEFORE), "H3", F.regexp_replace(text, SPACE_BEFORE, "$1")),
            hit(protected.rlike(NO_SPACE_AFTER), "H4"),
            hit(protected.rlike(REPEATED_MARK), "H5"),
            hit(
                protected.rlike(REPEATED_WORD),
                "H6",
                F.regexp_replace(text, REPEATED_WORD, "$1"),
                F.regexp_extract(protected, REPEATED_WORD, 0),
            ),
            hit(t.contains_any(protected, dims.MOJIBAKE), "H7"),
            hit((F.length(protected) > MAX_CHARS) & (marks <= 1), "H8"),
            hit(F.abs(t.count_of(protected, "(") - t.count_of(protected, ")")) >= 2, "H9"),
            hit(t.accentless_text(protected), "H10"),
        )
    )


def hits_of(node: Column) -> Column:
    """The hits on one text node struct<role, text, …>."""
    return t.bind(t.protect_math(node["text"]), lambda protected: rule_hits(node["text"], protected, node["role"]))


def text_hygiene(nodes: DataFrame) -> DataFrame:
    """One issue per rule and node, with all fields of the node kept."""
    # A generated column is not computed again for each rule that reads it.
    prepared = nodes.withColumn("protected", F.explode_outer(F.array(t.protect_math(F.col("text")))))
    hits = spread(prepared, nodes.columns, rule_hits(F.col("text"), F.col("protected"), F.col("role")), "hit")
    rule = F.col("hit.rule")

    def of(i: int) -> Column:
        return t.lookup({k: r[i] for k, r in RULES.items()}, rule)

    return hits.select(
        *nodes.columns,
        rule.alias("rule"),
        of(0).alias("severity"),
        F.lit("spelling_wording").alias("category"),
        F.col("pointer").alias("location"),
        F.replace(of(1), F.lit("{}"), F.coalesce("hit.detail", F.lit(""))).alias("reason"),
        of(2).alias("suggestion"),
        F.lit("fix_spelling_wording").alias("repair_intent"),
        F.col("hit.corrected_text").alias("corrected_text"),
    )


def hygiene_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def candidate_nodes(nodes: DataFrame, issues: DataFrame, first_n: int | None = None) -> DataFrame:
    """Nodes to ask a model about: those with a rule hit; in documents where no hit names a node, all, or the first n.

    Documents without any hit need no request at all, so they give no rows.
    """
    # Places are found once; three joins read them.
    hit_nodes = cut_lineage(issues.select("doc_id", "location").distinct())
    with_hit = nodes.join(
        hit_nodes.withColumnRenamed("location", "pointer"), ["doc_id", "pointer"], "left_semi"
    )
    named = with_hit.select("doc_id").distinct()
    unnamed = hit_nodes.select("doc_id").distinct().join(named, "doc_id", "left_anti")
    rest = nodes.join(unnamed, "doc_id", "left_semi")
    if first_n is not None:
        rest = ordering.top_rows(rest, ["doc_id"], [F.col("pos")], first_n).drop("__rank")
    return with_hit.unionByName(rest)


def spelling_request(nodes: DataFrame) -> DataFrame:
    """One request row per node, with formulas protected and listed."""
    return nodes.select(
        "doc_id",
        "pos",
        F.col("pointer").alias("path"),
        "role",
        "text",
        t.protect_math(F.col("text")).alias("math_protected_text"),
        t.math_segments(F.col("text")).alias("math_segments"),
    )


TEXT_ISSUE = "struct<rule:string,severity:string,location:string,reason:string,suggestion:string,corrected_text:string>"


def check_text(docs: DataFrame, first_n: int | None = None) -> DataFrame:
    """Rules and request of each document in one evaluation: docs (doc_id, nodes ARRAY<STRUCT<pointer, role, text, …>>).

    Adds `issues`, all findings in the order of nodes, and `request`, the nodes to ask a model about with their formulas protected: those with a
    finding; empty where nothing was found. Both come from the same list of findings in the row, so texts are read and checked once.
    Where findings name none of the nodes, all are asked about, or the first n.
    """
    table = {code: rule for code, rule in RULES.items()}

    def looked_at(n: Column, i: Column) -> Column:
        return t.bind(
            t.protect_math(n["text"]),
            lambda protected: F.struct(
                i.alias("pos"), n["pointer"].alias("path"), n["role"].alias("role"), n["text"].alias("text"), protected.alias("protected"),
                rule_hits(n["text"], protected, n["role"]).alias("hits"),
            ),
        )

    def issue(n: Column, h: Column) -> Column:
        of = lambda k: t.lookup({code: rule[k] for code, rule in table.items()}, h["rule"])
        return F.struct(
            h["rule"].alias("rule"),
            of(0).alias("severity"),
            n["path"].alias("location"),
            F.replace(of(1), F.lit("{}"), F.coalesce(h["detail"], F.lit(""))).alias("reason"),
            of(2).alias("suggestion"),
            h["corrected_text"].alias("corrected_text"),
        )

    # A generated column is not computed again for each use of it.
    looked = docs.withColumn("looked", F.explode_outer(F.array(F.transform("nodes", looked_at))))
    issues = F.flatten(F.transform("looked", lambda n: F.transform(n["hits"], lambda h: issue(n, h))))
    hit = F.filter("looked", lambda n: F.size(n["hits"]) > 0)
    rest = F.col("looked") if first_n is None else F.slice("looked", 1, first_n)
    asked = F.when(F.size("issues") > 0, F.when(F.size(hit) > 0, hit).otherwise(rest)).otherwise(F.slice("looked", 1, 0))
    request = F.transform(
        asked,
        lambda n: F.struct(
            n["pos"].alias("pos"), n["path"].alias("path"), n["role"].alias("role"), n["text"].alias("text"),
            n["protected"].alias("math_protected_text"), t.math_segments(n["text"]).alias("math_segments"),
        ),
    )
    found = looked.withColumn("issues", F.coalesce(issues, F.array().cast(f"array<{TEXT_ISSUE}>")))
    return found.withColumn("request", request).drop("looked")


def spelling_merge(rule_issues: DataFrame, reply_issues: DataFrame) -> DataFrame:
    """Rule issues and those reply issues whose (location, reason) is not known yet; rules come first."""
    merged = rule_issues.withColumn("turn", F.lit(0)).unionByName(
        reply_issues.withColumn("turn", F.lit(1)), allowMissingColumns=True
    )
    cols = [c for c in merged.columns if c not in ("doc_id", "location", "reason")]
    return ordering.first_rows(
        merged, ["doc_id", "location", "reason"], [F.col("turn"), F.col("pos")], cols
    )
