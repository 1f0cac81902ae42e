"""Structural rules for complete question objects.

`check_object` evaluates every rule on the row of its document: one scan, no shuffle. The functions below it apply
the integrity rules to documents that are already stored as relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import text, variants as v
from rubrica.functions.expressions import built_once
from rubrica.operators import object_walk
from rubrica.operators.object_walk import MIN_ESSAY_STEM

# code: (severity, category, reason, suggestion). `{}` in a reason takes the detail of the finding.
RULES = {
    "G01": ("bad", "render_schema", "The document is not an object.", "Send a list of objects."),
    "G02": ("needs_review", "pedagogical_quality", "There is no instruction.", "See whether the items carry enough context."),
    "G03": ("bad", "render_schema", "The block container is not a list.", "Make it a list of content blocks."),
    "G04": ("bad", "render_schema", "The content block is not an object.", "Make it an object with id and type."),
    "G05": ("bad", "render_schema", "The content block has no id.", "Give it a stable id."),
    "G06": ("bad", "render_schema", "The content block has no type.", "Give it a type."),
    "G07": ("bad", "render_schema", "The text block has no text.", "Add the text to show."),
    "G08": ("needs_review", "render_schema", "The visual block has no display object.", "Add its display settings."),
    "G09": ("bad", "solution_quality", "The solutions are not a list.", "Make them a list of solution objects."),
    "G10": ("bad", "solution_quality", "The solution is not an object.", "Make it an object with its content."),
    "G11": ("bad", "render_schema", "There are no items.", "Add items."),
    "G12": ("bad", "render_schema", "There is neither instruction nor item.", "Add both before checking."),
    "G13": ("bad", "render_schema", "The item is not an object.", "Make it an object."),
    "G14": ("bad", "render_schema", "The item has no id.", "Give it a stable id."),
    "G15": ("bad", "render_schema", "The item has no stem.", "Add the stem."),
    "G16": ("bad", "hint_quality", "The hints are not a list.", "Make them a list of hint objects."),
    "G17": ("bad", "hint_quality", "The hint is not an object.", "Make it an object with name and content."),
    "G18": ("bad", "interaction_schema", "The item has no interaction.", "Add at least one interaction."),
    "G19": ("bad", "interaction_schema", "The interaction is not an object.", "Make it an object."),
    "G20": ("bad", "interaction_schema", "The interaction has no id.", "Give it a stable id."),
    "G21": ("bad", "render_schema", "Interaction id `{}` repeats in the document.", "Make the ids unique."),
    "G22": ("bad", "interaction_schema", "The interaction has no type.", "Give it a valid type."),
    "G23": ("bad", "interaction_schema", "Interaction type `{}` is unknown.", "Use a supported type."),
    "G24": ("bad", "interaction_schema", "The interaction has no config object.", "Add its config."),
    "G25": ("bad", "interaction_schema", "The interaction has no display object.", "Add its display settings."),
    "G26": ("bad", "interaction_schema", "The choice has no options.", "Add the options."),
    "G27": ("bad", "interaction_schema", "The choice has fewer than two options.", "Add more options."),
    "G28": ("bad", "interaction_schema", "Option ids repeat: {}.", "Make the option ids unique."),
    "G29": ("bad", "interaction_schema", "Some options have no id.", "Give every option an id."),
    "G30": ("needs_review", "choice_quality", "Two options show the same text.", "Change the repeated options."),
    "G31": ("bad", "answer_internal_consistency", "Interaction `{}` has no answer spec.", "Add an answer spec or a rubric."),
    "G32": ("bad", "answer_internal_consistency", "The answer spec is not an object.", "Make it an object."),
    "G33": ("bad", "answer_internal_consistency", "The spec points to `{}`, which its item does not have.", "Correct the reference."),
    "G34": ("bad", "answer_internal_consistency", "The spec names no interaction.", "Add the reference."),
    "G35": ("bad", "answer_internal_consistency", "Spec type `{}` differs from the interaction type.", "Use the same type."),
    "G36": ("bad", "answer_internal_consistency", "The single choice names no correct option.", "Add the correct option."),
    "G37": ("bad", "answer_internal_consistency", "The single choice names several correct options.", "Keep one."),
    "G38": ("bad", "answer_internal_consistency", "Correct option `{}` is not among the options.", "Make the ids match."),
    "G39": ("bad", "answer_internal_consistency", "The multiple choice names no correct options.", "Add the correct options."),
    "G40": ("bad", "answer_internal_consistency", "The multiple choice has fewer than two correct options.", "Add one or make it a single choice."),
    "G41": ("bad", "answer_internal_consistency", "Correct option `{}` is not among the options.", "Make the ids match."),
    "G42": ("bad", "answer_internal_consistency", "The spec does not say true or false.", "Add the expected boolean."),
    "G43": ("needs_review", "answer_internal_consistency", "The short answer has no value to compare with.", "Add a correct or acceptable value."),
    "G44": ("bad", "interaction_schema", "The number of coordinate dimensions is not valid.", "Use a positive whole number."),
    "G45": ("bad", "answer_internal_consistency", "Expected slot `{}` is not configured.", "Make the slot ids match."),
    "G46": ("needs_review", "pedagogical_quality", "The essay stem is too short.", "Say what the answer should cover."),
    "G47": ("needs_review", "answer_internal_consistency", "The essay has nothing to grade it against.", "Add a rubric, a spec or a solution."),
}
FINDING = "array<struct<rule:string,location:string,detail:string,severity:string,ord:array<int>>>"


def repeats(values: Column) -> Column:
    return F.size(values) > F.size(F.array_distinct(values))


def repeated_ids(options: Column) -> Column:
    ids = F.filter(F.transform(options, lambda o: o["id"]), lambda x: x != "")
    return F.array_sort(
        F.filter(F.array_distinct(ids), lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)
    )


def option_rule(options: Column) -> Column:
    """The first of G26 to G29 that a list of options breaks, or NULL."""
    blank = F.exists(options, lambda o: o["id"] == "")
    ids = F.filter(F.transform(options, lambda o: o["id"]), lambda x: x != "")
    return (
        F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, "G26")
        .when(F.size(options) < 2, "G27")
        .when(repeats(ids), "G28")
        .when(blank, "G29")
    )


def repeats_text(options: Column) -> Column:
    texts = F.filter(F.transform(options, lambda o: F.lower(o["text"])), lambda t: t != "")
    return F.coalesce(repeats(texts), F.lit(False))


@built_once
def _found() -> Column:
    """All findings of a document (doc VARIANT, index) as one list: its own, then those of its items."""
    doc = F.col("doc")
    held = F.try_variant_get(doc, "$.questionItems", "array<struct<interactions:array<struct<config:struct<dimensions:variant>>>>>")
    integer = lambda x: F.coalesce(F.schema_of_variant(x["config"]["dimensions"]) == "BIGINT", F.lit(False))
    integers = F.transform(held, lambda item: F.transform(item["interactions"], integer))
    return F.arrow_udf(object_walk.found_of, FINDING)(F.to_json(doc), integers, F.col("index"))


def object_findings(docs: DataFrame) -> DataFrame:
    """Documents with all their findings as a list `found` in their own row; nothing is shuffled."""
    indexed = docs if "index" in docs.columns else docs.withColumn("index", F.lit(0))
    return indexed.withColumn("found", _found())


def check_object(docs: DataFrame) -> DataFrame:
    """All structural issues of each document (doc_id, doc VARIANT [, index]), in document order by `ord`."""
    # An inner explode would add a test of the list's size below, where the list would be made a second time.
    findings = object_findings(docs).select("doc_id", F.explode_outer("found").alias("f")).where("f IS NOT NULL")
    return as_issues(findings.select("doc_id", "f.*"))


def graded_bad(f: Column) -> Column:
    return F.coalesce(f["severity"], text.lookup({code: r[0] for code, r in RULES.items()}, f["rule"])) == "bad"


def clear_documents(docs: DataFrame) -> DataFrame:
    """The documents without any bad issue; only these go on to the model stages."""
    indexed = docs if "index" in docs.columns else docs.withColumn("index", F.lit(0))
    # A generated column: a filter on a plain one would be moved below what builds `doc`, and repeat that for every use.
    clear = F.explode_outer(F.array(~F.exists(_found(), graded_bad)))
    return indexed.select(*docs.columns, clear.alias("__clear")).where("__clear").select(docs.columns)


def as_issues(findings: DataFrame) -> DataFrame:
    """Findings (rule, location, detail, severity, ord) with the texts and grades of their rules."""
    rule = F.col("rule")

    def of(i: int) -> Column:
        return text.lookup({code: r[i] for code, r in RULES.items()}, rule)

    keep = [c for c in findings.columns if c not in ("rule", "severity", "location", "detail", "ord")]
    return findings.select(
        *keep,
        "rule",
        F.coalesce(F.col("severity"), of(0)).alias("severity"),
        of(1).alias("category"),
        "location",
        F.replace(of(2), F.lit("{}"), F.coalesce(F.col("detail"), F.lit(""))).alias("reason"),
        of(3).alias("suggestion"),
        "ord",
    )


def _counts() -> list[Column]:
    """Items and interactions of a document; elements that are not objects count as the report counts them."""
    # Lists with empty elements: NULL where an element is no object.
    held = F.try_variant_get("doc", "$.questionItems", "array<struct<interactions:array<struct<>>>>")
    zero = F.lit(0).cast("bigint")
    total = lambda count: F.coalesce(F.aggregate(held, zero, lambda n, item: n + F.coalesce(count(item["interactions"]), F.lit(0))), zero)
    return [
        F.coalesce(F.size(held), F.lit(0)).cast("bigint").alias("n_items"),
        total(F.array_size).alias("n_interactions"),
        total(lambda x: F.array_size(F.filter(x, lambda i: i.isNotNull()))).alias("n_object_interactions"),
    ]


def check_object_rollup(docs: DataFrame) -> DataFrame:
    """Per document: validity and the numbers of items, interactions, issues and bad issues."""
    n_bad = F.size(F.filter("found", graded_bad)).cast("bigint")
    counted = object_findings(docs).select("doc_id", *_counts(), F.size("found").cast("bigint").alias("n_issues"), n_bad.alias("n_bad"))
    return counted.select("doc_id", "n_items", "n_interactions", "n_issues", "n_bad", (F.col("n_bad") == 0).alias("valid"))


def check_objects_summary(rollup: DataFrame) -> DataFrame:
    """The same numbers for a whole batch."""
    return rollup.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("n_interactions"), F.lit(0)).alias("n_interactions"),
        F.coalesce(F.sum("n_issues"), F.lit(0)).alias("n_issues"),
        F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"),
        (F.count_if(~F.col("valid")) == 0).alias("valid"),
    )


def payload_counts(docs: DataFrame) -> DataFrame:
    counted = object_findings(docs).select(*_counts(), F.size("found").alias("n_found"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counted.agg(
        F.count("*").alias("n_docs"),
        total("n_items").alias("n_items"),
        total("n_object_interactions").alias("n_interactions"),
        total("n_found").alias("n_issues"),
    )


# --- the same integrity rules over stored relations -----------------------------------------------------------


def repeated_interactions(inter: DataFrame) -> DataFrame:
    """Second and later uses of an interaction id in a document (doc_id, iid, pos).

    The first position of each id is an aggregate with map-side combine; the rows come back by an equi join
    whose other side has one row per id, so a frequent id can be split.
    """
    first = inter.groupBy("doc_id", "iid").agg(F.min("pos").alias("first_pos"))
    return inter.join(first, ["doc_id", "iid"]).filter(F.col("pos") > F.col("first_pos"))


def unknown_types(inter: DataFrame, known: list[str] = dims.OBJECT_TYPES) -> DataFrame:
    return inter.filter(~F.col("itype").isin(known))


def choice_option_rules(inter: DataFrame) -> DataFrame:
    """The first option rule each choice interaction (… options ARRAY<STRUCT<id, text>>) breaks."""
    return (
        inter.filter(F.col("itype").isin(dims.CHOICE_TYPES))
        .withColumn("rule", option_rule(F.col("options")))
        .filter(F.col("rule").isNotNull())
    )


def repeated_option_text(inter: DataFrame) -> DataFrame:
    return inter.filter(F.col("itype").isin(dims.CHOICE_TYPES) & repeats_text(F.col("options")))


def missing_specs(inter: DataFrame, spec: DataFrame) -> DataFrame:
    """Interactions without a spec in their item, with the severity the type asks for."""
    refs = spec.select("doc_id", "item", F.col("ref_iid").alias("iid")).distinct()
    lone = inter.join(refs, ["doc_id", "item", "iid"], "left_anti")
    return lone.withColumn(
        "severity", F.when(F.col("itype").isin("essay", "short_answer"), "needs_review").otherwise("bad")
    )


def interaction_index(inter: DataFrame) -> DataFrame:
    """One row per interaction id of an item: the fields of its first use."""
    fields = [c for c in inter.columns if c not in ("doc_id", "item", "iid")]
    return inter.groupBy("doc_id", "item", "iid").agg(
        *[F.min_by(c, "pos").alias(c) for c in fields if c != "pos"], F.min("pos").alias("pos")
    )


def orphan_specs(spec: DataFrame, inter: DataFrame) -> DataFrame:
    """Specs that point to an interaction their item does not have."""
    owned = inter.select("doc_id", "item", F.col("iid").alias("ref_iid")).distinct()
    return spec.join(owned, ["doc_id", "item", "ref_iid"], "left_anti")


def specs_with_interaction(spec: DataFrame, index: DataFrame) -> DataFrame:
    """Each spec with the interaction it points to. `index` has one row per id, so specs never multiply."""
    return spec.withColumnRenamed("ref_iid", "iid").join(index, ["doc_id", "item", "iid"])


def spec_type_mismatch(joined: DataFrame) -> DataFrame:
    return joined.filter(
        (F.col("stype") != "") & (F.col("itype") != "") & (F.col("stype") != F.col("itype"))
    )


def choice_answer_rules(joined: DataFrame, itype: str) -> DataFrame:
    """Rules on the correct ids (`correct` ARRAY<STRING>) of single or multiple choices, one row per finding."""
    correct, ids = F.col("correct"), F.filter(F.transform("options", lambda o: o["id"]), lambda o: o != "")
    none, amount, unknown = ("G36", "G37", "G38") if itype == "single_choice" else ("G39", "G40", "G41")
    distinct = F.size(F.array_distinct(correct))
    wrong_amount = distinct > 1 if itype == "single_choice" else (distinct < 2) & (distinct > 0)
    struct = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    found = F.concat(
        F.array_compact(
            F.array(
                F.when(distinct == 0, struct(none, F.lit(None))),
                F.when(wrong_amount, struct(amount, F.lit(None))),
            )
        ),
        F.transform(
            F.filter(correct, lambda c: (F.size(ids) > 0) & ~F.array_contains(ids, c)),
            lambda c: struct(unknown, c),
        ),
    )
    kept = joined.filter(F.col("itype") == itype)
    return kept.select(*kept.columns, F.explode(found).alias("f")).select(*kept.columns, "f.rule", "f.detail")


def coordinate_rules(joined: DataFrame) -> DataFrame:
    """Dimensions and slots of coordinate inputs (dimensions INT, slots, slot_refs), one row per finding."""
    struct = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    found = F.concat(
        F.array_compact(F.array(F.when(F.col("dimensions") < 1, struct("G44", F.lit(None))))),
        F.transform(
            F.filter("slot_refs", lambda s: (F.size("slots") > 0) & ~F.array_contains("slots", s)),
            lambda s: struct("G45", s),
        ),
    )
    kept = joined.filter(F.col("itype") == "coordinate_input")
    return kept.select(*kept.columns, F.explode(found).alias("f")).select(*kept.columns, "f.rule", "f.detail")


def empty_items(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents without any child."""
    return parents.join(children.select(*keys).distinct(), keys, "left_anti")


def essay_rules(inter: DataFrame, spec: DataFrame, stems: DataFrame) -> DataFrame:
    """Essays with a short stem (G46) or without any spec in their item (G47)."""
    with_spec = spec.select("doc_id", "item").distinct().withColumn("has_spec", F.lit(True))
    essays = (
        inter.filter(F.col("itype") == "essay")
        .join(stems, ["doc_id", "item"], "left")
        .join(with_spec, ["doc_id", "item"], "left")
    )
    stem = F.length(text.strip(F.coalesce(F.col("stem_text"), F.lit(""))))
    rules = F.array_compact(
        F.array(
            F.when(stem < MIN_ESSAY_STEM, F.lit("G46")),
            F.when(F.col("has_spec").isNull(), F.lit("G47")),
        )
    )
    return essays.withColumn("rule", F.explode(rules))


def block_rules(blocks: DataFrame) -> DataFrame:
    """Rules G05 to G08 on stored content blocks (…, block_id, block_type, text, has_display)."""
    blank = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = F.array_compact(
        F.array(
            F.when(blank("block_id"), F.lit("G05")),
            F.when(blank("block_type"), F.lit("G06")),
            F.when((F.col("block_type") == "text") & blank("text"), F.lit("G07")),
            F.when(F.col("block_type").isin("graph", "chart") & ~F.col("has_display"), F.lit("G08")),
        )
    )
    return blocks.withColumn("rule", F.explode(rules))
