"""Request rows for outside models. Only the fields a stage may see are read from the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import pointers, text as t, variants as v
from rubrica.operators import flatten
from rubrica.operators.issues import default_intent


def solution_blocks(doc: Column) -> Column:
    """Non-blank text blocks of the solutions as array<struct<solution_index, rank, path, text>>."""

    def of_solution(solution: Column, i: Column) -> Column:
        blocks = F.transform(
            v.listed(solution, "solutionContent"),
            lambda b, k: F.struct(
                i.cast("int").alias("solution_index"),
                k.cast("int").alias("rank"),
                F.concat(
                    F.lit("/solutions/"), i.cast("string"), F.lit("/solutionContent/"), k.cast("string"), F.lit("/text")
                ).alias("path"),
                F.when(v.string_of(v.get(b, "type")) == "text", v.string_of(v.get(b, "text"))).alias("text"),
            ),
        )
        return F.filter(blocks, lambda b: t.non_blank(b["text"]).isNotNull())

    return F.coalesce(
        F.flatten(F.transform(v.listed(doc, "solutions"), of_solution)),
        F.array().cast("array<struct<solution_index:int,rank:int,path:string,text:string>>"),
    )


def judge_request(docs: DataFrame) -> DataFrame:
    """One request per document: items with their stems and types and the solution blocks, but no answers."""
    doc = F.col("doc")

    def item(x: Column, i: Column) -> Column:
        types = F.filter(
            F.transform(v.listed(x, "interactions"), lambda y: v.truthy_at(y, "type")),
            lambda s: s.isNotNull(),
        )
        return F.struct(
            i.cast("int").alias("index"),
            v.get(x, "id").alias("id"),
            v.get(x, "stem").alias("stem"),
            types.alias("interactionTypes"),
            v.is_object(x).alias("nested"),
        )

    listed = F.filter(F.transform(v.listed(doc, "questionItems"), item), lambda x: x["nested"])
    items = F.transform(
        listed, lambda x: F.struct(x["index"].alias("index"), x["id"].alias("id"), x["stem"].alias("stem"), x["interactionTypes"].alias("interactionTypes"))
    )
    instruction = F.when(v.truthy_at(doc, "instruction").isNotNull(), v.get(doc, "instruction"))
    body = F.struct(
        F.coalesce(v.truthy_at(doc, "id"), v.truthy_at(doc, "_id"), F.lit("")).alias("id"),
        items.alias("questionItems"),
        solution_blocks(doc).alias("solutions"),
        instruction.alias("instruction"),
    )
    return docs.select("doc_id", F.lit("judge").alias("stage"), F.to_json(body).alias("request"))


def anchor_contexts(docs: DataFrame) -> DataFrame:
    """One row per interaction that is no essay and has a spec: its first spec, options and hints."""
    items = flatten.items(docs).filter(v.is_object(F.col("item")))
    listed = items.select(
        "doc_id",
        "item_pos",
        "item",
        F.concat(v.listed(F.col("item"), "answerSpecs"), F.col("doc_specs")).alias("specs"),
        F.posexplode(v.listed(F.col("item"), "interactions")).alias("inter_pos", "inter"),
    ).filter(v.is_object(F.col("inter")))
    named = listed.withColumns(flatten.interaction_fields(F.col("inter"))).filter(F.col("itype") != "essay")
    refs = F.transform("specs", lambda s: F.coalesce(v.truthy_at(s, "interactionId"), F.lit("")))
    found = named.withColumn("spec_pos", F.array_position(refs, F.col("iid")) - 1)
    hints = v.get(F.col("item"), "hints")
    return found.filter(F.col("spec_pos") >= 0).select(
        "doc_id",
        "item_pos",
        "inter_pos",
        "iid",
        "itype",
        "spec_pos",
        F.get("specs", F.col("spec_pos").cast("int")).alias("spec"),
        F.concat(
            F.lit("/questionItems/"), F.col("item_pos").cast("string"), F.lit("/answerSpecs/"), F.col("spec_pos").cast("string")
        ).alias("spec_path"),
        F.when(F.col("itype").isin(dims.OPTION_TYPES), F.col("options")).alias("options"),
        F.when(v.truthy_text(hints).isNotNull(), hints).alias("hints"),
        v.get(F.col("item"), "stem").alias("stem"),
    )


def context_list(doc: Column) -> Column:
    """As `anchor_contexts`, for one document in its row: array<struct<iid, itype, spec, spec_path, options, hints, stem>>."""
    shared = v.listed(doc, "answerSpecs")

    def of_item(item: Column, i: Column) -> Column:
        specs = F.concat(v.listed(item, "answerSpecs"), shared)
        refs = F.transform(specs, lambda s: F.coalesce(v.truthy_at(s, "interactionId"), F.lit("")))
        hints = v.get(item, "hints")

        def context(inter: Column) -> Column:
            fields = flatten.interaction_fields(inter)
            at = F.array_position(refs, fields["iid"]).cast("int") - 1
            return F.when(
                v.is_object(inter) & (fields["itype"] != "essay") & (at >= 0),
                F.struct(
                    fields["iid"].alias("iid"),
                    fields["itype"].alias("itype"),
                    F.get(specs, at).alias("spec"),
                    F.concat(F.lit("/questionItems/"), i.cast("string"), F.lit("/answerSpecs/"), at.cast("string")).alias("spec_path"),
                    F.when(fields["itype"].isin(dims.OPTION_TYPES), fields["options"]).alias("options"),
                    F.when(v.truthy_text(hints).isNotNull(), hints).alias("hints"),
                    v.get(item, "stem").alias("stem"),
                ),
            )

        return F.when(v.is_object(item), F.array_compact(F.transform(v.listed(item, "interactions"), context)))

    return F.flatten(F.array_compact(F.transform(v.listed(doc, "questionItems"), of_item)))


def first_specs(inter: DataFrame, spec: DataFrame) -> DataFrame:
    """The same first-match lookup over stored relations: one spec per interaction, essays left out.

    The spec side is reduced to one row per id by an aggregate before it is joined.
    """
    fields = [c for c in spec.columns if c not in ("doc_id", "item", "ref_iid")]
    first = spec.groupBy("doc_id", "item", F.col("ref_iid").alias("iid")).agg(
        F.min_by(F.struct(*fields), "spec_pos").alias("spec")
    )
    return inter.filter(F.col("itype") != "essay").join(first, ["doc_id", "item", "iid"])


def plan_request(
    records: DataFrame, question_chars: int | None = None, answer_chars: int | None = None
) -> DataFrame:
    """Record id, name, question and answer, whole unless a limit is given, and the plan of each record (record_id, record)."""
    record = F.col("record")
    name = F.coalesce(v.truthy_at(record, "_id"), v.truthy_at(record, "id"), F.lit(""))
    return records.select(
        "record_id",
        name.alias("given_id"),
        F.coalesce(v.text_of(v.get(record, "name")), F.lit("")).alias("record_name"),
        t.truncate_text(v.content_text(v.get(record, "question")), question_chars).alias("raw_question"),
        t.truncate_text(v.content_text(v.get(record, "answer")), answer_chars).alias("raw_answer"),
        v.get(record, "question_plan").alias("question_plan"),
    )


def repair_context(issues: DataFrame, limit: int | None = None) -> DataFrame:
    """The parts of a document one issue needs. issues: (doc_id, doc, category, location, …).

    A missing part, or a context over the limit where one is given, makes the row unusable, it is never cut.
    """
    location = pointers.to_pointer(F.col("location"))
    given = (
        F.coalesce("required_context_paths", F.array().cast("array<string>"))
        if "required_context_paths" in issues.columns
        else F.array().cast("array<string>")
    )
    wanted = F.concat(pointers.context_paths(F.col("category"), location), given, F.array(location))
    step = issues.withColumns({"location": location, "paths": pointers.deepest_paths(wanted)})
    parts = F.transform("paths", lambda p: F.struct(p.alias("path"), v.at_pointer(F.col("doc"), p).alias("value")))
    step = step.withColumn("parts", parts)
    missing = F.get(F.filter("parts", lambda x: x["value"].isNull()), F.lit(0))["path"]
    step = step.withColumns({"missing": missing, "context": F.to_json(F.col("parts"))})
    error = F.when(~F.col("location").startswith("/"), "no_location").when(
        F.col("missing").isNotNull(), F.concat(F.lit("missing "), F.col("missing"))
    )
    if limit is not None:
        error = error.when(F.length("context") > limit, "too_long")
    return step.withColumn("context_error", error).drop("parts", "missing")


def repair_request(selected: DataFrame) -> DataFrame:
    """Request rows for issues that a scoped patch may fix; schema fixes go to the fast model."""
    intent = F.coalesce(F.col("repair_intent"), default_intent(F.col("category")))
    scoped = selected.withColumn("repair_intent", intent).filter(intent.isin(dims.SCOPED_INTENTS))
    tier = F.when(F.col("repair_intent") == "fix_schema", "fast").otherwise("strong")
    return repair_context(scoped).withColumns({"stage": F.lit("repair"), "model_tier": tier})


def planned_type(plan: Column, item_pos: Column, inter_pos: Column) -> Column:
    """The type a plan object foresees for an item, counted over all questions, and one of its interactions."""
    questions = F.filter(v.elements(F.when(v.is_object(plan), v.get(plan, "plan"))), v.is_object)
    items = F.flatten(
        F.transform(questions, lambda q: F.filter(v.listed(q, "questionItems"), v.is_object))
    )
    inter = F.get(v.elements(v.get(F.get(items, item_pos), "interactions")), inter_pos)
    return v.truthy_at(inter, "interactionType")
