"""From nested documents to relations, one generator per level and no shuffle.

`docs` is (doc_id, doc VARIANT). Every relation keeps the position of its elements, since a table has no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import variants as v
from rubrica.functions.expressions import built_once, spread
from rubrica.functions.text import strip
from rubrica.operators import object_walk


def items(docs: DataFrame) -> DataFrame:
    doc_specs = v.listed(F.col("doc"), "answerSpecs").alias("doc_specs")
    return spread(docs, ["doc_id", doc_specs], v.listed(F.col("doc"), "questionItems"), "item", "item_pos")


def interaction_fields(value: Column) -> dict[str, Column]:
    return {
        "iid": v.first_text(value, "id", "_id", "interactionId"),
        "itype": v.first_text(value, "type", "interactionType"),
        "options": F.transform(v.options_of(value), option_struct),
    }


def option_struct(option: Column) -> Column:
    """Id and display text of one option, which may also be a bare value."""
    plain = strip(F.coalesce(v.truthy_text(option), F.lit("")))
    nested = v.is_object(option)
    shown = F.coalesce(
        F.nullif(v.content_text(option), F.lit("")), strip(F.coalesce(v.truthy_at(option, "id"), F.lit("")))
    )
    return F.struct(
        F.when(nested, v.first_text(option, "id", "value", "key")).otherwise(plain).alias("id"),
        F.when(nested, shown).otherwise(plain).alias("text"),
    )


def interactions(docs: DataFrame) -> DataFrame:
    inner = items(docs).filter(v.is_object(F.col("item")))
    exploded = spread(inner, ["doc_id", "item_pos"], v.listed(F.col("item"), "interactions"), "inter", "inter_pos")
    return exploded.withColumns(interaction_fields(F.col("inter")))


def options(docs: DataFrame) -> DataFrame:
    keep = ["doc_id", "item_pos", "inter_pos", "iid", "itype"]
    return spread(interactions(docs), keep, F.col("options"), "opt", "opt_pos").select("doc_id", "item_pos", "inter_pos", "iid", "itype", "opt_pos", "opt.id", "opt.text")


def specs(docs: DataFrame) -> DataFrame:
    """Answer specs of each item; specs of the whole document follow those of every item."""
    inner = items(docs).filter(v.is_object(F.col("item")))
    own = v.listed(F.col("item"), "answerSpecs")
    keep = ["doc_id", "item_pos", F.size(own).alias("n_own")]
    return spread(inner, keep, F.concat(own, F.col("doc_specs")), "spec", "spec_pos").select(
        "doc_id",
        "item_pos",
        "spec_pos",
        (F.col("spec_pos") >= F.col("n_own")).alias("doc_level"),
        v.first_text(F.col("spec"), "interactionId").alias("ref_iid"),
        v.first_text(F.col("spec"), "type").alias("stype"),
        "spec",
    )


def hints(docs: DataFrame) -> DataFrame:
    inner = items(docs).filter(v.is_object(F.col("item")))
    return spread(inner, ["doc_id", "item_pos"], v.listed(F.col("item"), "hints"), "hint", "hint_pos")


def solutions(docs: DataFrame) -> DataFrame:
    return spread(docs, ["doc_id"], v.listed(F.col("doc"), "solutions"), "solution", "solution_pos")


def flatten_object(docs: DataFrame) -> dict[str, DataFrame]:
    return {
        "items": items(docs).drop("doc_specs"),
        "interactions": interactions(docs),
        "options": options(docs),
        "specs": specs(docs),
        "hints": hints(docs),
        "solutions": solutions(docs),
    }


def plan_entries(plan: Column) -> Column:
    """The list of a plan that is either the list itself or an object with one."""
    return F.coalesce(v.as_array(plan), F.try_variant_get(plan, "$.plan", "array<variant>"))


def flatten_plan(records: DataFrame) -> DataFrame:
    """One row per interaction of each plan (record_id, record VARIANT); empty levels give no rows."""
    questions = records.select(
        "record_id",
        F.posexplode(F.coalesce(plan_entries(v.get(F.col("record"), "question_plan")), v.elements(F.lit(None).cast("variant")))).alias(
            "question_pos", "question"
        ),
    )
    inner = questions.select(
        "record_id",
        "question_pos",
        F.posexplode(v.elements(v.present_alias(F.col("question"), "questionItems", "question_items"))).alias(
            "item_pos", "item"
        ),
    )
    leaves = inner.select(
        "record_id",
        "question_pos",
        "item_pos",
        F.posexplode(v.listed(F.col("item"), "interactions")).alias("inter_pos", "inter"),
    )
    return leaves.select(
        "record_id",
        "question_pos",
        "item_pos",
        "inter_pos",
        v.string_of(v.present_alias(F.col("inter"), "interactionType", "interaction_type")).alias("itype"),
        "inter",
    )


def path_table(docs: DataFrame) -> DataFrame:
    """Every node of every document; a single generator over a row-local walk."""
    return spread(docs, ["doc_id"], v.nodes(F.col("doc")), "n").select(
        "doc_id", "n.pointer", "n.key", "n.depth", "n.ord", "n.kind", "n.value"
    )


def find_values(docs: DataFrame, key: str) -> DataFrame:
    return path_table(docs).filter(F.col("key") == key).select("doc_id", "pointer", "kind", "value")


NODES = "array<struct<pointer:string,role:string,itype:string,text:string>>"


@built_once
def text_nodes_of(column: str) -> Column:
    """All text-bearing blocks of the document in a column as an array, in reading order."""
    return F.arrow_udf(object_walk.texts_of, NODES)(F.to_json(F.col(column)))


def text_nodes(docs: DataFrame) -> DataFrame:
    return spread(docs, ["doc_id"], text_nodes_of("doc"), "n", "pos").select(
        "doc_id", "pos", "n.pointer", "n.role", "n.itype", "n.text"
    )


def document_id(doc: Column, index: Column) -> Column:
    """`id`, else `_id`, else the position of the document in its batch."""
    own = F.coalesce(v.truthy_at(doc, "id"), v.truthy_at(doc, "_id"))
    return F.coalesce(
        F.nullif(strip(own), F.lit("")), F.concat(F.lit("item["), index.cast("string"), F.lit("]"))
    )
