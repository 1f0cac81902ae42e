"""Object rules: over nested documents and over stored relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica import dims
from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.operators import census, rules_object

CHOICE = "('single_choice', 'multiple_choice')"


def checked(spark, sf):
    docs = rel.objects(spark, sf)
    return docs, rules_object.check_object(docs)


@query("check_object_rules", rel.object_sql("SELECT rule, severity, count(*) AS n FROM found GROUP BY rule, severity"))
def check_object_rules(spark, sf):
    """Every rule on every nested document, counted."""
    return checked(spark, sf)[1].groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("check_object_issues", rel.object_sql("SELECT k AS doc_id, rule, severity, count(*) AS n FROM found GROUP BY ALL"))
def check_object_issues(spark, sf):
    return checked(spark, sf)[1].groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


ROLLUP_SQL = (
    "SELECT d.k AS doc_id, d.k % 4 AS n_items, (SELECT count(*) FROM ia WHERE ia.k = d.k) AS n_interactions, "
    "coalesce(f.n, 0) AS n_issues, coalesce(f.b, 0) AS n_bad, coalesce(f.b, 0) = 0 AS valid FROM d LEFT JOIN "
    "(SELECT k, count(*) AS n, count(*) FILTER (WHERE severity = 'bad') AS b FROM found GROUP BY k) f ON f.k = d.k"
)


@query("check_object_rollup", rel.object_sql(ROLLUP_SQL))
def check_object_rollup(spark, sf):
    return rules_object.check_object_rollup(rel.objects(spark, sf))


@query(
    "check_objects_summary",
    rel.object_sql(
        "SELECT count(*) AS n_docs, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(n_interactions) AS BIGINT) AS n_interactions, "
        f"CAST(sum(n_issues) AS BIGINT) AS n_issues, CAST(sum(n_bad) AS BIGINT) AS n_bad, bool_and(valid) AS valid FROM ({ROLLUP_SQL}) r"
    ),
)
def check_objects_summary(spark, sf):
    return rules_object.check_objects_summary(rules_object.check_object_rollup(rel.objects(spark, sf)))


@query(
    "payload_counts",
    rel.object_sql(
        "SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM it) AS n_items, "
        "(SELECT count(*) FROM ia) AS n_interactions, (SELECT count(*) FROM found) AS n_issues"
    ),
)
def payload_counts(spark, sf):
    return rules_object.payload_counts(rel.objects(spark, sf))


@query(
    "dup_interaction_ids",
    rel.with_sql(
        "inter",
        "SELECT doc_id, iid, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, iid ORDER BY pos) AS n FROM inter) t WHERE n > 1",
    ),
)
def dup_interaction_ids(spark, sf):
    return rules_object.repeated_interactions(rel.inter(spark, sf, with_pos=True)).select("doc_id", "iid", "pos")


@query("unknown_types", rel.with_sql("inter", "SELECT doc_id, item, iid, pk, sk, itype FROM inter WHERE itype = 'unknown_type'"))
def unknown_types(spark, sf):
    return rules_object.unknown_types(rel.inter(spark, sf)).select("doc_id", "item", "iid", "pk", "sk", "itype")


@query(
    "choice_option_rules",
    rel.with_sql(
        "inter opt",
        "SELECT i.doc_id, i.pos, CASE WHEN count(o.k) = 0 THEN 'G26' ELSE 'G27' END AS rule FROM inter i "
        "LEFT JOIN opt o ON o.doc_id = i.doc_id AND o.pos = i.pos "
        f"WHERE i.itype IN {CHOICE} GROUP BY i.doc_id, i.pos HAVING count(o.k) < 2",
    ),
)
def choice_option_rules(spark, sf):
    return rules_object.choice_option_rules(rel.choice_inter(spark, sf)).select("doc_id", "pos", "rule")


@query(
    "dup_option_text",
    rel.with_sql(
        "inter opt",
        "SELECT doc_id, pos FROM opt GROUP BY doc_id, pos HAVING count(opt_text) > count(DISTINCT lower(opt_text))",
    ),
)
def dup_option_text(spark, sf):
    return rules_object.repeated_option_text(rel.choice_inter(spark, sf)).select("doc_id", "pos")


@query(
    "missing_specs",
    rel.with_sql(
        "inter spec",
        "SELECT doc_id, item, iid, pk, sk, CASE WHEN itype IN ('essay', 'short_answer') THEN 'needs_review' ELSE 'bad' END AS severity "
        "FROM inter i WHERE NOT EXISTS (SELECT 1 FROM spec s WHERE s.doc_id = i.doc_id AND s.item = i.item AND s.ref_iid = i.iid)",
    ),
)
def missing_specs(spark, sf):
    found = rules_object.missing_specs(rel.inter(spark, sf), rel.spec(spark, sf))
    return found.select("doc_id", "item", "iid", "pk", "sk", "severity")


@query(
    "orphan_specs",
    rel.with_sql(
        "inter spec",
        "SELECT doc_id, item, ref_iid, pk, sk FROM spec s WHERE NOT EXISTS "
        "(SELECT 1 FROM inter i WHERE i.doc_id = s.doc_id AND i.item = s.item AND i.iid = s.ref_iid)",
    ),
)
def orphan_specs(spark, sf):
    found = rules_object.orphan_specs(rel.spec(spark, sf), rel.inter(spark, sf))
    return found.select("doc_id", "item", "ref_iid", "pk", "sk")


FIRST = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item, iid ORDER BY pos) AS n FROM inter) t WHERE n = 1"
)


def joined(spark, sf):
    index = rules_object.interaction_index(rel.inter(spark, sf, with_pos=True).select("doc_id", "item", "iid", "itype", "pos"))
    return rules_object.specs_with_interaction(rel.spec(spark, sf), index)


@query(
    "spec_type_mismatch",
    rel.with_sql(
        "inter spec",
        "SELECT s.doc_id, s.item, s.ref_iid AS iid, s.pk, s.sk, s.stype, f.itype FROM spec s JOIN first_use f "
        "ON f.doc_id = s.doc_id AND f.item = s.item AND f.iid = s.ref_iid WHERE s.stype <> f.itype",
        first_use=FIRST,
    ),
)
def spec_type_mismatch(spark, sf):
    return rules_object.spec_type_mismatch(joined(spark, sf)).select("doc_id", "item", "iid", "pk", "sk", "stype", "itype")


def answers(spark, sf, itype):
    """Choice interactions with their options next to the correct ids of their specs."""
    index = rules_object.interaction_index(rel.choice_inter(spark, sf))
    spec = rel.spec(spark, sf).withColumn(
        "correct",
        F.when(F.col("pk") % 16 == 0, F.array().cast("array<string>"))
        .when(F.col("sk") % 3 == 0, F.array(F.col("correct_opt"), F.lit("A")))
        .otherwise(F.array(F.col("correct_opt"))),
    )
    found = rules_object.choice_answer_rules(rules_object.specs_with_interaction(spec, index), itype)
    return found.groupBy("doc_id", "item", "iid", "rule").agg(F.count("*").alias("n"))


def answers_sql(itype, none, amount, unknown, wrong):
    return rel.with_sql(
        "inter opt spec",
        f"SELECT doc_id, item, iid, rule, count(*) AS n FROM ("
        f"SELECT doc_id, item, iid, '{none}' AS rule FROM s WHERE len(correct) = 0 "
        f"UNION ALL SELECT doc_id, item, iid, '{amount}' FROM s WHERE {wrong} "
        f"UNION ALL SELECT doc_id, item, iid, '{unknown}' FROM (SELECT *, unnest(correct) AS c FROM s) u "
        "WHERE len(ids) > 0 AND NOT list_contains(ids, c)) t GROUP BY doc_id, item, iid, rule",
        first_use=FIRST + f" AND itype IN {CHOICE}",
        ids="SELECT doc_id, pos, list(opt_id) AS ids FROM opt GROUP BY doc_id, pos",
        s="SELECT p.doc_id, p.item, p.ref_iid AS iid, CASE WHEN p.pk % 16 = 0 THEN [] WHEN p.sk % 3 = 0 THEN [p.correct_opt, 'A'] "
        "ELSE [p.correct_opt] END AS correct, coalesce(o.ids, []) AS ids FROM spec p JOIN choice_first f ON f.doc_id = p.doc_id "
        f"AND f.item = p.item AND f.iid = p.ref_iid LEFT JOIN ids o ON o.doc_id = f.doc_id AND o.pos = f.pos WHERE f.itype = '{itype}'",
    ).replace(
        "first_use AS (" + FIRST + f" AND itype IN {CHOICE}" + ")",
        "choice_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item, iid ORDER BY pos) AS n "
        f"FROM inter WHERE itype IN {CHOICE}) t WHERE n = 1)",
    )


@query(
    "single_choice_answers",
    answers_sql("single_choice", "G36", "G37", "G38", "len(list_distinct(correct)) > 1"),
)
def single_choice_answers(spark, sf):
    return answers(spark, sf, "single_choice")


@query(
    "multi_choice_answers",
    answers_sql("multiple_choice", "G39", "G40", "G41", "len(list_distinct(correct)) = 1"),
)
def multi_choice_answers(spark, sf):
    return answers(spark, sf, "multiple_choice")


@query(
    "coordinate_slots",
    rel.with_sql(
        "inter spec",
        "SELECT rule, detail, count(*) AS n FROM (SELECT 'G44' AS rule, NULL AS detail FROM s WHERE sk % 3 = 0 "
        "UNION ALL SELECT 'G45', 'p' || (pk % 4) FROM s WHERE pk % 4 > 1) t GROUP BY rule, detail",
        first_use=FIRST,
        s="SELECT p.* FROM spec p JOIN first_use f ON f.doc_id = p.doc_id AND f.item = p.item AND f.iid = p.ref_iid WHERE f.itype = 'coordinate_input'",
    ),
)
def coordinate_slots(spark, sf):
    with_slots = joined(spark, sf).withColumns(
        {
            "dimensions": (F.col("sk") % 3).cast("int"),
            "slots": F.array(F.lit("p0"), F.lit("p1")),
            "slot_refs": F.array(F.concat(F.lit("p"), (F.col("pk") % 4).cast("string"))),
        }
    )
    return rules_object.coordinate_rules(with_slots).groupBy("rule", "detail").agg(F.count("*").alias("n"))


@query(
    "empty_items",
    rel.with_sql(
        "q inter",
        "SELECT q.doc_id, f.item FROM q, (VALUES ('A'), ('N'), ('R')) f(item) WHERE NOT EXISTS "
        "(SELECT 1 FROM inter i WHERE i.doc_id = q.doc_id AND i.item = f.item)",
    ),
)
def empty_items(spark, sf):
    items = rel.q(spark, sf).select("doc_id", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("item"))
    return rules_object.empty_items(items, rel.inter(spark, sf), ["doc_id", "item"])


@query(
    "essay_rules",
    rel.with_sql(
        "q inter spec",
        "SELECT doc_id, item, iid, pk, sk, unnest(CASE WHEN length(prio) < 8 AND n = 0 THEN ['G46', 'G47'] WHEN length(prio) < 8 THEN ['G46'] "
        "WHEN n = 0 THEN ['G47'] ELSE [] END) AS rule FROM (SELECT i.*, q.prio || '' AS prio, "
        "(SELECT count(*) FROM spec s WHERE s.doc_id = i.doc_id AND s.item = i.item) AS n FROM inter i JOIN q ON q.doc_id = i.doc_id "
        "WHERE i.itype = 'essay') t",
    ),
)
def essay_rules(spark, sf):
    """Essays whose stem, the order priority padded to the limit of the rule, is short or that nothing can grade."""
    inter, spec = rel.inter(spark, sf), rel.spec(spark, sf)
    stem = F.when(F.length("prio") < 8, F.col("prio")).otherwise(F.rpad("prio", 20, "."))
    stems = rel.q(spark, sf).select("doc_id", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("item"), stem.alias("stem_text"))
    return rules_object.essay_rules(inter, spec, stems).select("doc_id", "item", "iid", "pk", "sk", "rule")


@query(
    "block_rules",
    rel.with_sql(
        "nodes",
        "SELECT doc_id, pos, 'G05' AS rule FROM nodes WHERE pos % 11 = 0 UNION ALL SELECT doc_id, pos, 'G06' FROM nodes WHERE pos % 7 = 6 "
        "UNION ALL SELECT doc_id, pos, 'G07' FROM nodes WHERE pos % 7 < 5 AND trim(text, chr(9) || chr(13) || ' ') = '' "
        "UNION ALL SELECT doc_id, pos, 'G08' FROM nodes WHERE pos % 7 = 5 AND pos % 2 = 0",
    ),
)
def block_rules(spark, sf):
    blocks = rel.nodes(spark, sf).select(
        "doc_id",
        "pos",
        F.when(F.col("pos") % 11 == 0, " ").otherwise("b").alias("block_id"),
        F.when(F.col("pos") % 7 < 5, "text").when(F.col("pos") % 7 == 5, "graph").otherwise("").alias("block_type"),
        "text",
        (F.col("pos") % 2 == 1).alias("has_display"),
    )
    return rules_object.block_rules(blocks).select("doc_id", "pos", "rule")


# --- census ------------------------------------------------------------------------------------------------------

CENSUS_COUNTS = (
    "SELECT 'records' AS name, count(*) AS n FROM d UNION ALL SELECT 'generatedQuestions', count(*) FROM d "
    "UNION ALL SELECT 'instructionBlocks', count(*) FROM d WHERE k % 17 <> 0 "
    "UNION ALL SELECT 'solutions', count(*) FROM d WHERE k % 5 <> 0 UNION ALL SELECT 'solutionBlocks', 2 * count(*) FROM d WHERE k % 5 <> 0 "
    "UNION ALL SELECT 'questionItems', count(*) FROM it UNION ALL SELECT 'stemBlocks', count(*) FROM it "
    "UNION ALL SELECT 'hints', count(*) FROM it UNION ALL SELECT 'hintBlocks', count(*) FROM it "
    "UNION ALL SELECT 'interactions', count(*) FROM ia UNION ALL SELECT 'answerSpecs', count(*) FROM sp"
)


def object_census(spark, sf):
    return census.key_census(rel.objects(spark, sf).select(F.col("doc").alias("record")))


@query("census_counts", rel.object_sql(CENSUS_COUNTS, upto="sp"))
def census_counts(spark, sf):
    return object_census(spark, sf).filter(F.col("facet") == "count").select("name", "n")


CENSUS_TYPES = (
    "SELECT 'interaction_type' AS facet, itype AS name, count(*) AS n FROM ia GROUP BY itype "
    "UNION ALL SELECT 'spec_type', stype, count(*) FROM sp GROUP BY stype "
    "UNION ALL SELECT 'expected_shape', 'dict', count(*) FROM sp "
    "UNION ALL SELECT 'block_type', 'text', (SELECT count(*) FROM d WHERE k % 17 <> 0) + (SELECT 2 * count(*) FROM d WHERE k % 5 <> 0) + (SELECT 2 * count(*) FROM it)"
)


@query("census_types", rel.object_sql(CENSUS_TYPES, upto="sp"))
def census_types(spark, sf):
    kept = F.col("facet").isin("interaction_type", "spec_type", "expected_shape", "block_type")
    return object_census(spark, sf).filter(kept).select("facet", "name", "n")


CENSUS_KEYS = (
    "SELECT 'key' AS facet, name, unnest(keys) AS key FROM (VALUES "
    "('record', ['id', 'instruction', 'questionItems', 'solutions']), ('generatedQuestion', ['id', 'instruction', 'questionItems', 'solutions']), "
    "('questionItem', ['id', 'stem', 'interactions', 'answerSpecs', 'hints']), ('interaction', ['id', 'type', 'config', 'display']), "
    "('answerSpec', ['interactionId', 'type', 'expected']), ('hint', ['name', 'content']), ('solution', ['solverName', 'solutionContent']), "
    "('contentBlock', ['id', 'type', 'text'])) t(name, keys) "
    "UNION ALL SELECT DISTINCT 'config_key', itype, unnest(['options', 'dimensions', 'slots']) FROM ia "
    "UNION ALL SELECT DISTINCT 'display_key', itype, 'width' FROM ia"
)


@query("census_keys", rel.object_sql(CENSUS_KEYS, upto="ia"))
def census_keys(spark, sf):
    kept = F.col("facet").isin("key", "config_key", "display_key")
    return object_census(spark, sf).filter(kept).select("facet", "name", "key")


@query(
    "census_report",
    rel.object_sql(
        f"SELECT 1 AS section_no, 'Counts' AS section, name, 0::INT AS part, CAST(n AS VARCHAR) AS value FROM ({CENSUS_COUNTS}) c "
        "UNION ALL SELECT CASE facet WHEN 'interaction_type' THEN 3 WHEN 'spec_type' THEN 4 WHEN 'expected_shape' THEN 5 ELSE 6 END, "
        "CASE facet WHEN 'interaction_type' THEN 'Interaction Types' WHEN 'spec_type' THEN 'Answer Spec Types' "
        f"WHEN 'expected_shape' THEN 'Expected Shapes' ELSE 'Content Block Types' END, name, 0::INT, CAST(n AS VARCHAR) FROM ({CENSUS_TYPES}) y "
        "UNION ALL SELECT CASE facet WHEN 'key' THEN 2 WHEN 'config_key' THEN 7 ELSE 8 END, CASE facet WHEN 'key' THEN 'Field Keys' "
        "WHEN 'config_key' THEN 'Config Keys By Interaction Type' ELSE 'Display Keys By Interaction Type' END, name, 0::INT, "
        f"string_agg(key, ', ' ORDER BY key) FROM ({CENSUS_KEYS}) x GROUP BY facet, name",
        upto="sp",
    ),
)
def census_report(spark, sf):
    return census.census_report(object_census(spark, sf))


@query(
    "type_hist",
    rel.with_sql(
        "inter",
        "SELECT t.itype, t.status, count(i.doc_id) AS n FROM (VALUES "
        + ", ".join(f"('{k}', '{s}')" for k, s in dims.INTERACTION_STATUS.items())
        + ") t(itype, status) LEFT JOIN inter i ON i.itype = t.itype GROUP BY t.itype, t.status",
    ),
)
def type_hist(spark, sf):
    return census.type_hist(rel.inter(spark, sf))
