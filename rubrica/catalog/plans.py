"""Plan rules, the strict gate, coverage and plan reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica import dims
from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.functions import text as t, variants as v
from rubrica.functions.expressions import kept
from rubrica.operators import consensus, contracts, coverage, requests, rollup, rules_object, rules_plan

ERROR_TYPE = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{r[0]}'" for k, r in rules_plan.RULES.items()) + " END"
MESSAGE = (
    "CASE rule "
    + " ".join(
        f"WHEN '{k}' THEN '{r[1]}'" for k, r in rules_plan.RULES.items() if "{}" not in r[1]
    )
    + " WHEN 'L18' THEN 'Interaction type riddle is not valid.' "
    + "WHEN 'L20' THEN 'Orders repeat: ' || CASE WHEN field LIKE '%interactionOrder' THEN '0' ELSE '1' END END"
)


def checked(spark, sf):
    records = rel.plan_records(spark, sf)
    return records, rules_plan.check_plan(records)


@query(
    "plan_check_issues",
    rel.plan_sql(f"SELECT k AS record_id, rule, {ERROR_TYPE} AS error_type, field, {MESSAGE} AS message FROM found"),
)
def plan_check_issues(spark, sf):
    return checked(spark, sf)[1].select("record_id", "rule", "error_type", "field", "message")


@query(
    "plan_check_rollup",
    rel.plan_sql(
        "SELECT d.k AS record_id, n IS NULL AS structural_valid, CASE WHEN n IS NULL THEN 'structural_ok' ELSE 'structural_error' END AS status, "
        "coalesce(types[1], '') AS structural_error_type, coalesce(array_to_string(messages, '; '), '') AS reason, "
        "coalesce(array_to_string(lines, '; '), '') AS evidence, coalesce(n, 0) AS n_issues FROM d LEFT JOIN "
        f"(SELECT k, count(*) AS n, list({ERROR_TYPE} ORDER BY ord) AS types, list({MESSAGE} ORDER BY ord) AS messages, "
        f"list(field || ': ' || {MESSAGE} ORDER BY ord) AS lines FROM found GROUP BY k) f ON f.k = d.k"
    ),
)
def plan_check_rollup(spark, sf):
    return rules_plan.plan_check_rollup(rel.plan_records(spark, sf))


@query(
    "plan_structure_report",
    rel.plan_sql(
        "SELECT 'status' AS facet, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.k = d.k) THEN 'structural_error' ELSE 'structural_ok' END AS name, "
        f"count(*) AS n FROM d GROUP BY name UNION ALL SELECT 'error_type', {ERROR_TYPE}, count(*) FROM found GROUP BY 2"
    ),
)
def plan_structure_report(spark, sf):
    return rules_plan.plan_structure_report(rel.plan_records(spark, sf))


@query(
    "plan_duplicate_order",
    rel.with_sql("inter", 'SELECT doc_id, item, iid AS "order", count(*) AS n FROM inter GROUP BY doc_id, item, iid HAVING count(*) > 1'),
)
def plan_duplicate_order(spark, sf):
    children = rel.inter(spark, sf).withColumnRenamed("iid", "order")
    return rules_plan.duplicate_orders(children, ["doc_id", "item"], "order")


@query(
    "plan_empty_children",
    rel.plan_sql("SELECT k AS record_id, rule, field FROM found WHERE rule IN ('L06', 'L11', 'L15')"),
)
def plan_empty_children(spark, sf):
    return checked(spark, sf)[1].filter(F.col("rule").isin("L06", "L11", "L15")).select("record_id", "rule", "field")


@query(
    "plan_unknown_type",
    rel.with_sql("inter", "SELECT doc_id, item, iid, pk, sk, itype FROM inter WHERE itype IN ('essay', 'unknown_type')"),
)
def plan_unknown_type(spark, sf):
    found = rules_object.unknown_types(rel.inter(spark, sf), dims.PLAN_TYPES)
    return found.select("doc_id", "item", "iid", "pk", "sk", "itype")


@query(
    "plan_blank_fields",
    rel.plan_sql("SELECT k AS record_id, rule, field FROM found WHERE rule IN ('L01', 'L02', 'L09', 'L13', 'L17', 'L19')"),
)
def plan_blank_fields(spark, sf):
    blank = F.col("rule").isin("L01", "L02", "L09", "L13", "L17", "L19")
    return checked(spark, sf)[1].filter(blank).select("record_id", "rule", "field")


STRICT = (
    "SELECT k, 'marker' AS rule FROM d WHERE k % 41 IN (0, 1, 2) AND false "
    "UNION ALL SELECT k, 'not_object' FROM d WHERE k % 41 IN (0, 1, 2) "
    "UNION ALL SELECT k, 'plan_list' FROM d WHERE k % 41 = 3 "
    "UNION ALL SELECT k, 'blank' FROM pq WHERE (k + q) % 13 = 0 "
    "UNION ALL SELECT k, 'child_list' FROM pq WHERE (k + q) % 3 = 0 "
    "UNION ALL SELECT k, 'blank' FROM pi WHERE (k + q + m) % 11 = 0 "
    "UNION ALL SELECT k, 'child_list' FROM pi WHERE (k + q + m) % 3 = 0 "
    "UNION ALL SELECT k, 'interaction_type' FROM px WHERE itype IN ('', 'riddle') "
    "UNION ALL SELECT k, 'blank' FROM px WHERE (k + x) % 17 = 0"
)


@query("plan_strict", rel.plan_sql("SELECT k AS record_id, rule, count(*) AS n FROM strict GROUP BY k, rule", upto="px", strict=STRICT))
def plan_strict(spark, sf):
    plans = rel.plan_records(spark, sf).select("record_id", v.get(F.col("record"), "question_plan").alias("plan"))
    return rules_plan.check_plan_strict(plans).groupBy("record_id", "rule").agg(F.count("*").alias("n"))


def marked_plans(spark, sf):
    """Plans with patch keys, hedged texts and unknown keys at several depths."""
    item = F.when(F.col("doc_id") % 4 == 0, '{"itemOrder": 1, "requirement": "x hoặc y, tùy", "interactions": [], "before": {"after": 1}}')
    item = item.otherwise('{"itemOrder": 1, "requirement": "x", "interactions": [], "note": 1}')
    plan = F.concat(
        F.lit('{"type": "advanced_question_plan", "plan": [{"questionOrder": 1, "questionStatement": "s", "questionItems": ['), item, F.lit("]}]}")
    )
    return rel.q(spark, sf).select(F.col("doc_id").alias("record_id"), F.try_parse_json(plan).alias("plan"))


@query(
    "plan_banned_keys",
    "SELECT o_orderkey AS record_id, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['after', 'before', 'hoặc', 'tùy', 'before', 'interactions'] "
    "ELSE ['note', 'interactions'] END) AS detail, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['banned_key', 'banned_key', 'hedging', 'hedging', 'unknown_key', 'child_list'] "
    "ELSE ['unknown_key', 'child_list'] END) AS rule FROM orders",
)
def plan_banned_keys(spark, sf):
    return rules_plan.check_plan_strict(marked_plans(spark, sf)).select("record_id", "detail", "rule")


@query(
    "plan_preview_gate",
    "SELECT o_orderkey AS record_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 1 END AS BIGINT) AS n FROM orders",
)
def plan_preview_gate(spark, sf):
    """The earlier gate: no texts and no children are asked for."""
    found = rules_plan.check_plan_strict(marked_plans(spark, sf), require_text=False)
    return found.groupBy("record_id").agg(F.count("*").alias("n"))


@query(
    "planned_type",
    rel.plan_sql(
        "SELECT r.k AS record_id, r.pos AS item_pos, p.itype FROM (SELECT k, unnest([0, 2, 5]) AS pos FROM d) r LEFT JOIN "
        "(SELECT k, q, m, row_number() OVER (PARTITION BY k ORDER BY q, m) - 1 AS item_pos FROM pi) i ON i.k = r.k AND i.item_pos = r.pos "
        "LEFT JOIN (SELECT * FROM px WHERE x = 0 AND itype <> '') p ON p.k = i.k AND p.q = i.q AND p.m = i.m",
        upto="px",
    ),
)
def planned_type(spark, sf):
    """The type planned for the first interaction of the first, third and sixth item of each record."""
    records = rel.plan_records(spark, sf)
    wanted = records.select("record_id", "record", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("item_pos"))
    plan = v.get(F.col("record"), "question_plan")
    return wanted.select(
        "record_id", "item_pos", requests.planned_type(plan, F.col("item_pos"), F.lit(0)).alias("itype")
    )


@query(
    "plan_request",
    "SELECT doc_id AS record_id, b AS raw_question, "
    "b AS raw_answer FROM "
    "(SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS b FROM documents) t",
)
def plan_request(spark, sf):
    record = F.to_variant_object(F.struct(F.col("text").alias("question"), F.col("text").alias("answer"), F.col("source").alias("name")))
    records = rel.table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), record.alias("record"))
    return requests.plan_request(records).select("record_id", "raw_question", "raw_answer")


# --- coverage ------------------------------------------------------------------------------------------------------

REC = ["rec_lang", "rec_source"]


@query(
    "coverage_rollup",
    rel.with_sql(
        "cover",
        "SELECT rec_lang, rec_source, count(*) AS n_source, count(*) FILTER (WHERE coverage_state = 'present') AS n_covered, "
        "count(*) FILTER (WHERE coverage_state = 'absent') AS n_missing, count(*) FILTER (WHERE coverage_state = 'unclear') AS n_unclear, "
        "CASE WHEN bool_or(coverage_state = 'absent') THEN 'partial' WHEN bool_or(coverage_state = 'unclear') THEN 'unclear' ELSE 'full' END AS coverage_status "
        "FROM cover GROUP BY rec_lang, rec_source",
    ),
)
def coverage_rollup(spark, sf):
    return coverage.coverage_rollup(rel.cover(spark, sf), REC)


@query(
    "coverage_lists",
    rel.with_sql(
        "cover",
        "SELECT rec_lang, rec_source, unnest(CASE coverage_state WHEN 'present' THEN ['source', 'covered'] WHEN 'absent' THEN ['source', 'missing'] "
        "ELSE ['source'] END) AS list_name, subpart FROM cover",
    ),
)
def coverage_lists(spark, sf):
    return coverage.coverage_lists(rel.cover(spark, sf), REC)


@query(
    "missing_minus_present",
    rel.with_sql(
        "cover",
        "SELECT rec_lang, rec_source, subpart FROM cover WHERE coverage_state <> 'present' AND subpart % 5 <> 0",
    ),
)
def missing_minus_present(spark, sf):
    """All subparts but those the mapping finds, by state or because it names a place for them."""
    mapping = rel.cover(spark, sf).withColumn("n_locations", (F.col("subpart") % 5 == 0).cast("int"))
    return coverage.missing_minus_present(mapping.select(*REC, "subpart"), mapping, REC)


def evaluations(spark, sf):
    """One evaluation per conversation turn: its lines are issues, their first words the subparts, every second one present."""
    turns = rel.table(spark, sf, "conversations")
    lines = F.split("text", "\n", -1)
    issue = lambda s, i: F.struct(
        F.when(i % 2 == 0, "coverage_issue").otherwise("answerability_issue").alias("issue_type"),
        F.when(i % 3 == 0, "bad").otherwise("warning").alias("severity"),
        s.alias("summary"),
        F.lit("").alias("evidence"),
        F.lit("").alias("suggested_fix"),
        F.lit(None).cast("string").alias("recommended_action"),
    )
    part = lambda name, state: F.struct(name.alias("subpart"), state.alias("coverage_state"), F.lit(0).alias("n_locations"))
    words = F.transform(lines, lambda s: F.element_at(F.split(s, " "), 1))
    tail = F.concat(F.lit("tail "), "role")
    mapping = F.concat(F.transform(words, lambda w, i: part(w, F.when(i % 2 == 0, "present").otherwise("absent"))), F.array(part(tail, F.lit("absent"))))
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        F.transform(lines, issue).alias("issues"),
        mapping.alias("mapping"),
        F.concat(words, F.array(tail)).alias("missing"),
        F.lit("ok").alias("overall_status"),
        F.lit("full").alias("coverage_status"),
    )


def mentions_sql(low, part):
    """Whether the lower-case text `low` talks about `part`, as list expressions."""
    tokens = f"list_filter(string_split(trim(regexp_replace(translate(lower({part}), '()', '  '), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
    marker = "regexp_full_match(w, '[\\p{L}\\p{N}]')"
    named = f"regexp_matches({low}, '(?:{'|'.join(dims.MARKER_WORDS)})\\s+' || w || '\\b|\\b' || w || '[\\)\\.,:]')"
    return (
        f"CASE WHEN {part} <> '' AND contains({low}, lower({part})) THEN true WHEN len(list_filter({tokens}, lambda w: {marker})) > 0 "
        f"THEN len(list_filter({tokens}, lambda w: {marker} AND {named})) > 0 "
        f"ELSE len(list_filter({tokens}, lambda w: length(w) > 1)) > 0 AND len(list_filter({tokens}, lambda w: length(w) > 1 AND NOT contains({low}, w))) = 0 END"
    )


TURNS = (
    "SELECT *, list_filter(words, lambda w, i: i % 2 = 1) AS found, list_sort(list_distinct(list_filter(words, lambda w, i: i % 2 = 1))) AS present FROM ("
    "SELECT conv_id || '-' || turn AS record_id, role, string_split(text, chr(10)) AS lines, "
    "list_transform(string_split(text, chr(10)), lambda s: string_split(s, ' ')[1]) AS words FROM conversations) t"
)
LINES = "SELECT * EXCLUDE (lines), unnest(lines) AS line, CAST(unnest(range(len(lines))) AS INT) AS pos FROM turns"


@query(
    "mention_join",
    f"WITH turns AS ({TURNS}), n AS ({LINES}) SELECT record_id, pos, array_to_string(list_filter(list_concat(present, ['(a)', 'in der']), "
    f"lambda s: {mentions_sql('lower(line)', 's')}), '|') AS mentioned FROM n",
)
def mention_join(spark, sf):
    """Subparts each line mentions, by its words or by a one-letter marker."""
    found = evaluations(spark, sf).withColumn("subparts", F.concat(coverage.present_subparts(F.col("mapping")), F.array(F.lit("(a)"), F.lit("in der"))))
    pairs = found.select("record_id", "subparts", F.posexplode(F.transform("issues", lambda i: i["summary"])).alias("pos", "line"))
    hits = F.filter("subparts", lambda s: coverage.mentions(F.col("line"), s))
    return pairs.select("record_id", "pos", F.array_join(hits, "|").alias("mentioned"))


@query(
    "mention_containment",
    f"WITH turns AS ({TURNS}), n AS ({LINES}) SELECT record_id, pos, {mentions_sql('lower(line)', 'words[1]')} AS mentioned FROM n",
)
def mention_containment(spark, sf):
    """Lines that mention the first word of their turn."""
    turns = evaluations(spark, sf).withColumn("word", F.get("mapping", F.lit(0))["subpart"])
    lines = turns.select("record_id", "word", F.posexplode(F.transform("issues", lambda i: i["summary"])).alias("pos", "line"))
    return lines.select("record_id", "pos", coverage.mentions(F.col("line"), F.col("word")).alias("mentioned"))


@query(
    "coverage_consistency",
    f"WITH turns AS ({TURNS}), n AS ({LINES}), "
    f"c AS (SELECT *, pos % 2 = 0 AND len(list_filter(present, lambda s: s <> '' AND {mentions_sql('lower(line)', 's')})) > 0 AS gone FROM n), "
    "k AS (SELECT record_id, any_value(role) AS role, any_value(words) AS words, any_value(found) AS found, any_value(present) AS present, count(*) FILTER (WHERE NOT gone) AS n_issues, "
    "count(*) FILTER (WHERE gone) AS n_dropped, CASE WHEN bool_or(NOT gone AND pos % 3 = 0) THEN 'bad' WHEN bool_or(NOT gone) THEN 'warning' ELSE 'ok' END AS overall_status FROM c GROUP BY record_id) "
    "SELECT record_id, n_issues, array_to_string(list_append(list_filter(words, lambda w, i: list_position(words, w) = i AND NOT list_contains(present, w)), 'tail ' || role), '|') AS missing, "
    "array_to_string(found, '|') AS covered, array_to_string(present, '|') AS unlisted, n_dropped, 'partial' AS coverage_status, overall_status FROM k",
)
def coverage_consistency(spark, sf):
    found = coverage.coverage_consistency(evaluations(spark, sf))
    return found.select(
        "record_id",
        F.size("issues").alias("n_issues"),
        F.array_join("missing", "|").alias("missing"),
        F.array_join("covered", "|").alias("covered"),
        F.array_join("unlisted", "|").alias("unlisted"),
        "n_dropped",
        "coverage_status",
        "overall_status",
    )


def evaluation_replies(spark, sf):
    """Replies with a mapping of two subparts, one of them found although it is called missing."""
    state = F.get(F.array(F.lit("present"), F.lit("absent"), F.lit("odd")), (F.col("event_id") % 3).cast("int"))
    where = F.when(F.col("event_id") % 2 == 0, '[{"itemOrder": 1}]').otherwise("[]")
    mapping = F.concat(
        F.lit('[{"source_subpart": "alpha", "coverage_state": "'), state, F.lit('", "matched_plan_locations": '), where,
        F.lit('}, {"coverage_state": "present"}]'),
    )
    issue = F.concat(
        F.lit('[{"issue_type": "coverage_issue", "severity": "bad", "summary": "Alpha is missing"}, {"issue_type": "x", "severity": "'),
        F.when(F.col("event_id") % 5 == 0, "warning").otherwise("odd"),
        F.lit('", "summary": "other"}]'),
    )
    body = F.concat(F.lit('{"overall_status": "bad", "coverage_status": "full", "source_to_plan_mapping": '), mapping, F.lit(', "issues": '), issue, F.lit("}"))
    return rel.event_keys(spark, sf).select(F.col("event_id").alias("record_id"), F.try_parse_json(body).alias("reply"))


@query(
    "plan_eval_from_reply",
    "SELECT event_id AS record_id, CASE WHEN found THEN 1 ELSE 2 END AS n_issues, CASE WHEN NOT found AND m = 1 THEN 'alpha' ELSE '' END AS missing, "
    "CASE WHEN m = 0 OR (found AND m = 1) THEN 'alpha|source_subpart_2' ELSE 'source_subpart_2' END AS covered, "
    "CASE WHEN m = 1 AND NOT found THEN 'partial' WHEN m = 2 THEN 'unclear' ELSE 'full' END AS coverage_status, "
    "CASE WHEN NOT found THEN 'bad' WHEN event_id % 5 = 0 THEN 'warning' ELSE 'needs_review' END AS overall_status FROM "
    "(SELECT event_id, event_id % 3 AS m, event_id % 3 = 0 OR event_id % 2 = 0 AS found FROM events) t",
)
def plan_eval_from_reply(spark, sf):
    """From the reply to the consistent evaluation: a subpart with a place in the plan is not missing."""
    found = coverage.coverage_consistency(coverage.evaluations_from_replies(evaluation_replies(spark, sf)))
    return found.select(
        "record_id",
        F.size("issues").alias("n_issues"),
        F.array_join("missing", "|").alias("missing"),
        F.array_join("covered", "|").alias("covered"),
        "coverage_status",
        "overall_status",
    )


# --- evaluations and reports ---------------------------------------------------------------------------------------

STATUS_CASE = "CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'needs_review' WHEN 'click' THEN 'ok' WHEN 'view' THEN 'warning' ELSE 'odd' END"


def plan_events(spark, sf):
    """Plan evaluations and issues: each event is one."""
    return rel.table(spark, sf, "events").withColumns(
        {
            "overall_status": F.expr(STATUS_CASE),
            "coverage_status": F.when(F.col("event_id") % 3 == 0, "full").when(F.col("event_id") % 3 == 1, "partial"),
        }
    )


@query(
    "plan_summary_status",
    f"SELECT 'status' AS facet, {STATUS_CASE} AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL "
    "SELECT 'coverage', CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'unknown' END, count(*) FROM events GROUP BY 2",
)
def plan_summary_status(spark, sf):
    events = plan_events(spark, sf)
    issues = events.select(F.lit(None).cast("string").alias("issue_type"), F.lit(None).cast("string").alias("severity"))
    return rollup.plan_summary(events, issues).filter(F.col("facet").isin("status", "coverage"))


@query(
    "plan_summary_issues",
    "SELECT 'issue_type' AS facet, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL "
    f"SELECT 'severity', {STATUS_CASE}, count(*) FROM events GROUP BY 2",
)
def plan_summary_issues(spark, sf):
    events = plan_events(spark, sf)
    issues = events.select(F.col("event_type").alias("issue_type"), F.col("overall_status").alias("severity"))
    return rollup.plan_summary(events, issues).filter(F.col("facet").isin("issue_type", "severity"))


@query(
    "plan_totals",
    f"SELECT count(*) AS total_records, count(*) FILTER (WHERE s = 'ok') AS ok_count, 0::BIGINT AS skipped_due_to_source_issue_count, "
    "count(*) FILTER (WHERE s = 'warning') AS warning_count, count(*) FILTER (WHERE s = 'needs_review') AS needs_review_count, "
    "count(*) FILTER (WHERE s = 'bad') AS bad_count, 0::BIGINT AS structural_error_count, count(*) FILTER (WHERE s <> 'odd') AS counted_status_total, "
    f"count(*) FILTER (WHERE s <> 'ok') AS issue_records_count, count(*) FILTER (WHERE s <> 'odd') = count(*) AS count_consistency_valid FROM (SELECT {STATUS_CASE} AS s FROM events) t",
)
def plan_totals(spark, sf):
    return rollup.plan_totals(plan_events(spark, sf))


@query(
    "worst_status",
    f"SELECT user_id, worst_rank, CASE worst_rank WHEN 0 THEN 'ok' WHEN 2 THEN 'warning' WHEN 3 THEN 'needs_review' ELSE 'bad' END AS worst FROM ("
    f"SELECT user_id, CAST(max(CASE {STATUS_CASE} WHEN 'ok' THEN 0 WHEN 'warning' THEN 2 WHEN 'needs_review' THEN 3 WHEN 'bad' THEN 4 ELSE 2 END) AS INT) AS worst_rank "
    "FROM events GROUP BY user_id) t",
)
def worst_status(spark, sf):
    return rollup.worst_status(plan_events(spark, sf), ["user_id"], "overall_status")


@query(
    "needs_fallback",
    f"SELECT event_id, event_type = 'purchase' OR event_id % 10 = 0 OR {STATUS_CASE} IN ('needs_review', 'bad') AS needed FROM events",
)
def needs_fallback(spark, sf):
    confidence = F.when(F.col("event_id") % 10 == 0, "low").otherwise("high")
    needed = consensus.needs_fallback(F.col("event_type") != "purchase", confidence, F.col("overall_status"))
    return plan_events(spark, sf).select("event_id", needed.alias("needed"))


@query("repair_eligible", f"SELECT event_id, {STATUS_CASE} IN ('bad', 'needs_review', 'warning') AS eligible FROM events")
def repair_eligible(spark, sf):
    return plan_events(spark, sf).select(
        "event_id", consensus.repair_eligible(F.col("overall_status")).alias("eligible")
    )


SUMMARIES = ["coverage issue here", "The second part of the question has no item", "clarity", "decomposition issue", "interaction_type_issue", "The order of the steps is wrong in clarity"]


def _said(n_words, tail):
    """The first words of a line and, in every other line, something after them."""
    words = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " "), lambda w: w != ""), F.lit(1), n_words), " ")
    return F.btrim(F.concat(words, F.lit(" "), tail))


SAID = "trim(array_to_string(list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: w <> '')[1:{n}], ' ') || ' ' || {tail})"
TERMS = dims.TAXONOMY_TERMS + dims.GENERIC_PHRASES
_LIST = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]"
_TERM = f"CASE WHEN pos % 2 = 0 THEN {_LIST(TERMS)}[CAST((doc_id + pos) % {len(TERMS)} AS INT) + 1] ELSE '' END"


@query(
    "generic_summary",
    rel.with_sql(
        "nodes",
        "SELECT doc_id, pos, said <> '' AND (replace(low, ' ', '_') = kind OR len(list_filter(string_split(low, ' '), lambda w: w <> '')) <= 4 AND "
        f"len(list_filter({_LIST(dims.TAXONOMY_TERMS)}, lambda x: contains(replace(low, ' ', '_'), x))) > 0 OR len(list_filter({_LIST(dims.GENERIC_PHRASES)}, lambda x: contains(low, x))) > 0) AS generic FROM said",
        said=f"SELECT doc_id, pos, said, lower(said) AS low, {_LIST(dims.ISSUE_TYPES)}[CAST(doc_id % {len(dims.ISSUE_TYPES)} AS INT) + 1] AS kind FROM (SELECT doc_id, pos, {SAID.format(n='CAST(pos % 6 AS INT)', tail=_TERM)} AS said FROM nodes) t",
    ),
)
def generic_summary(spark, sf):
    """Summaries from the first words of every line, half of them with a term that names a kind of problem."""
    nodes = rel.nodes(spark, sf)
    pick = lambda values, n: F.get(F.array(*[F.lit(x) for x in values]), (n % len(values)).cast("int"))
    tail = F.when(F.col("pos") % 2 == 0, pick(TERMS, F.col("doc_id") + F.col("pos"))).otherwise("")
    said = _said((F.col("pos") % 6).cast("int"), tail)
    return nodes.select("doc_id", "pos", t.generic_summary(said, pick(dims.ISSUE_TYPES, F.col("doc_id"))).alias("generic"))


_HEDGED = f"CASE WHEN pos % 3 = 0 THEN upper({_LIST(dims.HEDGES)}[CAST(doc_id % 6 AS INT) + 1]) || ' ' || {_LIST(dims.HEDGES)}[CAST(pos % 6 AS INT) + 1] ELSE '' END"


@query(
    "ambiguous_phrase",
    rel.with_sql(
        "nodes",
        f"SELECT doc_id, pos, list_filter({_LIST(dims.HEDGES)}, lambda h: contains(lower(said), h))[1] AS phrase FROM (SELECT doc_id, pos, {SAID.format(n=8, tail=_HEDGED)} AS said FROM nodes) t",
    ),
)
def ambiguous_phrase(spark, sf):
    """The first words of every line, a third of them with two hedges in any order and case."""
    pick = lambda n: F.get(F.array(*[F.lit(h) for h in dims.HEDGES]), (n % 6).cast("int"))
    tail = F.when(F.col("pos") % 3 == 0, F.concat(F.upper(pick(F.col("doc_id"))), F.lit(" "), pick(F.col("pos")))).otherwise("")
    return rel.nodes(spark, sf).select("doc_id", "pos", t.ambiguous_phrase(_said(F.lit(8), tail)).alias("phrase"))


LEVEL = "CASE WHEN event_id % 4 = 0 THEN 'planet' ELSE 'item' END"


@query(
    "normalize_plan_eval",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'plan' ELSE 'item' END AS issue_level, "
    f"CASE WHEN {STATUS_CASE} IN ('warning', 'bad') THEN {STATUS_CASE} ELSE 'needs_review' END AS severity, "
    "'selected_scope_issue' AS issue_type, CASE WHEN event_id % 5 = 0 THEN 'low' ELSE 'medium' END AS confidence, "
    "event_id % 6 IN (0, 2, 3, 4) AS is_generic FROM events",
)
def normalize_plan_eval(spark, sf):
    events = plan_events(spark, sf)
    summary = F.get(F.array(*[F.lit(s) for s in SUMMARIES]), (F.col("event_id") % 6).cast("int"))
    issues = events.select(
        "event_id",
        F.expr(LEVEL).alias("issue_level"),
        F.col("overall_status").alias("severity"),
        F.col("event_type").alias("issue_type"),
        F.when(F.col("event_id") % 5 == 0, "low").otherwise("sure").alias("confidence"),
        summary.alias("summary"),
        F.lit("").alias("impact_on_generation"),
        F.lit(None).cast("boolean").alias("requires_human_review"),
    )
    return contracts.normalize_plan_issues(issues).select("event_id", "issue_level", "severity", "issue_type", "confidence", "is_generic")


@query(
    "structural_rows",
    rel.plan_sql(
        "SELECT k AS record_id, 'structural_error' AS overall_status, 'not_evaluable' AS coverage_status FROM d "
        "WHERE EXISTS (SELECT 1 FROM found f WHERE f.k = d.k) UNION ALL "
        "SELECT k, 'skipped_due_to_source_issue', 'not_evaluable' FROM d WHERE k % 37 = 0"
    ),
)
def structural_rows(spark, sf):
    """Prefilled rows of records with a bad structure, and of records whose question is blank."""
    records = rel.plan_records(spark, sf)
    cols = ["record_id", "overall_status", "coverage_status"]
    bad = contracts.structural_rows(records, rules_plan.plan_check_rollup(records)).select(*cols)
    blank = kept(records, v.content_text(v.get(F.col("record"), "question")) == "")
    return bad.unionByName(contracts.skipped_rows(blank).select(*cols))


REASON = "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN props ELSE 'other' END"


def texted(spark, sf):
    """Plan issues whose summary, evidence or type gives the reason, by user."""
    return rel.table(spark, sf, "events").select(
        F.col("user_id").alias("record_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("summary"),
        F.when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("").alias("evidence"),
        F.lit("other").alias("issue_type"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" fix "), "event_type")).otherwise("").alias("suggested_fix"),
        F.col("event_type").alias("recommended_action"),
    )


@query("reason_list", f"SELECT user_id AS record_id, {REASON} AS text, min(event_id) AS pos FROM events GROUP BY 1, 2")
def reason_list(spark, sf):
    return rollup.reason_list(texted(spark, sf), ["record_id"])


@query(
    "suggestion_list",
    "SELECT user_id AS record_id, CASE WHEN event_id % 2 = 0 THEN 'fix ' || event_type ELSE event_type END AS text, min(event_id) AS pos FROM events GROUP BY 1, 2",
)
def suggestion_list(spark, sf):
    return rollup.suggestion_list(texted(spark, sf), ["record_id"])


@query(
    "reasons_or_summary",
    f"SELECT user_id AS record_id, {REASON} AS text, min(event_id) AS pos FROM events GROUP BY 1, 2 UNION ALL "
    "SELECT c_custkey, c_mktsegment, 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
)
def reasons_or_summary(spark, sf):
    records = rel.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("summary"))
    return rollup.reasons_or_summary(records, rollup.reason_list(texted(spark, sf), ["record_id"]))


@query(
    "plan_result",
    "SELECT user_id AS record_id, 0::INT AS part, is_good, CASE WHEN is_good THEN '' ELSE coalesce(reasons, 'The plan is not good enough, but no reason was given.') END AS reasons, "
    "CASE WHEN is_good THEN '' ELSE coalesce(suggestions, '') END AS suggestions, CASE WHEN NOT is_good AND user_id % 2 = 0 THEN 'plan ' || user_id END AS new_plan, user_id % 5 = 0 AS is_loop, "
    "CAST(greatest(user_id % 6 - 2, 0) AS INT) AS loop_count FROM (SELECT user_id, user_id % 3 = 0 AS is_good FROM events GROUP BY user_id) u "
    f"LEFT JOIN (SELECT record_id, string_agg(text, '|' ORDER BY pos, text) AS reasons FROM (SELECT user_id AS record_id, {REASON} AS text, min(event_id) AS pos FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2) a GROUP BY 1) r ON r.record_id = user_id "
    "LEFT JOIN (SELECT record_id, string_agg(text, '|' ORDER BY pos, text) AS suggestions FROM (SELECT user_id AS record_id, CASE WHEN event_id % 2 = 0 THEN 'fix ' || event_type ELSE event_type END AS text, min(event_id) AS pos FROM events GROUP BY 1, 2) a GROUP BY 1) g ON g.record_id = user_id",
)
def plan_result(spark, sf):
    """Every user is a record, with the distinct reasons and suggestions of all its events; some have no reason."""
    found = texted(spark, sf)
    records = found.select("record_id").distinct().select(
        "record_id",
        (F.col("record_id") % 3 == 0).alias("is_good"),
        F.concat(F.lit("plan "), F.col("record_id").cast("string")).alias("candidate"),
        (F.col("record_id") % 2 == 0).alias("candidate_valid"),
        (F.col("record_id") % 5 == 0).alias("is_loop"),
        (F.col("record_id") % 6 - 2).alias("loop_count"),
    )
    reasons = rollup.reason_list(found.where(F.col("record_id") % 7 != 0), ["record_id"])
    rows = rollup.plan_result(records, reasons, rollup.suggestion_list(found, ["record_id"]))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("reasons", "suggestions")})
