"""Contracts of replies and decisions over repeated replies; events are replies, two runs per pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.functions import variants as v
from rubrica.operators import consensus, contracts, requests

KEYS = ["doc_id", "pair"]


def judge_runs(spark, sf):
    """Runs with a transition for most doubtful verdicts."""
    found = (F.col("verdict") != "good") & (F.col("to_order") > 0)
    return rel.runs(spark, sf).select(
        *KEYS,
        "run_no",
        "verdict",
        F.when(found, F.lit(0)).alias("sol"),
        F.when(found, F.col("to_order") - 1).alias("from_order"),
        F.when(found, F.col("to_order")).alias("to_order"),
    )


PAIRED = (
    "SELECT doc_id, pair, max(CASE WHEN run_no = 1 THEN verdict END) AS v1, max(CASE WHEN run_no = 2 THEN verdict END) AS v2, "
    "max(CASE WHEN run_no = 1 AND verdict <> 'good' AND to_order > 0 THEN to_order END) AS t1, "
    "max(CASE WHEN run_no = 2 AND verdict <> 'good' AND to_order > 0 THEN to_order END) AS t2, count(*) AS n_runs FROM runs GROUP BY doc_id, pair"
)
DECIDED = (
    "SELECT *, (v1 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT AS n_valid, coalesce(v1 = 'good' AND v2 = 'good', false) AS both_good, "
    "coalesce(v1 = 'bad' AND v2 = 'bad' AND t1 IS NOT DISTINCT FROM t2, false) AS both_bad, "
    "(v1 IS NULL AND v2 IS NULL) OR ((v1 IS NULL OR v2 IS NULL) AND coalesce(v1, v2) = 'good') AS runtime, "
    f"CASE WHEN v1 <> 'good' OR v2 <> 'good' THEN least(t1, t2) END AS t FROM ({PAIRED}) p"
)


@query("pair_runs", rel.with_sql("runs", f"SELECT doc_id, pair, v1 AS verdict_1, v2 AS verdict_2, n_runs FROM ({PAIRED}) p"))
def pair_runs(spark, sf):
    return consensus.pair_runs(rel.runs(spark, sf), KEYS, ["verdict"])


@query(
    "reconcile_judges",
    rel.with_sql(
        "runs",
        "SELECT doc_id, pair, n_valid, CASE WHEN n_valid < 2 THEN 'contract_failure' WHEN both_good OR both_bad THEN 'agreement' ELSE 'disagreement' END AS decision, "
        "both_good AS is_good, both_good OR both_bad AS confirmed, runtime AS is_runtime, CASE WHEN runtime OR both_good THEN NULL "
        "WHEN t IS NOT NULL THEN CASE WHEN t1 = t THEN 1 ELSE 2 END WHEN v1 <> 'good' THEN 1 WHEN v2 <> 'good' THEN 2 END AS chosen_run, "
        f"CASE WHEN NOT runtime THEN t END AS to_order FROM ({DECIDED}) d",
    ),
)
def reconcile_judges(spark, sf):
    return consensus.reconcile_judges(judge_runs(spark, sf), KEYS).drop("from_order")


@query(
    "judge_with_fallback",
    rel.with_sql(
        "q runs",
        "SELECT name AS doc_id, CASE WHEN fast OR strong THEN CASE WHEN ask THEN 'strong' ELSE 'fast' END ELSE 'strong' END AS model_tier, "
        "CAST(CASE WHEN fast OR strong THEN CASE WHEN fast THEN 1 ELSE 2 END + 2 + ask::INT ELSE 2 END AS INT) AS attempts, NOT fast OR ask AS fallback_called, "
        "CASE WHEN fast OR strong THEN 2 ELSE 0 END AS run_count, CASE WHEN fast OR strong THEN coalesce(NOT used AND (both_good OR both_bad) AND n_valid = 2, false) END AS agreement, "
        "CASE WHEN NOT (fast OR strong) THEN 'splitter_contract_failure' WHEN ask THEN 'judge_contract_failure' WHEN NOT fast THEN 'fast_splitter_contract_failure' END AS fallback_reason, "
        "CASE WHEN NOT (fast OR strong) THEN false WHEN used THEN doc_id % 2 = 0 ELSE coalesce(both_good, false) END AS is_good FROM ("
        "SELECT s.*, d.both_good, d.both_bad, coalesce(d.n_valid, 0) AS n_valid, (fast OR strong) AND coalesce(d.n_valid, 0) < 2 AS ask, "
        "(fast OR strong) AND coalesce(d.n_valid, 0) < 2 AND s.doc_id % 3 <> 0 AS used FROM s LEFT JOIN d ON d.name = s.name) t",
        s="SELECT *, doc_id % 5 <> 0 AS fast, doc_id % 10 <> 0 AS strong FROM (SELECT DISTINCT doc_id, doc_id || '/' || CAST(pair AS BIGINT) AS name FROM runs "
        "UNION ALL SELECT doc_id, doc_id || '/' FROM q)",
        d=f"SELECT *, doc_id || '/' || CAST(pair AS BIGINT) AS name FROM ({DECIDED}) x",
    ),
)
def judge_with_fallback(spark, sf):
    """Every pair of runs is a document of its own; every order is one without replies."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce(F.col("pair").cast("string"), F.lit("")))
    decided = consensus.reconcile_judges(judge_runs(spark, sf), KEYS)
    docs = decided.select(*KEYS).unionByName(rel.q(spark, sf).select("doc_id", F.lit(None).cast("bigint").alias("pair")))
    splits = docs.select(name.alias("doc_id"), (F.col("doc_id") % 5 != 0).alias("fast_ok"), (F.col("doc_id") % 10 != 0).alias("strong_ok"))
    verdict = F.when(F.col("doc_id") % 3 != 0, F.when(F.col("doc_id") % 2 == 0, "good").otherwise("bad"))
    strong = docs.select(name.alias("doc_id"), verdict.alias("verdict"), F.lit(0).alias("from_order"), F.lit(1).alias("to_order"))
    # Without runs nothing is valid, so the strong model is asked as well.
    return consensus.judge_with_fallback(splits, decided.withColumn("doc_id", name), strong).drop("to_order")


def signature(spark, sf):
    """Resolver replies in two wordings; half of them name other options."""
    e = F.col("event_id")
    base = e - e % 2
    reply = F.struct(
        F.lit("resolved").alias("status"),
        F.when(e % 2 == 0, F.concat(F.lit("The  Answer "), base.cast("string"))).otherwise(F.concat(F.lit(" the answer "), base.cast("string"))).alias("text"),
        F.when(base % 3 == 0, "A").alias("matched_option_id"),
        F.when(e % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.when(base % 4 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("correct_option_ids"),
        F.when(e % 2 == 0, '{"x": 1}').otherwise('{"x": 2}').alias("expected"),
        F.lit(True).alias("matches"),
        F.array().cast("array<struct<path:string,value:string>>").alias("fixes"),
        F.array().cast("array<struct<location:string,category:string,severity:string,repair_intent:string>>").alias("issues"),
    )
    return rel.table(spark, sf, "events").select("event_id", base.alias("base"), (e % 2 + 1).cast("int").alias("run_no"), consensus.resolver_signature(reply).alias("signature"))


@query(
    "resolver_signature",
    "SELECT event_id - event_id % 2 AS base, count(*) = 2 AS whole, CASE WHEN count(*) = 2 THEN (event_id - event_id % 2) % 4 = 0 ELSE true END AS same FROM events GROUP BY 1",
)
def resolver_signature(spark, sf):
    return signature(spark, sf).groupBy("base").agg(
        (F.count("*") == 2).alias("whole"), (F.min("signature") == F.max("signature")).alias("same")
    )


RESOLVED = "SELECT doc_id, pair, v1, v2, CASE WHEN v1 IS NULL THEN 'run_1_invalid' WHEN v2 IS NULL THEN 'run_2_invalid' WHEN v1 <> v2 THEN 'disagreement' END AS reason FROM"


@query(
    "reconcile_resolver",
    rel.with_sql(
        "runs",
        "SELECT doc_id, pair, reason AS fallback_reason, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN v1 = v2 END AS agreement, reason IS NOT NULL AS fallback_called, "
        f"CAST(2 + (reason IS NOT NULL)::INT AS INT) AS attempts, CASE WHEN reason IS NULL THEN 'run_1' ELSE 'fallback' END AS used FROM ({RESOLVED} ({PAIRED}) p) t",
    ),
)
def reconcile_resolver(spark, sf):
    runs = rel.runs(spark, sf).select(
        *KEYS, "run_no", F.col("verdict").isNotNull().alias("valid"), F.col("verdict").alias("signature"), F.lit(False).alias("unsure")
    )
    return consensus.reconcile_resolver(runs, KEYS)


@query(
    "reconcile_resolver_alone",
    rel.with_sql(
        "runs",
        f"SELECT doc_id, pair, reason AS fallback_reason, CASE WHEN reason = 'disagreement' THEN 'contract_error' ELSE 'run_1' END AS used FROM ({RESOLVED} ({PAIRED}) p) t",
    ),
)
def reconcile_resolver_alone(spark, sf):
    """The same without a fallback model."""
    runs = rel.runs(spark, sf).select(
        *KEYS, "run_no", F.col("verdict").isNotNull().alias("valid"), F.col("verdict").alias("signature"), F.lit(False).alias("unsure")
    )
    return consensus.reconcile_resolver(runs, KEYS, fallback=False).select(*KEYS, "fallback_reason", "used")


@query(
    "uncertain_review",
    "SELECT event_id, event_type = 'error' AND event_id % 3 < 2 AS unsure FROM events",
)
def uncertain_review(spark, sf):
    reasons = F.get(F.array(F.lit("Lời giải MƠ HỒ"), F.lit("em không chắc chắn"), F.lit("two conclusions")), (F.col("event_id") % 3).cast("int"))
    status = F.when(F.col("event_type") == "error", "needs_manual_review").otherwise("resolved")
    return rel.table(spark, sf, "events").select("event_id", consensus.uncertain_review(status, reasons).alias("unsure"))


REPLY_RANK = "CASE {c} WHEN 'ok' THEN 0 WHEN 'warning' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'bad' THEN 3 ELSE 2 END"
REPLY_STATUS = "CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'needs_review' WHEN 'click' THEN 'ok' ELSE 'warning' END"


@query(
    "choose_plan_reply",
    "SELECT record_id, policy, called AS fallback_called, CASE WHEN policy IN ('fallback_used_primary_invalid', 'conservative_more_severe_fallback') THEN s2 ELSE s1 END AS status, "
    "l1 + coalesce(l2, 0) AS latency FROM (SELECT *, CASE WHEN NOT called THEN 'primary_only' WHEN ok1 AND NOT ok2 THEN 'primary_used_fallback_invalid' "
    f"WHEN ok2 AND NOT ok1 THEN 'fallback_used_primary_invalid' WHEN {REPLY_RANK.format(c='s2')} > {REPLY_RANK.format(c='s1')} THEN 'conservative_more_severe_fallback' "
    "ELSE 'primary_retained' END AS policy FROM (SELECT a.event_id AS record_id, a.s AS s1, b.s AS s2, a.value AS l1, b.value AS l2, a.event_id % 4 <> 0 AS ok1, "
    "b.event_id % 6 <> 0 AS ok2, b.event_id IS NOT NULL AS called FROM e a LEFT JOIN e b ON b.event_id = a.event_id + 1 AND a.s IN ('bad', 'needs_review')) j) t".join(
        [f"WITH e AS (SELECT *, {REPLY_STATUS} AS s FROM events) ", ""]
    ),
)
def choose_plan_reply(spark, sf):
    """Each event is a first evaluation; the next event is the second one where the first asks for it."""
    events = rel.table(spark, sf, "events").withColumn("status", F.expr(REPLY_STATUS))
    primary = events.select(F.col("event_id").alias("record_id"), (F.col("event_id") % 4 != 0).alias("valid"), "status", F.col("value").alias("latency"))
    asking = primary.filter(F.col("status").isin("bad", "needs_review")).select("record_id")
    second = events.select((F.col("event_id") - 1).alias("record_id"), (F.col("event_id") % 6 != 0).alias("valid"), "status", F.col("value").alias("latency"))
    return consensus.choose_plan_reply(primary, second.join(asking, "record_id", "left_semi"))


# --- contracts -----------------------------------------------------------------------------------------------------


@query(
    "split_contract",
    "SELECT conv_id, turn, CASE WHEN m = 0 THEN NULL WHEN m = 1 THEN 'text changed at /solutions/0/solutionContent/0/text' WHEN m = 2 THEN 'states.0.order: has the wrong type or shape' "
    "WHEN m = 3 THEN 'orders of solution 0 have gaps' ELSE 'The reply holds no JSON object.' END AS error FROM (SELECT conv_id, turn, (conv_id + turn) % 5 AS m FROM conversations) t",
)
def split_contract(spark, sf):
    """Split replies for one block per turn: right, changed, of the wrong type, with a gap, and no JSON."""
    m = (F.col("conv_id") + F.col("turn")) % 5
    path = F.lit("/solutions/0/solutionContent/0/text")
    half = (F.length("text") / 2).cast("int")
    first, second = F.left("text", half), F.substr("text", half + 1)
    state = lambda order, text: F.to_json(F.struct(F.lit(0).alias("solution_index"), order.alias("order"), path.alias("source_path"), text.alias("source_text")))
    second = F.when(m == 1, F.concat(second, F.lit("."))).otherwise(second)
    body = F.concat(F.lit('{"states": ['), F.when(m == 2, state(F.lit("0"), first)).otherwise(state(F.lit(0), first)), F.lit(", "), F.when(m == 3, state(F.lit(2), second)).otherwise(state(F.lit(1), second)), F.lit("]}"))
    blocks = F.array(F.struct(F.lit(0).alias("solution_index"), F.lit(0).alias("rank"), path.alias("path"), F.col("text").alias("text")))
    replies = rel.table(spark, sf, "conversations").select("conv_id", "turn", F.when(m == 4, "no idea").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("content"), blocks.alias("blocks"))
    return contracts.check_split_replies(replies).select("conv_id", "turn", "error")


@query(
    "transition_reply_contract",
    "SELECT event_id, [NULL, 'stage_results.0.trang_thai_buoc: must be true or false', 'verdict: is not an allowed value', 'stage_results.0.extra: has the wrong type or shape', "
    "'suggestion: required field is missing'][CAST(event_id % 5 AS INT) + 1] AS error FROM events",
)
def transition_reply_contract(spark, sf):
    m = F.col("event_id") % 5
    stage = F.concat(
        F.lit('{"stage": 1, "from_order": 0, "to_order": 1, "kiem_tra_so_hoc": null, "kiem_tra_lap_luan": "fine", "reason": "", "trang_thai_buoc": '),
        F.when(m == 1, '"yes"').otherwise("true"),
        F.when(m == 3, ', "extra": 1').otherwise(""),
        F.lit("}"),
    )
    body = F.concat(
        F.lit('{"stage_results": ['), stage, F.lit('], "reason": "", '), F.when(m == 4, "").otherwise('"suggestion": "", '), F.lit('"verdict": "'), F.when(m == 2, "great").otherwise("good"), F.lit('"}')
    )
    replies = rel.table(spark, sf, "events").select("event_id", body.alias("content"))
    return contracts.parse_transition_replies(replies).select("event_id", "error")


RESOLVER_ERRORS = "[NULL, 'unknown_option', 'no_conclusion', 'bad_fix', 'match_with_fixes', 'mismatch_without_fixes', NULL, 'issues.0.severity: is not an allowed value']"


@query(
    "resolver_contract",
    f"SELECT event_id, {RESOLVER_ERRORS}[CAST(event_id % 8 AS INT) + 1] AS error, CASE WHEN event_id % 8 IN (0, 6) THEN 1 ELSE -1 END AS n_issues FROM events",
)
def resolver_contract(spark, sf):
    m = F.col("event_id") % 8
    answer = (
        F.when(m == 1, '{"matched_option_id": "Z"}')
        .when(m == 2, '{"text": "", "correctOptionIds": []}')
        .when(m == 6, '"the answer is five"')
        .otherwise('{"matched_option_id": "A", "evidence_from_solution": "so A"}')
    )
    fix = F.when(m == 3, '[{"path": "/questionItems/0/stem", "value": 1}]').when(m.isin(0, 4), '[{"path": "/questionItems/0/answerSpecs/0/expected/correctOptionId", "value": "A"}]').otherwise("[]")
    body = F.concat(
        F.lit('{"resolver_status": "resolved", "answerSpec_matches_solution": '),
        F.when(m.isin(4, 6), "true").otherwise("false"),
        F.lit(', "final_answer": '),
        answer,
        F.lit(', "fields_to_fix": '),
        fix,
        F.lit(', "issues": [{"severity": "'),
        F.when(m == 7, "awful").otherwise("bad"),
        F.lit('", "category": "solution_anchor_consistency", "location": "/x", "reason": "r", "suggestion": "s", "repair_intent": "needs_manual_review"}]}'),
    )
    doc = F.parse_json(F.lit('{"questionItems": [{"answerSpecs": [{"expected": {"correctOptionId": "B"}}], "stem": []}]}'))
    replies = rel.table(spark, sf, "events").select(
        "event_id", body.alias("content"), F.lit("five").alias("solution_text"), F.array(F.lit("A"), F.lit("B")).alias("known_options"), doc.alias("doc")
    )
    return contracts.check_resolver_replies(replies).select("event_id", "error", F.coalesce(F.size("issues"), F.lit(-1)).alias("n_issues"))


@query(
    "unknown_matched_option",
    rel.with_sql(
        "inter opt spec",
        "SELECT doc_id, correct_opt AS matched_option_id, count(*) AS n FROM spec s WHERE NOT EXISTS (SELECT 1 FROM opt o WHERE o.doc_id = s.doc_id AND o.opt_id = s.correct_opt) GROUP BY 1, 2",
    ),
)
def unknown_matched_option(spark, sf):
    replies = rel.spec(spark, sf).select("doc_id", F.col("correct_opt").alias("matched_option_id"))
    found = contracts.unknown_matched_options(replies, rel.opt(spark, sf))
    return found.groupBy("doc_id", "matched_option_id").agg(F.count("*").alias("n"))


@query(
    "repair_contract",
    "SELECT event_id, [NULL, 'unsafe_path', 'out_of_scope', 'no_patches', NULL, 'repair_status: is not an allowed value'][CAST(event_id % 6 AS INT) + 1] AS error, "
    "['repaired', 'needs_manual_review', 'needs_manual_review', 'needs_manual_review', 'failed', 'needs_manual_review'][CAST(event_id % 6 AS INT) + 1] AS repair_status FROM events",
)
def repair_contract(spark, sf):
    m = F.col("event_id") % 6
    path = F.when(m == 1, "/answer/x").when(m == 2, "/questionItems/0/stem/0/text").otherwise("/questionItems/0/hints/0")
    patches = F.when(m == 3, "[]").otherwise(F.concat(F.lit('[{"op": "remove", "path": "'), path, F.lit('"}]')))
    status = F.when(m == 4, "failed").when(m == 5, "done").otherwise("repaired")
    body = F.concat(F.lit('{"repair_status": "'), status, F.lit('", "patches": '), patches, F.lit("}"))
    replies = rel.table(spark, sf, "events").select("event_id", body.alias("content"), F.lit("align_hint_to_solution").alias("repair_intent"))
    return contracts.check_repair_replies(replies).select("event_id", "error", "repair_status")


@query(
    "spelling_contract",
    "SELECT event_id, pos, CASE WHEN event_id % 3 = 2 THEN 'needs_review' ELSE 'warning' END AS severity, CASE WHEN event_id % 3 = 2 THEN '/spelling' ELSE '/instruction/' || pos END AS location "
    "FROM (SELECT event_id, CAST(unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS INT) AS pos FROM events WHERE event_id % 3 <> 1) t",
)
def spelling_contract(spark, sf):
    """Replies with two issues, none, and a broken one."""
    m = F.col("event_id") % 3
    issue = lambda n: f'{{"severity": "warning", "location": "$.instruction[{n}]", "reason": "r", "suggestion": "s"}}'
    body = F.when(m == 0, f'{{"issues": [{issue(0)}, {issue(1)}]}}').when(m == 1, '{"issues": []}').otherwise(f'{{"issues": [{issue(0)}, 7]}}')
    replies = rel.table(spark, sf, "events").select("event_id", body.alias("content"))
    return contracts.check_spelling_replies(replies).select("event_id", "pos", "severity", "location")


def evaluation_text(m):
    fields = {
        "record_id": '"r"', "record_name": '"n"', "overall_status": '"warning"', "coverage_status": '"full"', "source_to_plan_mapping": "[]", "source_subparts": "[]",
        "covered_subparts": "[]", "missing_subparts": "[]", "selected_scope_summary": '""', "plan_quality_summary": '""', "issues": "[]", "recommended_actions": "[]", "confidence": '"high"',
    }
    text = lambda f: "{" + ", ".join(f'"{k}": {x}' for k, x in f.items()) + "}"
    lacking = {k: x for k, x in fields.items() if k not in ("confidence", "issues")}
    return (
        F.when(m == 0, text(fields))
        .when(m == 1, text(lacking))
        .when(m == 2, text({**fields, "overall_status": '"fine"', "issues": '[{"issue_id": "1"}, 4]'}))
        .when(m == 3, "```json\n" + text(fields) + "\n```")
        .otherwise("nothing")
    )


@query(
    "plan_reply_contract",
    "SELECT event_id, event_id % 5 = 0 AS valid, CASE WHEN event_id % 5 = 0 THEN 'warning' ELSE 'needs_review' END AS overall_status, "
    "CASE WHEN event_id % 5 = 0 THEN 'high' ELSE 'low' END AS confidence, ['', 'lacks confidence, issues; confidence is not valid: null; issues is not a list', "
    "'overall_status is not valid: fine; issues[1] lacks confidence, evidence, impact_on_generation, issue_level, issue_type, location, recommended_action, "
    "requires_human_review, severity, suggested_fix, summary; issues[2] is not an object', 'reply starts with a code fence', 'The reply holds no JSON object.'][CAST(event_id % 5 AS INT) + 1] AS error FROM events",
)
def plan_reply_contract(spark, sf):
    replies = rel.table(spark, sf, "events").select("event_id", evaluation_text(F.col("event_id") % 5).alias("content"))
    return contracts.check_plan_replies(replies).select("event_id", "valid", "overall_status", "confidence", "error")


def repair_text(m):
    suggestion = {
        "issue_id": '"1"', "action_code": '"split_item"', "location": "{}", "problem_summary": '"p"', "why_it_matters": '"w"', "specific_change": '"s"',
        "primary_decision": '"Split the item"', "reasoning": '"r"', "affects_generation": '"a"', "requires_human_review": "false",
    }
    text = lambda f: "{" + ", ".join(f'"{k}": {x}' for k, x in f.items()) + "}"
    plan = '{"type": "advanced_question_plan", "plan": []}'
    fields = {"repair_suggestions": f"[{text(suggestion)}]", "rewritten_question_plan_preview": plan, "preview_strategy": '"full_object"', "repair_confidence": '"high"', "manual_review_required": "false"}
    hedged = {**suggestion, "primary_decision": '"Có thể tách"'}
    return (
        F.when(m == 0, text(fields))
        .when(m == 1, text({**fields, "repair_suggestions": f"[{text(hedged)}]"}))
        .when(m == 2, text({**fields, "rewritten_question_plan_preview": '{"type": "x", "plan": []}'}))
        .when(m == 3, text({**fields, "rewritten_question_plan_preview": "null", "preview_strategy": '"not_safe"'}))
        .otherwise(text({**fields, "repair_suggestions": "[" + text({**suggestion, "before": "1"}) + "]"}))
    )


@query(
    "plan_repair_contract",
    "SELECT event_id AS record_id, event_id % 5 IN (0, 2, 3) AS valid, CASE WHEN event_id % 5 = 0 THEN 'full_object' ELSE 'not_safe' END AS preview_strategy, "
    "event_id % 5 NOT IN (0, 3) AS manual_review, CASE event_id % 5 WHEN 1 THEN 'suggestion 1 hedges: có thể' WHEN 4 THEN 'suggestion 1 has patch keys before' ELSE '' END AS error FROM events",
)
def plan_repair_contract(spark, sf):
    replies = rel.table(spark, sf, "events").select(F.col("event_id").alias("record_id"), repair_text(F.col("event_id") % 5).alias("content"))
    return contracts.check_plan_repair(replies).select("record_id", "valid", "preview_strategy", "manual_review", "error")


# --- requests ------------------------------------------------------------------------------------------------------


@query(
    "judge_request",
    rel.object_sql(
        "SELECT d.k AS doc_id, d.k % 4 AS n_items, coalesce((SELECT count(*) FROM ia WHERE ia.k = d.k), 0) AS n_types, CASE WHEN d.k % 5 = 0 THEN 0 ELSE 2 END AS n_blocks, "
        "d.k % 17 <> 0 AS has_instruction, false AS has_answers FROM d",
        upto="ia",
    ),
)
def judge_request(spark, sf):
    """What each request shows, and that it shows no answers, options or hints."""
    sent = requests.judge_request(rel.objects(spark, sf)).withColumn("r", F.try_parse_json("request"))
    items = v.elements(v.get(F.col("r"), "questionItems"))
    return sent.select(
        "doc_id",
        F.size(items).cast("bigint").alias("n_items"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda n, x: n + F.size(v.elements(v.get(x, "interactionTypes")))).alias("n_types"),
        F.size(v.elements(v.get(F.col("r"), "solutions"))).alias("n_blocks"),
        v.has_key(F.col("r"), "instruction").alias("has_instruction"),
        F.col("request").rlike("answerSpecs|options|hints|correct").alias("has_answers"),
    )


@query(
    "anchor_request",
    rel.object_sql(
        "SELECT ia.k AS doc_id, CAST(ia.i AS INT) AS item_pos, CAST(ia.j AS INT) AS inter_pos, ia.iid, ia.itype, "
        "'/questionItems/' || ia.i || '/answerSpecs/' || s.spec_pos AS spec_path, CASE WHEN ia.itype IN ('single_choice', 'multiple_choice') THEN ia.n_opt ELSE -1 END AS n_options "
        "FROM ia JOIN (SELECT k, i, ref, min(spec_pos) AS spec_pos FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY j) - 1 AS spec_pos FROM sp) x GROUP BY k, i, ref) s "
        "ON s.k = ia.k AND s.i = ia.i AND s.ref = ia.iid WHERE ia.itype <> 'essay'",
        upto="sp",
    ),
)
def anchor_request(spark, sf):
    found = requests.anchor_contexts(rel.objects(spark, sf))
    return found.select("doc_id", "item_pos", "inter_pos", "iid", "itype", "spec_path", F.coalesce(F.size("options"), F.lit(-1)).cast("bigint").alias("n_options"))


@query(
    "first_specs",
    rel.with_sql(
        "inter spec",
        "SELECT i.doc_id, i.item, i.iid, i.pk, i.sk, f.ep FROM inter i JOIN (SELECT doc_id, item, ref_iid, min(ep) AS ep FROM spec GROUP BY doc_id, item, ref_iid) f "
        "ON f.doc_id = i.doc_id AND f.item = i.item AND f.ref_iid = i.iid WHERE i.itype <> 'essay'",
    ),
)
def first_specs(spark, sf):
    """First-match lookup over stored relations, specs ordered by price."""
    specs = rel.spec(spark, sf).select("doc_id", "item", "ref_iid", F.col("ep").alias("spec_pos"), F.col("ep"))
    return requests.first_specs(rel.inter(spark, sf), specs).select("doc_id", "item", "iid", "pk", "sk", "spec.ep")


@query(
    "repair_context",
    rel.object_sql(
        "SELECT d.k AS doc_id, CASE WHEN d.k % 4 <= d.k % 3 THEN 'missing /questionItems/' || (d.k % 3) || '/stem' WHEN d.k % 17 = 0 THEN 'missing /instruction' "
        "WHEN d.k % 5 = 0 THEN 'missing /solutions' END AS context_error FROM d",
        upto="d",
    ).replace("'missing /questionItems/' || (d.k % 3) || '/stem' WHEN d.k % 17 = 0 THEN 'missing /instruction'",
              "CASE WHEN d.k % 17 = 0 THEN 'missing /instruction' ELSE 'missing /questionItems/' || (d.k % 3) || '/stem' END WHEN d.k % 17 = 0 THEN 'missing /instruction'"),
)
def repair_context(spark, sf):
    """Context of an answer problem in the first, second or third item, where the document has that much."""
    place = F.concat(F.lit("/questionItems/"), (F.col("doc_id") % 3).cast("string"))
    issues = rel.objects(spark, sf).select("doc_id", "doc", F.lit("answer_internal_consistency").alias("category"), place.alias("location"))
    return requests.repair_context(issues).select("doc_id", "context_error")


@query(
    "repair_request",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'fast' ELSE 'strong' END AS model_tier, CASE WHEN o_orderkey % 3 = 0 THEN 'fix_schema' ELSE 'clean_solution_reasoning' END AS repair_intent "
    "FROM orders WHERE o_orderkey % 3 <> 2",
)
def repair_request(spark, sf):
    category = F.when(F.col("doc_id") % 3 == 0, "render_schema").when(F.col("doc_id") % 3 == 1, "solution_quality").otherwise("runtime")
    issues = rel.objects(spark, sf).select("doc_id", "doc", category.alias("category"), F.lit("/solutions/0").alias("location"), F.lit(None).cast("string").alias("repair_intent"))
    return requests.repair_request(issues).select("doc_id", "model_tier", "repair_intent")
