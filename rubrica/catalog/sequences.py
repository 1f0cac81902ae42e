"""Solution states: conversations are solutions, turns their states."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.operators import sequence

TRIM = "trim(text, chr(9) || chr(13) || chr(10) || ' ')"


@query(
    "transition_stages",
    rel.with_sql(
        "states",
        "SELECT sol, CASE WHEN f IS NULL THEN 0 ELSE ord END AS stage, f AS from_order, CASE WHEN f IS NOT NULL THEN ord END AS to_order, path, before, text AS after "
        "FROM (SELECT *, lag(ord) OVER w AS f, lag(text) OVER w AS before FROM states WINDOW w AS (PARTITION BY sol ORDER BY ord)) t",
    ),
)
def transition_stages(spark, sf):
    return sequence.transition_stages(rel.states(spark, sf), ["sol"])


def anchor_nodes(spark, sf):
    return rel.nodes(spark, sf).withColumn("role", F.when(F.col("pos") == 0, "instruction").otherwise("stem"))


ANCHOR = (
    "SELECT doc_id, path, text FROM (SELECT doc_id, pointer AS path, t AS text, row_number() OVER (PARTITION BY doc_id ORDER BY "
    "length(t) - length(replace(t, '=', '')) DESC, length(t) DESC, pos) AS n FROM (SELECT *, " + TRIM + " AS t FROM nodes) a WHERE t <> '') b WHERE n = 1"
)


@query("problem_anchor", rel.with_sql("nodes", ANCHOR))
def problem_anchor(spark, sf):
    return sequence.problem_anchor(anchor_nodes(spark, sf))


def numbered_states(spark, sf):
    """States of a document; several solutions belong to one document."""
    return rel.states(spark, sf).withColumn("doc_id", F.floor(F.col("sol") / 4))


@query(
    "prepend_anchor",
    rel.with_sql(
        "nodes states",
        "SELECT s.doc_id, sol, CAST(ord + CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END AS INT) AS ord, s.path FROM s LEFT JOIN a ON a.doc_id = s.doc_id "
        "UNION ALL SELECT s.doc_id, sol, 0, a.path FROM (SELECT DISTINCT doc_id, sol FROM s) s JOIN a ON a.doc_id = s.doc_id",
        a=ANCHOR,
        s="SELECT CAST(floor(sol / 4) AS BIGINT) AS doc_id, * FROM states",
    ),
)
def prepend_anchor(spark, sf):
    anchors = sequence.problem_anchor(anchor_nodes(spark, sf))
    return sequence.prepend_anchor(numbered_states(spark, sf), anchors).select("doc_id", "sol", "ord", "path")


def pieces(spark, sf):
    """Split replies: every turn cut into lines, some with a letter changed, some with a line lost."""
    turns = rel.table(spark, sf, "conversations").select(
        F.lit(0).cast("bigint").alias("doc_id"), F.col("conv_id").alias("sol"), F.concat(F.lit("/"), F.col("turn").cast("string")).alias("path"), "turn", "text"
    )
    cut = turns.select(
        "doc_id", "sol", "path", "turn", F.posexplode(F.filter(F.split("text", "(?<=\n)", -1), lambda s: s != "")).alias("piece", "text")
    ).withColumn("pos", F.col("turn") * 1000 + F.col("piece"))
    kept = cut.filter(~((F.col("sol") % 11 == 2) & (F.col("piece") == 1)) & ~((F.col("sol") % 13 == 5) & (F.col("turn") == 1)))
    changed = kept.withColumn("text", F.when((F.col("sol") % 7 == 3) & (F.col("turn") == 0), F.upper("text")).otherwise(F.col("text")))
    return turns.select("doc_id", "sol", "path", "text"), changed


@query(
    "split_lossless",
    "SELECT sol, path, error FROM (SELECT conv_id AS sol, '/' || turn AS path, CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN 'missing_block' "
    "WHEN conv_id % 11 = 2 AND len(lines) > 1 THEN 'changed_text' WHEN conv_id % 7 = 3 AND turn = 0 AND upper(text) <> text THEN 'changed_text' END AS error "
    "FROM (SELECT *, string_split(rtrim(text, chr(10)), chr(10)) AS lines FROM conversations) c) t WHERE error IS NOT NULL",
)
def split_lossless(spark, sf):
    blocks, states = pieces(spark, sf)
    return sequence.split_lossless(states, blocks).select("sol", "path", "error")


@query(
    "split_order",
    rel.with_sql(
        "states",
        "SELECT sol, count(*) FILTER (WHERE ord <> coalesce(p + 1, 0)) AS n_order, count(*) FILTER (WHERE r < pr) AS n_moved FROM (SELECT *, lag(ord) OVER w AS p, "
        "lag(r) OVER w AS pr FROM (SELECT *, CASE WHEN path = 'user' THEN 0 ELSE 1 END AS r FROM states) s WINDOW w AS (PARTITION BY sol ORDER BY ord)) t "
        "GROUP BY sol HAVING n_order > 0 OR n_moved > 0",
    ),
)
def split_order(spark, sf):
    states = rel.states(spark, sf).withColumns({"pos": F.col("ord"), "block_rank": F.when(F.col("path") == "user", 0).otherwise(1)})
    return sequence.split_order(states, ["sol"])


def judged(spark, sf):
    """Stage results: one per adjacent pair of turns, with surplus, wrong, failed and unexplained ones."""
    turns = rel.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("turn"))
    states = turns.select("doc_id", F.lit(0).alias("sol"), F.col("turn").alias("ord"), F.concat(F.lit("/solutions/"), F.col("turn").cast("string")).alias("path"))
    d, k = F.col("doc_id"), F.col("turn")
    results = turns.filter((d % 6 == 4) | (k > 0)).filter(~((d % 6 == 5) & (k == 1))).select(
        "doc_id",
        (F.when(d % 6 == 4, k).otherwise(k - 1)).cast("bigint").alias("k"),
        F.lit(0).alias("sol"),
        k.alias("stage"),
        F.when((d % 6 == 1) & (k == 1), k).otherwise(k - 1).alias("from_order"),
        k.alias("to_order"),
        F.when((d % 6 == 2) & (k == 1), " ").otherwise("ok").alias("reasoning"),
        (~((d % 6 == 3) & (k == 1))).alias("ok"),
        F.lit("why").alias("reason"),
    )
    replies = turns.groupBy("doc_id").agg(F.max("turn").alias("last")).select(
        "doc_id",
        F.when(d % 6 == 3, "bad").otherwise("good").alias("verdict"),
        F.lit("r").alias("reason"),
        F.when(d % 12 == 3, "").otherwise("s").alias("suggestion"),
        "last",
    )
    return replies, results, sequence.expected_transitions(states), states


_R = (
    "SELECT conv_id AS d, turn AS k, max(turn) OVER (PARTITION BY conv_id) AS last, conv_id % 6 AS m FROM conversations"
)


@query(
    "transition_contract",
    "SELECT d AS doc_id, CAST(place AS BIGINT) AS k, CASE WHEN m = 5 AND k = 1 THEN 'unanswered' WHEN m = 4 AND k = last THEN 'surplus' "
    "WHEN m = 4 THEN 'mismatch' WHEN m = 1 AND k = 1 THEN 'mismatch' ELSE 'match' END AS state FROM "
    f"(SELECT *, CASE WHEN m = 4 THEN k ELSE k - 1 END AS place FROM ({_R}) r) t WHERE m = 4 OR k > 0",
)
def transition_contract(spark, sf):
    _, results, expected, _ = judged(spark, sf)
    return sequence.transition_contract(results, expected).select("doc_id", "k", "state")


CHECKED = (
    "SELECT d AS doc_id, CASE WHEN m = 3 THEN 'bad' ELSE 'good' END AS verdict, CASE WHEN m = 4 THEN 'too_many_stages' "
    "WHEN last = 0 AND m = 3 AND d % 12 = 3 THEN 'no_reason' WHEN last = 0 THEN NULL "
    "WHEN m = 1 THEN 'wrong_transition' WHEN m = 2 THEN 'no_reasoning' WHEN m = 5 THEN 'incomplete' WHEN m = 3 AND last > 1 THEN 'went_on_after_failure' "
    f"WHEN m = 3 AND d % 12 = 3 THEN 'no_reason' END AS error, last, m FROM (SELECT DISTINCT d, last, m FROM ({_R}) r) t"
)


@query(
    "check_transitions",
    f"SELECT doc_id, verdict, error IS NULL AS valid, error, CASE WHEN error IS NULL AND m = 3 AND last > 0 THEN 1 END AS bad_to FROM ({CHECKED}) c",
)
def check_transitions(spark, sf):
    replies, results, expected, _ = judged(spark, sf)
    return sequence.check_transitions(replies, results, expected).select("doc_id", "verdict", "valid", "error", "bad_to")


@query(
    "first_problem",
    f"SELECT doc_id, verdict, CASE WHEN last > 0 THEN '/solutions/1' ELSE '/solutions' END AS location FROM ({CHECKED}) c WHERE error IS NULL AND verdict = 'bad'",
)
def first_problem(spark, sf):
    replies, results, expected, states = judged(spark, sf)
    checked = sequence.check_transitions(replies, results, expected)
    return sequence.first_problem(checked, states).select("doc_id", "verdict", "location")
