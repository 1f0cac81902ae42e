"""Checking whole batches of question objects, from payloads to published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.operators import consensus, contracts, flatten, repair, requests, rules_object, sequence
from rubrica.session import cut_lineage


def structural_stage(docs: DataFrame) -> dict[str, DataFrame]:
    """Rule issues, and the judge requests of the documents without a bad one (doc_id, doc)."""
    clear = rules_object.clear_documents(docs)
    return {"issues": rules_object.check_object(docs), "requests": requests.judge_request(clear), "clear": clear}


def judge_stage(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Decisions over two judge replies per document.

    docs: (doc_id, doc); replies: (doc_id, stage, run_no, model_tier, content) with the stages `split` and `judge`.
    """
    blocks = docs.select("doc_id", requests.solution_blocks(F.col("doc")).alias("blocks"))
    fast = (F.col("stage") == "split") & (F.col("model_tier") == "fast")
    split = contracts.check_split_replies(
        replies.filter(fast).select("doc_id", "content").join(blocks, "doc_id")
    )
    states = split.filter("valid").select("doc_id", F.explode("states").alias("s")).select(
        "doc_id",
        F.col("s.solution_index").alias("sol"),
        F.col("s.order").alias("ord"),
        F.col("s.source_path").alias("path"),
        F.col("s.source_text").alias("text"),
    )
    anchored = sequence.prepend_anchor(states, sequence.problem_anchor(flatten.text_nodes(docs)))
    expected = sequence.expected_transitions(anchored)
    judged = contracts.parse_transition_replies(
        replies.filter((F.col("stage") == "judge") & (F.col("model_tier") == "fast")).select("doc_id", "run_no", "content")
    )
    runs = []
    for run_no in (1, 2):
        one = judged.filter((F.col("run_no") == run_no) & F.col("valid"))
        heads = one.select("doc_id", "judgement.verdict", "judgement.reason", "judgement.suggestion")
        stages = one.select("doc_id", F.posexplode("judgement.stages").alias("k", "s")).select(
            "doc_id", F.col("k").cast("bigint").alias("k"), "s.*"
        )
        checked = sequence.check_transitions(heads, stages, expected)
        runs.append(
            checked.select(
                "doc_id",
                F.lit(run_no).alias("run_no"),
                F.when(F.col("valid"), F.col("verdict")).alias("verdict"),
                F.col("bad_sol").alias("sol"),
                F.col("bad_from").alias("from_order"),
                F.col("bad_to").alias("to_order"),
            )
        )
    decided = consensus.reconcile_judges(runs[0].unionByName(runs[1]), ["doc_id"])
    return docs.select("doc_id").join(decided, "doc_id", "left")


def repair_rounds(docs: DataFrame, patches: DataFrame, max_loop: int = 1) -> DataFrame:
    """At most `max_loop` rounds of patches (doc_id, round, patches) on documents (doc_id, doc).

    Each round applies, validates and checks again; documents that fail or become good leave, and so do those for which
    a later round has no patch: they end as repaired by the round before. Documents without a patch in the first round
    are no part of it. Lineage is cut between rounds, so a lost executor repeats one round at most.
    """
    if max_loop < 1:
        raise ValueError("max_loop must be 1 or more")
    limit = max_loop
    current = docs.select("doc_id", "doc")
    ended, last_good = [], None
    for number in range(1, limit + 1):
        given = patches.filter(F.col("round") == number).select("doc_id", "patches")
        if last_good is not None:
            ended.append(
                current.join(given.select("doc_id"), "doc_id", "left_anti").select(
                    "doc_id",
                    F.lit("no_patch").alias("stop_reason"),
                    F.lit(number - 1).alias("loop_count"),
                    F.lit("repaired").alias("repair_status"),
                    F.col("doc").alias("new_doc"),
                )
            )
        outcome = cut_lineage(repair.repair_round(current, given))  # also what the next round starts from
        failed = outcome.filter(F.col("repair_status") != "repaired")
        good = outcome.filter((F.col("repair_status") == "repaired") & F.col("recheck_good"))
        open_ = outcome.filter((F.col("repair_status") == "repaired") & ~F.col("recheck_good"))
        done = failed.withColumn("stop_reason", F.col("repair_status")).unionByName(
            good.withColumn("stop_reason", F.lit("recheck_good"))
        )
        if number == limit:
            done = done.unionByName(open_.withColumn("stop_reason", F.lit("max_loop_reached")))
        # An earlier success counts even if a later round fails.
        repaired = (F.col("repair_status") == "repaired") | F.lit(last_good is not None)
        ended.append(
            done.select(
                "doc_id",
                "stop_reason",
                F.lit(number).alias("loop_count"),
                F.when(repaired, "repaired").otherwise(F.col("repair_status")).alias("repair_status"),
                F.when(repaired, F.col("doc")).alias("new_doc"),
            )
        )
        current, last_good = open_.select("doc_id", "doc"), number
    result = ended[0]
    for more in ended[1:]:
        result = result.unionByName(more)
    return result
