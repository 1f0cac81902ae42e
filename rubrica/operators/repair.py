"""Patching documents and following repair rounds.

A patch list belongs to one reply and so to one document; it is folded over the document inside its row. The result
of every step is a table again, so rounds can be resumed from written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica import dims
from rubrica.functions import pointers, text as t, variants as v
from rubrica.functions.text import bind
from rubrica.operators import flatten, hygiene, issues as issue_ops, rules_object
from rubrica.session import cut_lineage

NULL = lambda: F.parse_json(F.lit("null"))


def _index(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))


def _opened(node: Column) -> Column:
    """The elements or else the members of a list or object, copied out once."""
    return bind(v.as_array(node), lambda found: F.struct(found.alias("listed"), F.when(found.isNull(), v.as_map(node)).alias("members")))


def _set(parent: Column, token: Column, child: Column) -> Column:
    """An opened list or object with the member at `token`, which exists, set to `child`."""
    listed = F.transform(parent["listed"], lambda x, i: F.when(i == _index(token), child).otherwise(x))
    return F.coalesce(F.to_variant_object(listed), F.to_variant_object(_with_key(parent["members"], token, child)))


def _with_key(members: Column, key: Column, child: Column) -> Column:
    return F.map_concat(F.map_filter(members, lambda k, _: k != key), F.create_map(key, child))


def _edit(parent: Column, op: Column, token: Column, value: Column) -> Column:
    """The opened parent after one operation on its member, NULL when the operation is not possible."""
    i = _index(token)

    def in_list(listed: Column) -> Column:
        size = F.size(listed)
        inside = (i >= 0) & (i < size)
        inserted = F.concat(F.slice(listed, F.lit(1), i), F.array(value), F.slice(listed, i + 1, size))
        edited = (
            F.when((op == "replace") & inside, F.transform(listed, lambda x, n: F.when(n == i, value).otherwise(x)))
            .when((op == "remove") & inside, F.filter(listed, lambda _, n: n != i))
            .when((op == "add") & (token == "-"), F.concat(listed, F.array(value)))
            .when((op == "add") & (i >= 0) & (i <= size), inserted)
        )
        return F.when(listed.isNotNull(), F.to_variant_object(edited)).otherwise(in_object(parent["members"]))

    def in_object(members: Column) -> Column:
        known = F.map_contains_key(members, token)
        others = F.map_filter(members, lambda k, _: k != token)
        edited = F.when((op == "add") | ((op == "replace") & known), F.map_concat(others, F.create_map(token, value))).when((op == "remove") & known, others)
        return F.to_variant_object(edited)

    return in_list(parent["listed"])


def apply_patch(doc: Column, patch: Column) -> Column:
    """struct<doc, error> after one patch struct<op, path, value>."""
    op, path = patch["op"], patch["path"]
    value = F.coalesce(patch["value"], NULL())

    def result(changed: Column) -> Column:
        return F.struct(
            F.coalesce(changed, doc).alias("doc"),
            F.when(changed.isNull(), F.concat_ws(" ", op, path)).alias("error"),
        )

    def walk(parts: Column) -> Column:
        above = F.slice(parts, F.lit(1), F.size(parts) - 1)
        last = F.get(parts, F.size(parts) - 1)

        def deeper(seen: Column, token: Column) -> Column:
            step = lambda e: F.coalesce(F.get(e["listed"], _index(token)), F.element_at(e["members"], token))
            return F.concat(seen, F.array(bind(step(F.get(seen, F.size(seen) - 1)), _opened)))

        chain = F.aggregate(above, F.array(_opened(doc)), deeper)

        def rebuild(seen: Column) -> Column:
            steps = F.reverse(F.transform(above, lambda token, i: F.struct(F.get(seen, i).alias("node"), token.alias("token"))))
            edited = bind(F.get(seen, F.size(seen) - 1), lambda parent: _edit(parent, op, last, value))
            return F.aggregate(
                steps,
                edited,
                lambda child, s: F.when(child.isNotNull(), bind(s["node"], lambda node: _set(node, s["token"], child))),
            )

        return bind(chain, rebuild)

    at_root = F.when(op.isin("replace", "add"), value)
    changed = F.when(path == "", at_root).when(path.startswith("/"), bind(pointers.tokens(path), walk))
    return bind(changed, result)


def apply_patches(doc: Column, patches: Column) -> Column:
    """struct<doc, error> after all patches in order; after a failure the rest is not tried."""
    start = F.struct(doc.alias("doc"), F.lit(None).cast("string").alias("error"))
    return F.aggregate(
        patches,
        start,
        lambda state, patch: F.when(state["error"].isNotNull(), state).otherwise(apply_patch(state["doc"], patch)),
    )


def patch_documents(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, doc, patches). All patches of a document take effect, or none."""
    step = docs.withColumn("state", apply_patches(F.col("doc"), F.col("patches")))
    failed = F.col("state.error").isNotNull()
    return step.select(
        *[c for c in docs.columns if c != "patches"],
        F.when(~failed, F.col("state.doc")).alias("new_doc"),
        F.col("state.error").alias("patch_error"),
    )


def patches_from_fixes(resolved: DataFrame, issues: DataFrame) -> DataFrame:
    """Replace patches for resolved documents with an alignment issue (doc_id, seq, op, path, value)."""
    wanted = issues.filter(F.col("repair_intent") == "align_fields_to_solution").select("doc_id").distinct()
    kept = resolved.filter(F.col("status") == "resolved").join(wanted, "doc_id", "left_semi")
    return kept.select("doc_id", F.posexplode("fixes").alias("seq", "fix")).select(
        "doc_id", "seq", F.lit("replace").alias("op"), "fix.path", "fix.value"
    )


def accept_candidates(patched: DataFrame) -> DataFrame:
    """Keep patched documents (doc_id, doc, new_doc, patch_error) that changed and have no bad issue."""
    # Every document is patched and checked once, in its row; of its findings only one flag goes on.
    same = v.canonical_equal(F.col("doc"), F.col("new_doc"))
    told = patched.select(*[c for c in patched.columns if c != "doc"], same.alias("same"))
    asked = told.select("*", F.when(F.col("new_doc").isNotNull() & ~F.col("same"), F.col("new_doc")).alias("doc"))
    bad = F.col("doc").isNotNull() & F.col("doc_id").isNotNull() & F.exists("found", rules_object.graded_bad)
    flagged = rules_object.object_findings(asked).select("doc_id", "new_doc", "patch_error", "same", bad.alias("bad"))
    any_bad = F.max("bad").over(Window.partitionBy("doc_id"))
    reason = (
        F.when(F.col("patch_error").isNotNull(), "patch_failed")
        .when(F.col("same"), "unchanged")
        .when(any_bad, "invalid_after_patch")
    )
    return flagged.withColumn("manual_reason", reason).select(
        "doc_id",
        F.when(F.col("manual_reason").isNull(), "repaired").otherwise(dims.MANUAL).alias("repair_status"),
        "manual_reason",
        F.when(F.col("manual_reason").isNull(), F.col("new_doc")).alias("new_doc"),
    )


def repair_decision(issues: DataFrame, resolver: DataFrame) -> DataFrame:
    """What to do with each document that has issues. resolver: (doc_id, status, n_fixes)."""
    category, intent = F.col("category"), F.col("repair_intent")
    gate = issue_ops.gate_priority(category, intent)
    flags = issues.groupBy("doc_id").agg(
        F.bool_or(category == "runtime").alias("has_runtime"),
        F.bool_or(F.coalesce(gate == 1, F.lit(False))).alias("has_manual"),
        F.bool_or(F.coalesce(gate == 2, F.lit(False))).alias("has_clean"),
        F.bool_or(intent == "align_fields_to_solution").alias("has_align"),
    )
    selected = issue_ops.select_repair_issue(issues).select("doc_id", F.col("repair_intent").alias("selected_intent"))
    answers = resolver.select("doc_id", F.col("status").alias("resolver_status"), "n_fixes")
    joined = flags.join(selected, "doc_id", "left").join(answers, "doc_id", "left")
    # A clean-up of the solution comes before any alignment with it.
    aligned = ~F.col("has_clean")
    decision = (
        F.when(F.col("has_runtime"), "manual_runtime")
        .when(F.col("has_manual"), "manual_solution")
        .when(aligned & (F.col("resolver_status") == dims.MANUAL), "manual_unresolved")
        .when(
            aligned & (F.col("resolver_status") == "resolved") & (F.col("n_fixes") > 0) & F.col("has_align"),
            "align",
        )
        .when(F.col("selected_intent").isin(dims.SCOPED_INTENTS), "request")
        .otherwise("manual_not_scoped")
    )
    return joined.select("doc_id", decision.alias("decision"), "selected_intent")


def changed_text_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Text nodes that are new or differ from the original (doc_id, pointer)."""
    old = before.select("doc_id", "pointer", F.col("text").alias("old_text"))
    return (
        after.join(old, ["doc_id", "pointer"], "left")
        .filter(~F.col("text").eqNullSafe(F.col("old_text")))
        .drop("old_text")
    )


def issues_on_changed(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues that point to a changed text."""
    places = changed.select("doc_id", F.col("pointer").alias("location")).distinct()
    return issues.join(places, ["doc_id", "location"], "left_semi")


def guard_repaired_text(repaired: DataFrame) -> DataFrame:
    """Reject repairs (doc_id, doc, new_doc) whose changed texts break a hygiene rule.

    Old and new text nodes are compared as sets inside the row; only changed nodes are tested.
    """
    # Texts are taken out of a document once, in its row; of its hits only their number goes on.
    texts = {"__new": flatten.text_nodes_of("new_doc"), "__old": flatten.text_nodes_of("doc")}
    changed = F.when(F.col("new_doc").isNotNull() & F.col("doc_id").isNotNull(), F.array_except("__new", "__old"))
    counted = repaired.withColumns(texts).withColumn("__hits", F.transform(changed, hygiene.hits_of)).drop("__new", "__old")
    hits = F.aggregate(F.transform("__hits", F.size), F.lit(0).cast("bigint"), lambda n, x: n + x)
    total = F.coalesce(F.sum(hits).over(Window.partitionBy("doc_id")), F.lit(0).cast("bigint"))
    bad = F.col("n_text_issues") > 0
    return counted.withColumn("n_text_issues", total).select(
        "doc_id",
        "doc",
        F.when(bad, "failed").otherwise(F.col("repair_status")).alias("repair_status"),
        F.when(~bad, F.col("new_doc")).alias("new_doc"),
        "n_text_issues",
    )


def stop_reasons(rounds: DataFrame, max_loop: int) -> DataFrame:
    """Where each document's repair rounds end (doc_id, round, repair_status, recheck_good)."""
    status = F.col("repair_status")
    event = (
        F.when(status != "repaired", status)
        .when(F.col("recheck_good"), "recheck_good")
        .when(F.col("round") >= max_loop, "max_loop_reached")
    )
    used = rounds.filter(F.col("round") <= max_loop).withColumn("event", event)
    stop = used.groupBy("doc_id").agg(
        F.min_by("event", F.when(F.col("event").isNotNull(), F.col("round"))).alias("stop_reason"),
        F.min(F.when(F.col("event").isNotNull(), F.col("round"))).alias("stop_round"),
        F.max("round").alias("last_round"),
        F.min(F.when(status != "repaired", F.col("round"))).alias("failed_round"),
    )
    loops = F.coalesce("stop_round", "last_round")
    return stop.select(
        "doc_id",
        F.coalesce("stop_reason", F.lit("max_loop_reached")).alias("stop_reason"),
        loops.alias("loop_count"),
        # The last successful round counts even if a later one failed.
        F.when(F.col("failed_round") == loops, loops - 1).otherwise(loops).alias("success_round"),
    )


def plan_rounds(rounds: DataFrame, max_loop: int) -> DataFrame:
    """Outcome of repeated plan repair, one row per record.

    rounds: (record_id, round 0..n, is_good, candidate, unchanged); `candidate` is the plan proposed after the
    evaluation of that round, NULL when it is not valid. At most max_loop + 1 rows per record are used.
    """
    good, last = F.col("is_good"), F.col("round") >= max_loop
    event = (
        F.when(good & (F.col("round") == 0), "initial_plan_good")
        .when(good, "candidate_verified_good")
        .when(last, "max_loop_reached")
        .when(F.col("candidate").isNull(), "candidate_invalid_or_null")
        .when(F.col("unchanged"), "candidate_unchanged")
    )
    used = rounds.filter(F.col("round") <= max_loop).withColumn("event", event)
    proposals = [
        F.max(F.when(F.col("round") == r, F.col("candidate"))).alias(f"c{r}") for r in range(max_loop + 1)
    ]
    at_stop = used.groupBy("record_id").agg(
        F.min_by("event", F.when(F.col("event").isNotNull(), F.col("round"))).alias("stop_reason"),
        F.min(F.when(F.col("event").isNotNull(), F.col("round"))).alias("stop_round"),
        F.max("round").alias("last_round"),
        *proposals,
    )
    stop = F.coalesce("stop_round", "last_round")
    made = F.array(*[F.col(f"c{r}") for r in range(max_loop + 1)])
    before = F.get(made, stop - 1)
    latest = (
        F.when(F.col("stop_reason") == "initial_plan_good", F.lit(None))
        .when(F.col("stop_reason").isin("candidate_verified_good", "candidate_invalid_or_null"), before)
        .when(F.col("stop_reason") == "candidate_unchanged", F.when(stop > 0, F.get(made, stop)))
        .otherwise(F.coalesce(F.get(made, stop), before))
    )
    return at_stop.select(
        "record_id",
        F.coalesce("stop_reason", F.lit("max_loop_reached")).alias("stop_reason"),
        stop.alias("loop_count"),
        latest.alias("candidate"),
        F.coalesce(F.col("stop_reason") == "initial_plan_good", F.lit(False)).alias("is_good"),
    )


def merge_repair(results: DataFrame, repairs: DataFrame) -> DataFrame:
    """First check of each document with the outcome of its repair, skipped where there was none."""
    return results.join(repairs, "doc_id", "left").withColumns(
        {
            "repair_status": F.coalesce("repair_status", F.lit("skipped")),
            "new_doc": F.when(F.col("repair_status") == "repaired", F.col("new_doc")),
        }
    )


def repair_round(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """One round: apply each document's patches, keep what is valid, check it again.

    docs: (doc_id, doc); patches: (doc_id, patches). Returns (doc_id, doc, repair_status, recheck_good) where `doc`
    is the document to go on with. Patched and guarded documents are read several times, so both are checkpointed.
    """
    patched = cut_lineage(patch_documents(docs.join(patches, "doc_id")))
    accepted = accept_candidates(patched).join(patched.select("doc_id", "doc"), "doc_id")
    guarded = guard_repaired_text(accepted)
    current = cut_lineage(
        guarded.select("doc_id", F.coalesce("new_doc", "doc").alias("doc"), "repair_status")
    )
    left = (
        rules_object.check_object(current.select("doc_id", "doc"))
        .select("doc_id")
        .distinct()
        .withColumn("has_issue", F.lit(True))
    )
    return current.join(left, "doc_id", "left").select(
        "doc_id",
        "doc",
        "repair_status",
        ((F.col("repair_status") == "repaired") & F.col("has_issue").isNull()).alias("recheck_good"),
    )
