"""The whole check of question objects as a replay of a ledger of replies.

Models are outside, so a check stops wherever a reply is wanted and goes on once it is there. What happened is kept in one
append-only ledger (doc_id, round, stage, model_tier, run_no, content [, at]); nothing else is state. `advance` replays it: it
derives the stage each document stands at, asks for the replies that are missing, and publishes the documents that are
through. Running it again with more replies goes on from there, and running it again with the same gives the same.

Stages of a round: split (fast, then strong), judge (two fast runs, then strong), resolve (one or two fast runs, then
strong), repair. Round 0 checks the document as it came; round n checks it after its n-th repair, with replies of its own, so
a repair counts as good only when rules, judge and resolver find nothing any more.

Only the documents that a round changed enter the next one. What a reply says is checked inside the row of its document,
where all replies of a round are joined once; issues of all sources are one relation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import text, variants as v
from rubrica.functions.expressions import built_once
from rubrica.functions.text import bind
from rubrica.functions.text import strip
from rubrica.operators import consensus, contracts, flatten, issues as issue_ops, repair, requests, rules_object, sequence
from rubrica.session import cut_lineage

REQUEST = ["doc_id", "round", "stage", "model_tier", "run_no"]
SLOTS = {
    "split_fast": ("split", "fast", 1),
    "split_strong": ("split", "strong", 1),
    "judge_fast_1": ("judge", "fast", 1),
    "judge_fast_2": ("judge", "fast", 2),
    "judge_strong": ("judge", "strong", 1),
    "resolve_fast_1": ("resolve", "fast", 1),
    "resolve_fast_2": ("resolve", "fast", 2),
    "resolve_strong": ("resolve", "strong", 1),
    "repair_fast": ("repair", "fast", 1),
    "repair_strong": ("repair", "strong", 1),
}
SLOT = "struct<stage:string,model_tier:string,run_no:int>"
ISSUE = "struct<severity:string,category:string,location:string,reason:string,suggestion:string,repair_intent:string>"
ROUTING = ("attempts", "fallback", "runs", "agreement", "decision")


@dataclass(frozen=True)
class Options:
    """strict: warnings block too; fallback: the strong model may be asked; rounds: repairs at most, 0 for none."""

    strict: bool = True
    fallback: bool = True
    resolver_runs: int = 2
    rounds: int = 1


@dataclass(frozen=True)
class Flow:
    """requests: open requests with their text; results: one row a document; issues: those of the first check."""

    requests: DataFrame
    results: DataFrame
    issues: DataFrame


def answers(ledger: DataFrame) -> DataFrame:
    """One row a document and round with a column for each slot. Of replies to the same request, the first one counts."""
    at = F.col("at") if "at" in ledger.columns else F.lit(0)
    stage, tier = F.col("stage"), F.coalesce("model_tier", F.lit("fast"))
    run = F.coalesce("run_no", F.lit(1))
    first = [
        F.min_by(F.when((stage == s) & (tier == m) & (run == n), F.col("content")), F.when((stage == s) & (tier == m) & (run == n), F.struct(at, F.col("content")))).alias(name)
        for name, (s, m, n) in SLOTS.items()
    ]
    known = ledger.where(F.col("content").isNotNull())
    return known.groupBy("doc_id", F.coalesce("round", F.lit(0)).alias("round")).agg(*first)


def _slot(name: str) -> Column:
    stage, tier, run = SLOTS[name]
    return F.struct(F.lit(stage).alias("stage"), F.lit(tier).alias("model_tier"), F.lit(run).alias("run_no"))


def _missing(**wanted: Column) -> Column:
    """Slots that are wanted and have no reply yet."""
    return F.array_compact(F.array(*[F.when(c & F.col(name).isNull(), _slot(name)) for name, c in wanted.items()])).cast(f"array<{SLOT}>")


def _issue(severity: str, category: str, location: Column, reason, suggestion, intent: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        location.alias("location"),
        lit(reason).alias("reason"),
        lit(suggestion).alias("suggestion"),
        F.lit(intent).alias("repair_intent"),
    )


# --- split and judge ------------------------------------------------------------------------------------------------
# Replies of one kind are checked by one expression over the array of their slots, built once per application.


@built_once
def _split_replies() -> Column:
    return F.transform(F.array("split_fast", "split_strong"), lambda c: contracts.split_reply(c, F.col("source")))


@built_once
def _states() -> Column:
    """Anchored states of the split that counts."""
    first, second = (F.get("splits", F.lit(n)) for n in (0, 1))
    split = F.when(first["error"].isNull(), first["states"]).when(second["error"].isNull(), second["states"])
    return bind(sequence.anchor_of(flatten.text_nodes_of("doc")), lambda anchor: sequence.anchored_states(split, anchor))


@built_once
def _judge_replies() -> Column:
    """Per judge slot struct<verdict, reason, suggestion, sol, from_order, to_order, location>, NULL where it is not valid."""

    def told(content: Column) -> Column:
        def of(reply: Column) -> Column:
            def located(at: Column) -> Column:
                hit = F.filter("states", lambda s: (s["sol"] == at["sol"]) & (s["ord"] == at["to_order"]))
                return F.when(
                    reply["error"].isNull() & at["error"].isNull(),
                    F.struct(
                        *[reply["judgement"][c].alias(c) for c in ("verdict", "reason", "suggestion")],
                        *[at[c].alias(c) for c in ("sol", "from_order", "to_order")],
                        F.coalesce(F.get(hit, F.lit(0))["path"], F.lit("/solutions")).alias("location"),
                    ),
                )

            return bind(sequence.judged_transitions(reply["judgement"], F.col("expected")), located)

        return bind(contracts.transition_reply(content), of)

    return F.transform(F.array("judge_fast_1", "judge_fast_2", "judge_strong"), told)


def judge_rows(rows: DataFrame, options: Options) -> DataFrame:
    """Rows (doc_id, doc, clear, slots) with the outcome of splitter and judge.

    Adds states, judge_open (slots to ask), judge_done, judge_issue and judge_* routing. Rows that are not clear ask for nothing.
    """
    given = rows.withColumn("source", requests.solution_blocks(F.col("doc"))).withColumn("splits", _split_replies())
    anchored = given.withColumn("states", _states()).withColumn("expected", sequence.expected_of(F.col("states")))
    one, two, strong = (F.get("told", F.lit(n)) for n in range(3))
    paired = anchored.withColumn("told", _judge_replies()).withColumns(
        {f"{c}_{n}": told[c] for n, told in ((1, one), (2, two)) for c in ("verdict", "sol", "from_order", "to_order")}
        | {"strong_verdict": strong["verdict"], "strong_to": strong["to_order"]}
        | {f"{tier}_ok": F.get("splits", F.lit(n))["error"].isNull() for n, tier in enumerate(("fast", "strong"))}
    )
    decided = paired.withColumns(consensus.judge_decision())
    final = consensus.fallback_decision(options.fallback)

    can, clear = F.lit(options.fallback), F.col("clear")
    fast_split, strong_split = F.col("split_fast").isNotNull(), F.col("split_strong").isNotNull()
    retry_split = fast_split & ~F.col("fast_ok") & can
    no_split = fast_split & ~F.col("fast_ok") & (~can | (strong_split & ~F.col("strong_ok")))
    split_ok = fast_split & (F.col("fast_ok") | (can & strong_split & F.col("strong_ok")))
    both = F.col("judge_fast_1").isNotNull() & F.col("judge_fast_2").isNotNull()
    retry_judge = split_ok & both & (F.col("n_valid") < 2) & can
    done = clear & (no_split | (split_ok & both & (~retry_judge | F.col("judge_strong").isNotNull())))
    open_ = _missing(
        split_fast=clear,
        split_strong=clear & retry_split,
        judge_fast_1=clear & split_ok,
        judge_fast_2=clear & split_ok,
        judge_strong=clear & retry_judge,
    )
    by_strong = retry_judge & strong.isNotNull()
    used = F.when(by_strong, strong).when(F.col("chosen_run") == 1, one).when(F.col("chosen_run") == 2, two)
    runtime = no_split | (F.col("is_runtime") & ~by_strong)
    issue = F.when(
        done,
        F.when(
            runtime,
            _issue("needs_review", "runtime", F.lit("/solutions"), "The solution could not be judged.", "Run the judge again or check by hand.", dims.MANUAL),
        ).when(
            used.isNotNull() & (used["verdict"] != "good"),
            _issue("needs_review", "solution_quality", used["location"], used["reason"], used["suggestion"], dims.MANUAL),
        ),
    )
    invalid = F.when(F.col("verdict_1").isNull(), "run_1_invalid").otherwise("run_2_invalid")
    routing = {
        "judge_attempts": final["attempts"],
        "judge_fallback": final["fallback_called"],
        "judge_runs": final["run_count"],
        "judge_agreement": final["agreement"],
        "judge_decision": F.when(F.col("n_valid") == 2, F.col("decision")).otherwise(invalid),
    }
    return decided.select(
        *rows.columns, "states", open_.alias("judge_open"), done.alias("judge_done"), issue.alias("judge_issue"), *[F.when(done, c).alias(n) for n, c in routing.items()]
    )


# --- resolver ---------------------------------------------------------------------------------------------------------

FIXES = "array<struct<path:string,value:string>>"
OPTIONS = "array<struct<id:string,text:string>>"


def _manual_issue(reason: str) -> Column:
    return F.array(_issue("needs_review", "solution_quality", F.lit("/solutions"), reason, "Review the solution before anything else is changed.", dims.MANUAL))


@built_once
def _contexts() -> Column:
    return requests.context_list(F.col("doc"))


@built_once
def _solution() -> Column:
    return F.array_join(F.array_distinct(v.deep_texts(v.get(F.col("doc"), "solutions"))), "\n")


@built_once
def _resolver_replies() -> Column:
    known = F.flatten(F.transform("contexts", lambda c: F.transform(F.coalesce(c["options"], F.array().cast(OPTIONS)), lambda o: o["id"])))
    slots = F.array("resolve_fast_1", "resolve_fast_2", "resolve_strong")
    return bind(known, lambda ids: F.transform(slots, lambda c: contracts.resolver_reply(c, F.col("solution"), ids, F.col("doc"))["fields"]))


@built_once
def _signatures() -> Column:
    def side(told: Column) -> Column:
        reasons = F.array_join(F.transform(told["issues"], lambda i: i["reason"]), " ")
        return F.struct(
            told.isNotNull().alias("valid"),
            F.when(told.isNotNull(), consensus.resolver_signature(told)).alias("signature"),
            F.coalesce(consensus.uncertain_review(told["status"], reasons), F.lit(False)).alias("unsure"),
        )

    return F.transform(F.slice("told", 1, 2), side)


def resolve_rows(rows: DataFrame, options: Options) -> DataFrame:
    """Rows (doc_id, doc, contexts, slots) of documents that may be resolved, with the outcome of the resolver.

    Returns (doc_id, resolve_open, resolve_done, resolver struct<status, fixes, issues>, resolver_* routing).
    """
    step = rows.select("doc_id", "doc", "contexts", *[c for c in SLOTS if c.startswith("resolve")], _solution().alias("solution"))
    step = step.withColumn("told", _resolver_replies()).withColumn("sides", _signatures()).drop("doc", "contexts")
    one, strong = F.get("told", F.lit(0)), F.get("told", F.lit(2))
    paired = step.withColumns({f"{c}_{n}": F.get("sides", F.lit(n - 1))[c] for n in (1, 2) for c in ("valid", "signature", "unsure")})
    decided = paired.withColumns(consensus.resolver_decision(options.resolver_runs, options.fallback))
    silent = F.col("solution") == ""  # nothing to resolve from, so nothing is asked
    asked = F.col("resolve_fast_1").isNotNull()
    if options.resolver_runs == 2:
        asked &= F.col("resolve_fast_2").isNotNull()
    done = silent | (asked & (~F.col("fallback_called") | F.col("resolve_strong").isNotNull()))
    open_ = _missing(
        resolve_fast_1=~silent,
        resolve_fast_2=~silent & F.lit(options.resolver_runs == 2),
        resolve_strong=~silent & asked & F.col("fallback_called"),
    )
    chosen = F.when(F.col("used") == "fallback", strong).when(F.col("used") == "run_1", one)
    usable = ~silent & chosen.isNotNull()
    no_fixes = F.array().cast(FIXES)
    listed = F.transform(
        chosen["issues"],
        lambda i: F.struct(*[i[c].alias(c) for c in ("severity", "category", "location", "reason", "suggestion", "repair_intent")]),
    )
    # A manual review that names no reason of its own gets one.
    manual = F.when((chosen["status"] == dims.MANUAL) & (F.size(listed) == 0), _manual_issue("The solution gives no final answer that fits."))
    issues = (
        F.when(silent, _manual_issue("There is no solution to compare with."))
        .when(usable, F.coalesce(manual, listed))
        .otherwise(_manual_issue("The replies of the resolver could not be used."))
    )
    resolver = F.struct(
        F.when(usable, chosen["status"]).otherwise(dims.MANUAL).alias("status"),
        F.when(usable & (chosen["status"] == "resolved"), F.coalesce(chosen["fixes"], no_fixes)).otherwise(no_fixes).alias("fixes"),
        issues.cast(f"array<{ISSUE}>").alias("issues"),
    )
    called = done & ~silent
    routing = {
        "resolver_attempts": F.col("attempts"),
        "resolver_fallback": F.col("fallback_called"),
        "resolver_runs": F.lit(options.resolver_runs),
        "resolver_agreement": F.col("agreement"),
        "resolver_decision": F.when(F.col("agreement"), "agreement").otherwise(F.col("fallback_reason")),
    }
    return decided.select(
        "doc_id", open_.alias("resolve_open"), done.alias("resolve_done"), F.when(done, resolver).alias("resolver"), *[F.when(called, c).alias(n) for n, c in routing.items()]
    )


# --- one check ----------------------------------------------------------------------------------------------------------

GRADE = {code: rule[0] for code, rule in rules_object.RULES.items()}
FIELDS = ["doc_id", "pos", "severity", "category", "location", "reason", "suggestion", "repair_intent"]


def _rule_issues(rows: DataFrame) -> DataFrame:
    placed = rows.select("doc_id", F.posexplode("found").alias("pos", "f")).select("doc_id", "pos", "f.*")
    graded = rules_object.as_issues(placed)
    return graded.withColumn("repair_intent", issue_ops.default_intent(F.col("category"))).select(*FIELDS)


def check(docs: DataFrame, replies: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """One round over documents (doc_id, doc) with their replies (see `answers`): checked rows, and canonical issues.

    Rows: (doc_id, doc, replies to repairs, states, open, complete, is_good, resolver, routing). A document with a bad structure asks for
    nothing; one whose solution is in doubt, or could not be judged, is not resolved.
    """
    joined = cut_lineage(docs.select("doc_id", "doc").join(replies.drop("round"), "doc_id", "left"))
    ordered = F.array_sort("found", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    found = rules_object.object_findings(joined).drop("index").withColumn("found", ordered)
    bad = F.exists("found", lambda f: F.coalesce(f["severity"], text.lookup(GRADE, f["rule"])) == "bad")
    rows = cut_lineage(found.withColumn("clear", ~bad))
    judged = cut_lineage(judge_rows(rows, options).withColumn("contexts", _contexts()))

    rules = _rule_issues(judged)
    of_judge = judged.where("judge_issue IS NOT NULL").select("doc_id", F.lit(0).alias("pos"), "judge_issue.*").select(*FIELDS)
    gate = issue_ops.solution_gate(issue_ops.merge_issues(rules, of_judge)).select("doc_id")
    candidates = judged.where(F.col("clear") & F.col("judge_done") & (F.size("contexts") > 0)).join(gate, "doc_id", "left_anti")
    asked = cut_lineage(candidates.select("doc_id", "doc", "contexts", *[c for c in SLOTS if c.startswith("resolve")]))
    resolved = cut_lineage(resolve_rows(asked, options))

    of_resolver = resolved.where("resolver IS NOT NULL").select("doc_id", F.posexplode("resolver.issues").alias("pos", "i")).select("doc_id", "pos", "i.*").select(*FIELDS)
    issues = cut_lineage(issue_ops.canonical_issues(issue_ops.merge_issues(rules, of_judge, of_resolver)))
    blocked = issue_ops.blocking_documents(issues, options.strict).select("doc_id", F.lit(True).alias("blocked"))
    whole = judged.join(resolved, "doc_id", "left").join(blocked, "doc_id", "left")
    complete = ~F.col("clear") | (F.col("judge_done") & F.coalesce("resolve_done", F.lit(True)))
    none = F.array().cast(f"array<{SLOT}>")
    return whole.select(
        "doc_id",
        "doc",
        "repair_fast",
        "repair_strong",
        "states",
        F.concat("judge_open", F.coalesce("resolve_open", none)).alias("open"),
        complete.alias("complete"),
        (complete & F.col("blocked").isNull()).alias("is_good"),
        "resolver",
        *[f"{s}_{c}" for s in ("judge", "resolver") for c in ROUTING],
    ), issues


# --- repair ---------------------------------------------------------------------------------------------------------------

PATCHES = "array<struct<op:string,path:string,value:variant>>"


def repair_step(rows: DataFrame, issues: DataFrame, options: Options) -> DataFrame:
    """What becomes of checked documents that are not good (rows as of `check`).

    Returns (doc_id, doc, decision, open, repair_status, patches, new_doc, context); repair_status is NULL while a reply is wanted.
    """
    wrong = rows.where(F.col("complete") & ~F.col("is_good"))
    theirs = issues.join(wrong.select("doc_id"), "doc_id", "left_semi")
    answered = wrong.where("resolver IS NOT NULL").select("doc_id", F.col("resolver.status").alias("status"), F.size("resolver.fixes").alias("n_fixes"))
    decided = repair.repair_decision(theirs, answered).select("doc_id", "decision")
    chosen = issue_ops.select_repair_issue(theirs).join(decided.where("decision = 'request'").select("doc_id"), "doc_id", "left_semi")
    asked = requests.repair_request(chosen.join(wrong.select("doc_id", "doc"), "doc_id")).select("doc_id", "repair_intent", "model_tier", "context", "context_error")
    step = wrong.join(decided, "doc_id").join(asked, "doc_id", "left").drop("states", "complete", "is_good", *[f"{s}_{c}" for s in ("judge", "resolver") for c in ROUTING])
    step = cut_lineage(step)

    wanted = (F.col("decision") == "request") & F.col("context_error").isNull()
    reply = F.when(F.col("model_tier") == "fast", F.col("repair_fast")).otherwise(F.col("repair_strong"))
    step = step.withColumn("content", F.when(wanted, reply))
    open_ = F.when(
        wanted & F.col("content").isNull(),
        F.array(F.struct(F.lit("repair").alias("stage"), F.col("model_tier"), F.lit(1).alias("run_no"))),
    ).otherwise(F.array().cast(f"array<{SLOT}>"))
    told = contracts.check_repair_replies(step.withColumn("open", open_).withColumn("answered", F.col("content").isNotNull())).drop("error")
    fixes = F.transform(
        F.col("resolver.fixes"),
        lambda x: F.struct(F.lit("replace").alias("op"), x["path"].alias("path"), F.parse_json(x["value"]).alias("value")),
    )
    status = (
        F.when(F.size("open") > 0, F.lit(None).cast("string"))
        .when(F.col("decision") == "align", "repaired")
        .when(F.col("answered"), F.col("repair_status"))
        .otherwise(dims.MANUAL)
    )
    patches = F.when(F.col("decision") == "align", fixes.cast(PATCHES)).when(F.col("answered"), F.col("patches").cast(PATCHES))
    planned = cut_lineage(told.select("doc_id", "doc", "decision", "open", "context", status.alias("planned"), F.when(status == "repaired", patches).alias("patches")))
    patched = cut_lineage(repair.patch_documents(planned.where("planned = 'repaired'").select("doc_id", "doc", "patches")))
    tested = cut_lineage(repair.accept_candidates(patched))
    accepted = cut_lineage(tested.join(patched.select("doc_id", "doc"), "doc_id"))
    guarded = repair.guard_repaired_text(accepted).select("doc_id", F.col("repair_status").alias("outcome"), "new_doc")
    return planned.join(guarded, "doc_id", "left").select(
        "doc_id", "doc", "decision", "open", F.coalesce("outcome", "planned").alias("repair_status"), "patches", F.when(F.col("outcome") == "repaired", F.col("new_doc")).alias("new_doc"), "context"
    )


# --- requests -------------------------------------------------------------------------------------------------------------


def _open_requests(rows: DataFrame, number: int) -> DataFrame:
    """Texts of the requests of a round's rows (doc_id, doc, open, states, context)."""
    opened = rows.where(F.size("open") > 0)
    asked = requests.judge_request(opened).select("doc_id", F.col("request").alias("shown"))
    stage = F.col("o.stage")
    text = (
        F.when(stage == "split", F.col("shown"))
        .when(stage == "judge", F.to_json(F.struct(F.col("shown").alias("document"), F.col("states").alias("states"))))
        .when(stage == "resolve", F.to_json(F.struct(_solution().alias("solution"), _contexts().alias("contexts"))))
        .otherwise(F.col("context"))
    )
    one = opened.join(asked, "doc_id").select("doc_id", "doc", "states", "context", "shown", F.explode("open").alias("o"))
    return one.select("doc_id", F.lit(number).alias("round"), "o.*", text.alias("request")).select(*REQUEST, "request")


# --- the flow -------------------------------------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def advance(docs: DataFrame, ledger: DataFrame, options: Options = Options()) -> Flow:
    """Where each document (doc_id, doc) stands by the replies of the ledger, and what is asked next.

    Results: (doc_id, round, open_stage, is_good, repair_status, stop_reason, loop_count, new_doc, patches, decision, judge_*, resolver_*). While
    open_stage is not NULL, is_good is NULL unless the first check is complete. A document that a later round turns good keeps the
    is_good and the issues of its first check, as what is published is about the document that came in; the repaired one is `new_doc`.
    """
    replies = cut_lineage(answers(ledger))
    frontier, ended, asked = docs.select("doc_id", "doc"), [], []
    first_rows, first_issues = None, None
    nothing = {"text": F.lit(None).cast("string"), "doc": F.lit(None).cast("variant"), "patches": F.lit(None).cast(PATCHES)}

    def end(rows: DataFrame, number: int, *, stage=None, reason=None, status=None, loops: int = 0, doc: Column | None = None) -> None:
        lit = lambda x: nothing["text"] if x is None else F.lit(x) if isinstance(x, str) else x
        ended.append(
            rows.select(
                "doc_id",
                F.lit(number).alias("round"),
                lit(stage).alias("open_stage"),
                lit(reason).alias("stop_reason"),
                lit(status).alias("repair_status"),
                F.lit(loops).alias("loop_count"),
                (nothing["doc"] if doc is None else doc).alias("new_doc"),
                (F.col("patches") if "patches" in rows.columns else nothing["patches"]).alias("patches"),
                (F.col("decision") if "decision" in rows.columns else nothing["text"]).alias("decision"),
            )
        )

    for number in range(options.rounds + 1):
        rows, issues = check(frontier, replies.where(F.col("round") == number), options)
        rows = cut_lineage(rows)
        if number == 0:
            first_rows, first_issues = rows, issues
        kept = {"status": "repaired", "doc": F.col("doc")} if number else {"status": "skipped"}
        waiting = rows.where(~F.col("complete"))
        end(waiting, number, stage=F.get(F.col("open"), F.lit(0))["stage"], loops=number, **(kept | {"status": None}))
        asked.append(_open_requests(waiting.withColumn("context", F.lit(None).cast("string")), number))
        good = rows.where(F.col("complete") & F.col("is_good"))
        end(good, number, reason="recheck_good" if number else "already_good" if options.rounds else "auto_repair_disabled", loops=number, **kept)
        wrong = rows.where(F.col("complete") & ~F.col("is_good"))
        if number == options.rounds:
            end(wrong, number, reason="max_loop_reached" if number else "auto_repair_disabled", loops=number, **kept)
            break
        outcome = cut_lineage(repair_step(rows, issues, options))
        opened = outcome.where("repair_status IS NULL")
        end(opened, number, stage="repair", loops=number, **(kept | {"status": None}))
        asked.append(_open_requests(opened.withColumn("states", F.lit(None).cast("string")), number))
        failed = outcome.where("repair_status <> 'repaired'")
        status = F.lit("repaired") if number else F.col("repair_status")  # an earlier success counts even if a later round fails
        end(failed, number, reason=F.col("repair_status"), status=status, loops=number + 1, doc=kept.get("doc"))
        frontier = outcome.where("repair_status = 'repaired'").select("doc_id", F.col("new_doc").alias("doc"))
        if frontier.isEmpty():
            break

    checked = first_rows.select("doc_id", F.when(F.col("complete"), F.col("is_good")).alias("is_good"), *[f"{s}_{c}" for s in ("judge", "resolver") for c in ROUTING])
    return Flow(_union(asked), checked.join(_union(ended), "doc_id"), first_issues)


def publish(flow: Flow, debug: bool = False) -> DataFrame:
    """The documents that are through, as published (see `rollup.public_result`)."""
    from rubrica.operators import rollup

    through = flow.results.where("open_stage IS NULL")
    return rollup.public_result(through, flow.issues, debug)


def summary(flow: Flow) -> DataFrame:
    """One row of totals and rates over the documents that are through (see `rollup.quality_summary`)."""
    from rubrica.operators import rollup

    through = flow.results.where("open_stage IS NULL").select("doc_id", "is_good", "repair_status", *[f"{s}_{c}" for s in ("judge", "resolver") for c in ROUTING])
    return rollup.quality_summary(rollup.result_status(through, flow.issues))
