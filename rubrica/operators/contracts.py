"""Contracts of model replies: each parsed reply (a VARIANT) is checked inside its row.

A contract is a list of `Field`s. Checks give the first error as text ("place: class of error") or NULL, in the
order of the fields. Types are strict, a null where a default exists takes the default, unknown keys are ignored
unless the contract is closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rubrica import dims
from rubrica.functions import pointers, text as t, variants as v
from rubrica.functions.expressions import kept
from rubrica.functions.text import bind
from rubrica.operators import rules_plan

MISSING = "required field is missing"
WRONG_OBJECT = "must be a JSON object"
WRONG_LIST = "must be a list"
WRONG_STRING = "must be a string"
WRONG_BOOLEAN = "must be true or false"
WRONG_VALUE = "is not an allowed value"
WRONG_TYPE = "has the wrong type or shape"
NO_OBJECT = "The reply holds no JSON object."


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, integer, boolean, any, list, object or one-of
    required: bool = True
    nullable: bool = False
    allowed: tuple = ()
    inner: tuple = ()  # fields of an object or of the members of a list
    member: str = "object"  # kind of the members of a list
    closed: bool = False


@dataclass(frozen=True)
class Contract:
    fields: tuple
    closed: bool = False


SPLIT = Contract(
    (
        Field(
            "states",
            "list",
            required=False,
            inner=(
                Field("solution_index", "integer", required=False),
                Field("order", "integer"),
                Field("source_path", "string"),
                Field("source_text", "string"),
            ),
        ),
    )
)
TRANSITIONS = Contract(
    (
        Field(
            "stage_results",
            "list",
            closed=True,
            inner=(
                Field("solution_index", "integer", required=False),
                Field("stage", "integer"),
                Field("from_order", "integer"),
                Field("to_order", "integer"),
                Field("kiem_tra_so_hoc", "string", nullable=True),
                Field("kiem_tra_lap_luan", "string"),
                Field("trang_thai_buoc", "boolean"),
                Field("reason", "string"),
            ),
        ),
        Field("reason", "string"),
        Field("suggestion", "string"),
        Field("verdict", "one-of", allowed=tuple(dims.VERDICTS)),
    ),
    closed=True,
)
RESOLVER = Contract(
    (
        Field("resolver_status", "one-of", allowed=tuple(dims.RESOLVER_STATUSES)),
        Field("answerSpec_matches_solution", "boolean"),
        Field(
            "fields_to_fix",
            "list",
            required=False,
            inner=(
                Field("path", "string"),
                Field("value", "any"),
                Field("reason", "string", required=False),
                Field("suggestion", "string", required=False),
            ),
        ),
        Field(
            "issues",
            "list",
            required=False,
            inner=(
                Field("severity", "one-of", allowed=tuple(dims.SEVERITIES)),
                Field("category", "one-of", allowed=tuple(dims.RESOLVER_CATEGORIES)),
                Field("location", "string"),
                Field("reason", "string"),
                Field("suggestion", "string"),
                Field("repair_intent", "one-of", allowed=tuple(dims.RESOLVER_INTENTS)),
            ),
        ),
    )
)
REPAIR = Contract(
    (
        Field("repair_status", "one-of", allowed=tuple(dims.REPAIR_STATUSES)),
        Field(
            "patches",
            "list",
            required=False,
            inner=(
                Field("op", "one-of", allowed=tuple(dims.PATCH_OPS)),
                Field("path", "string"),
            ),
        ),
        Field("failed_reason", "list", required=False, member="string"),
        Field("suggestions", "list", required=False, member="string"),
    )
)
SPELLING = Contract(
    (
        Field(
            "issues",
            "list",
            required=False,
            inner=(
                Field("severity", "one-of", allowed=tuple(dims.SEVERITIES)),
                Field("category", "one-of", required=False, allowed=("spelling_wording",)),
                Field("location", "string"),
                Field("reason", "string"),
                Field("suggestion", "string"),
                Field("error_snippet", "string", required=False),
                Field("corrected_text", "string", required=False),
                Field("repair_intent", "one-of", required=False, allowed=("fix_spelling_wording",)),
            ),
        ),
    )
)


def _error(place: Column, what: str) -> Column:
    return F.concat(place, F.lit(f": {what}"))


def _scalar_error(value: Column, spec: Field, kind: str, place: Column) -> Column:
    if kind == "any":
        return F.lit(None).cast("string")
    actual = v.kind(value)
    if kind == "one-of":
        good = F.coalesce(v.string_of(value).isin(list(spec.allowed)), F.lit(False))
        return F.when(~good, _error(place, WRONG_VALUE))
    message = {"string": WRONG_STRING, "boolean": WRONG_BOOLEAN}.get(kind, WRONG_TYPE)
    return F.when(actual != kind, _error(place, message))


def _members_error(value: Column, fields: tuple, closed: bool, place: Column) -> Column:
    """First error among the members of an object."""
    errors = [_field_error(v.get(value, f.name), f, F.concat(place, F.lit(f.name))) for f in fields]
    if closed:
        names = [f.name for f in fields]
        extra = F.get(F.filter(F.map_keys(v.as_map(value)), lambda k: ~k.isin(*names)), F.lit(0))
        errors.append(F.when(extra.isNotNull(), F.concat(place, extra, F.lit(f": {WRONG_TYPE}"))))
    return F.coalesce(*errors)


def _field_error(value: Column, spec: Field, place: Column) -> Column:
    if spec.kind == "list":

        def member_error(x: Column, i: Column) -> Column:
            at = F.concat(place, F.lit("."), i.cast("string"))
            if spec.member != "object":
                return _scalar_error(x, spec, spec.member, at)
            return F.when(~v.is_object(x), _error(at, WRONG_OBJECT)).otherwise(
                _members_error(x, spec.inner, spec.closed, F.concat(at, F.lit(".")))
            )

        inside = F.get(F.array_compact(F.transform(v.as_array(value), member_error)), F.lit(0))
        wrong = F.when(~v.is_array(value), _error(place, WRONG_LIST)).otherwise(inside)
    else:
        wrong = _scalar_error(value, spec, spec.kind, place)
    if not spec.required:
        return F.when(~v.absent(value), wrong)
    if spec.kind == "any":
        return F.when(value.isNull(), _error(place, MISSING))
    if spec.nullable:
        return F.when(value.isNull(), _error(place, MISSING)).when(~v.absent(value), wrong)
    return F.when(value.isNull(), _error(place, MISSING)).otherwise(wrong)


def contract_error(reply: Column, contract: Contract) -> Column:
    """The first error of a reply, NULL when it keeps the contract."""
    return F.when(~v.is_object(reply) | reply.isNull(), F.lit(WRONG_OBJECT)).otherwise(
        _members_error(reply, contract.fields, contract.closed, F.lit(""))
    )


# --- splitter ---------------------------------------------------------------------------------------------------

STATES = "array<struct<solution_index:int,order:int,source_path:string,source_text:string>>"


def split_states(reply: Column) -> Column:
    """States of a split reply in reply order."""
    return F.transform(
        v.listed(reply, "states"),
        lambda s: F.struct(
            F.coalesce(F.try_variant_get(s, "$.solution_index", "int"), F.lit(0)).alias("solution_index"),
            F.try_variant_get(s, "$.order", "int").alias("order"),
            F.try_variant_get(s, "$.source_path", "string").alias("source_path"),
            F.try_variant_get(s, "$.source_text", "string").alias("source_text"),
        ),
    )


def split_error(states: Column, blocks: Column) -> Column:
    """Why the states of one reply do not reproduce the source blocks of its document, NULL when they do.

    blocks: array<struct<solution_index, rank, path, text>> of the document, in order.
    """

    def block_of(path: Column) -> Column:
        return F.get(F.filter(blocks, lambda b: b["path"] == path), F.lit(0))

    def state_error(s: Column) -> Column:
        block = block_of(s["source_path"])
        return (
            F.when(block["path"].isNull(), F.concat(F.lit("unknown source path: "), s["source_path"]))
            .when(block["solution_index"] != s["solution_index"], F.concat(F.lit("wrong solution for "), s["source_path"]))
            .when(s["source_text"] == "", F.concat(F.lit("empty state at "), s["source_path"]))
        )

    def text_error(b: Column) -> Column:
        pieces = F.transform(F.filter(states, lambda s: s["source_path"] == b["path"]), lambda s: s["source_text"])
        return F.when(
            F.array_join(pieces, "") != b["text"], F.concat(F.lit("text changed at "), b["path"])
        )

    skipped = F.exists(
        blocks, lambda b: ~F.exists(states, lambda s: s["source_path"] == b["path"])
    )

    def order_error(n: Column) -> Column:
        own = F.filter(states, lambda s: s["solution_index"] == n)
        orders = F.transform(own, lambda s: s["order"])
        ranks = F.transform(own, lambda s: block_of(s["source_path"])["rank"])
        wanted = F.transform(own, lambda s, i: i.cast("int"))
        return F.when(orders != wanted, F.concat(F.lit("orders of solution "), n.cast("string"), F.lit(" have gaps"))).when(
            ranks != F.array_sort(ranks), F.concat(F.lit("blocks of solution "), n.cast("string"), F.lit(" moved"))
        )

    solutions = F.array_sort(F.array_distinct(F.transform(states, lambda s: s["solution_index"])))
    first = lambda array, make: F.get(F.array_compact(F.transform(array, make)), F.lit(0))
    return F.coalesce(
        first(states, state_error),
        F.when(F.coalesce(skipped, F.lit(False)), "a source block was skipped"),
        first(blocks, text_error),
        first(solutions, order_error),
    )


def _first_good(tried: Column, name: str) -> Column:
    """As `_first_valid`, for one reply in its row: struct<error, name>."""
    return bind(
        tried,
        lambda all_: bind(
            F.get(F.filter(all_, lambda c: c["error"].isNull()), F.lit(0)),
            lambda good: F.struct(
                F.when(good.isNull(), F.coalesce(F.get(all_, F.size(all_) - 1)["error"], F.lit(NO_OBJECT))).alias("error"),
                good[name].alias(name),
            ),
        ),
    )


def split_reply(content: Column, blocks: Column) -> Column:
    """One split reply in the row of its document: struct<error, states>."""
    candidate = lambda c: F.struct(
        F.coalesce(contract_error(c, SPLIT), split_error(split_states(c), blocks)).alias("error"), split_states(c).alias("states")
    )
    return _first_good(F.transform(v.fenced_objects(content), candidate), "states")


def transition_reply(content: Column) -> Column:
    """One judge reply in the row of its document: struct<error, judgement>."""
    candidate = lambda c: F.struct(contract_error(c, TRANSITIONS).alias("error"), judgement(c).alias("judgement"))
    return _first_good(F.transform(v.fenced_objects(content), candidate), "judgement")


def resolver_reply(content: Column, solution_text: Column, known_options: Column, doc: Column) -> Column:
    """One resolver reply in the row of its document: struct<error, fields>, the issues of the fields being those that count."""

    def checked(reply: Column) -> Column:
        shape = F.when(reply.isNull(), NO_OBJECT).otherwise(contract_error(reply, RESOLVER))
        return bind(
            resolver_fields(reply, solution_text),
            lambda fields: bind(
                F.coalesce(shape, resolver_error(fields, known_options, doc)),
                lambda error: F.struct(
                    error.alias("error"), F.when(error.isNull(), fields.withField("issues", resolver_issues(fields))).alias("fields")
                ),
            ),
        )

    return bind(v.parse_reply(content), checked)


def check_split_replies(replies: DataFrame) -> DataFrame:
    """replies: (doc_id, content, blocks). The first candidate that keeps the contract is used."""
    candidate = lambda c: F.struct(
        F.coalesce(contract_error(c, SPLIT), split_error(split_states(c), F.col("blocks"))).alias("error"),
        split_states(c).alias("states"),
    )
    tried = F.transform(v.fenced_objects(F.col("content")), candidate)
    return _first_valid(replies, tried, STATES, "states")


def _first_valid(replies: DataFrame, tried: Column, dtype: str, name: str) -> DataFrame:
    """The first candidate without error; else the error of the last one."""
    keep = [c for c in replies.columns if c not in ("content", "blocks")]
    step = replies.withColumn("tried", tried)
    good = F.get(F.filter("tried", lambda c: c["error"].isNull()), F.lit(0))
    last = F.get(F.col("tried"), F.size("tried") - 1)
    return step.select(
        *keep,
        good.isNotNull().alias("valid"),
        F.when(good.isNull(), F.coalesce(last["error"], F.lit(NO_OBJECT))).alias("error"),
        good[name].cast(dtype).alias(name),
    )


# --- transitions ------------------------------------------------------------------------------------------------

STAGES = (
    "array<struct<sol:int,stage:int,from_order:int,to_order:int,reasoning:string,ok:boolean,reason:string>>"
)


def judgement(reply: Column) -> Column:
    """Typed fields of a transition reply."""

    def stage(s: Column) -> Column:
        text = lambda k: F.try_variant_get(s, f"$.{k}", "string")
        number = lambda k: F.try_variant_get(s, f"$.{k}", "int")
        return F.struct(
            F.coalesce(number("solution_index"), F.lit(0)).alias("sol"),
            number("stage").alias("stage"),
            number("from_order").alias("from_order"),
            number("to_order").alias("to_order"),
            text("kiem_tra_lap_luan").alias("reasoning"),
            F.try_variant_get(s, "$.trang_thai_buoc", "boolean").alias("ok"),
            text("reason").alias("reason"),
        )

    top = lambda k: F.try_variant_get(reply, f"$.{k}", "string")
    return F.struct(
        top("verdict").alias("verdict"),
        top("reason").alias("reason"),
        top("suggestion").alias("suggestion"),
        F.transform(v.listed(reply, "stage_results"), stage).alias("stages"),
    )


def parse_transition_replies(replies: DataFrame) -> DataFrame:
    """Judgements in contract shape; `sequence.check_transitions` then compares them with the stages asked for."""
    tried = F.transform(
        v.fenced_objects(F.col("content")),
        lambda c: F.struct(contract_error(c, TRANSITIONS).alias("error"), judgement(c).alias("judgement")),
    )
    dtype = f"struct<verdict:string,reason:string,suggestion:string,stages:{STAGES}>"
    return _first_valid(replies, tried, dtype, "judgement")


# --- resolver ---------------------------------------------------------------------------------------------------


def resolver_fields(reply: Column, solution_text: Column) -> Column:
    """Typed reply of the answer resolver; a bare answer counts as text or as expected value."""
    answer = v.get(reply, "final_answer")
    nested = v.is_object(answer)
    bare = F.when(~nested & ~v.absent(answer), answer)
    string = lambda k: F.when(nested, v.string_of(v.get(answer, k)))
    status = F.try_variant_get(reply, "$.resolver_status", "string")
    evidence = t.strip(F.coalesce(string("evidence_from_solution"), F.lit("")))
    expected = F.when(nested, v.get(answer, "expected")).otherwise(F.when(~v.is_string(bare), bare))
    return F.struct(
        status.alias("status"),
        F.coalesce(string("text"), v.string_of(bare)).alias("text"),
        string("matched_option_id").alias("matched_option_id"),
        F.transform(v.listed(answer, "correctOptionIds"), v.text_of).alias("correct_option_ids"),
        F.when(~v.absent(expected), F.to_json(expected)).alias("expected"),
        F.when((status == "resolved") & (evidence == ""), t.strip(F.coalesce(solution_text, F.lit(""))))
        .otherwise(evidence)
        .alias("evidence"),
        F.try_variant_get(reply, "$.answerSpec_matches_solution", "boolean").alias("matches"),
        F.transform(
            v.listed(reply, "fields_to_fix"),
            lambda x: F.struct(
                pointers.to_pointer(v.text_of(v.get(x, "path"))).alias("path"),
                F.to_json(v.get(x, "value")).alias("value"),
            ),
        ).alias("fixes"),
        F.transform(
            v.listed(reply, "issues"),
            lambda x: _resolver_issue(lambda k: v.string_of(v.get(x, k))),
        ).alias("issues"),
    )


def _resolver_issue(get) -> Column:
    category = get("category")
    intent = (
        F.when(category == "solution_anchor_consistency", "align_fields_to_solution")
        .when(category == "hint_quality", "align_hint_to_solution")
        .otherwise(get("repair_intent"))
    )
    return F.struct(
        get("severity").alias("severity"),
        category.alias("category"),
        pointers.to_pointer(get("location")).alias("location"),
        t.strip(get("reason")).alias("reason"),
        t.strip(get("suggestion")).alias("suggestion"),
        intent.alias("repair_intent"),
    )


def resolver_error(fields: Column, known_options: Column, doc: Column | None = None) -> Column:
    """Why a typed resolver reply cannot be used, NULL when it can. Checks run in the order of the contract.

    known_options: option ids of the document. With `doc`, every fix must also lead to an existing value.
    """
    resolved = fields["status"] == "resolved"
    nothing = (
        (F.coalesce(fields["text"], F.lit("")) == "")
        & (F.coalesce(fields["matched_option_id"], F.lit("")) == "")
        & (F.coalesce(F.size(fields["correct_option_ids"]), F.lit(0)) <= 0)
        & F.coalesce(fields["expected"].isin('""', "[]"), F.lit(True))
    )
    option = F.coalesce(fields["matched_option_id"], F.lit(""))
    n_fixes = F.coalesce(F.size(fields["fixes"]), F.lit(0))

    def bad_fix(x: Column) -> Column:
        wrong = ~pointers.fix_path_shape(x["path"])
        return wrong if doc is None else wrong | v.at_pointer(doc, x["path"]).isNull()

    return (
        F.when(F.coalesce(~fields["status"].isin(dims.RESOLVER_STATUSES), F.lit(True)), "status")
        .when(fields["matches"].isNull(), "match_flag")
        .when(resolved & nothing, "no_conclusion")
        .when(resolved & (fields["evidence"] == ""), "no_evidence")
        .when((option != "") & ~F.coalesce(F.array_contains(known_options, option), F.lit(False)), "unknown_option")
        .when(~resolved, F.lit(None).cast("string"))
        .when(F.exists(fields["fixes"], bad_fix), "bad_fix")
        .when(fields["matches"] & (n_fixes > 0), "match_with_fixes")
        .when(~fields["matches"] & (n_fixes <= 0), "mismatch_without_fixes")
    )


def resolver_issues(fields: Column) -> Column:
    """The issues of a valid reply that count: alignment ones, or the first manual one of a manual review."""
    manual = F.filter(
        fields["issues"], lambda i: (i["category"] == "solution_quality") & (i["repair_intent"] == dims.MANUAL)
    )
    aligned = F.filter(
        fields["issues"], lambda i: i["category"].isin("solution_anchor_consistency", "hint_quality")
    )
    return F.when(fields["status"] == "resolved", aligned).otherwise(F.slice(manual, 1, 1))


def check_resolver_replies(replies: DataFrame) -> DataFrame:
    """replies: (doc_id, content, solution_text, known_options, doc)."""
    parsed = replies.withColumn("reply", v.parse_reply(F.col("content")))
    shaped = parsed.withColumns(
        {
            "shape": F.when(F.col("reply").isNull(), NO_OBJECT).otherwise(contract_error(F.col("reply"), RESOLVER)),
            "fields": resolver_fields(F.col("reply"), F.col("solution_text")),
        }
    )
    error = F.coalesce("shape", resolver_error(F.col("fields"), F.col("known_options"), F.col("doc")))
    drop = ("content", "reply", "shape", "solution_text", "known_options", "doc", "fields")
    return shaped.withColumn("error", error).select(
        *[c for c in replies.columns if c not in drop],
        F.col("error").isNull().alias("valid"),
        "error",
        F.when(F.col("error").isNull(), F.col("fields")).alias("fields"),
        F.when(F.col("error").isNull(), resolver_issues(F.col("fields"))).alias("issues"),
    )


def unknown_matched_options(replies: DataFrame, options: DataFrame) -> DataFrame:
    """Replies (doc_id, matched_option_id) whose option is not among the options of their document."""
    named = replies.filter(F.coalesce("matched_option_id", F.lit("")) != "")
    known = options.select("doc_id", F.col("opt_id").alias("matched_option_id")).distinct()
    return named.join(known, ["doc_id", "matched_option_id"], "left_anti")


# --- repair and spelling ----------------------------------------------------------------------------------------


def repair_error(status: Column, intent: Column, patches: Column) -> Column:
    """Why the patches array<struct<op, path>> of a reply cannot be applied, NULL when they can."""

    def patch_error(p: Column) -> Column:
        pointer = pointers.to_pointer(p["path"])
        return (
            F.when(F.coalesce(~p["op"].isin(dims.PATCH_OPS), F.lit(True)), "bad_operation")
            .when(~pointers.safe_patch_path(p["path"]), "unsafe_path")
            .when(~pointers.patch_scope(intent, pointer), "out_of_scope")
        )

    return (
        F.when(F.coalesce(~status.isin(dims.REPAIR_STATUSES), F.lit(True)), "status")
        .when(status != "repaired", F.lit(None).cast("string"))
        .when(F.coalesce(F.size(patches), F.lit(0)) <= 0, "no_patches")
        .otherwise(F.get(F.array_compact(F.transform(patches, patch_error)), F.lit(0)))
    )


def patches_of(reply: Column) -> Column:
    return F.transform(
        v.listed(reply, "patches"),
        lambda p: F.struct(
            F.try_variant_get(p, "$.op", "string").alias("op"),
            F.try_variant_get(p, "$.path", "string").alias("path"),
            v.get(p, "value").alias("value"),
        ),
    )


def check_repair_replies(replies: DataFrame) -> DataFrame:
    """replies: (doc_id, content, repair_intent). Invalid ones become manual reviews."""
    parsed = replies.withColumn("reply", v.parse_reply(F.col("content")))
    status = F.try_variant_get("reply", "$.repair_status", "string")
    shape = F.when(F.col("reply").isNull(), NO_OBJECT).otherwise(contract_error(F.col("reply"), REPAIR))
    error = F.coalesce(shape, repair_error(status, F.col("repair_intent"), patches_of(F.col("reply"))))
    return parsed.withColumn("error", error).select(
        *[c for c in replies.columns if c != "content"],
        "error",
        F.when(F.col("error").isNotNull(), dims.MANUAL).otherwise(status).alias("repair_status"),
        F.when(F.col("error").isNull() & (status == "repaired"), patches_of(F.col("reply"))).alias("patches"),
    )


def check_spelling_replies(replies: DataFrame) -> DataFrame:
    """Issues of spelling replies (doc_id, content), one row per issue; a bad reply gives one review issue."""
    parsed = replies.withColumn("reply", v.parse_reply(F.col("content")))
    error = F.when(F.col("reply").isNull(), NO_OBJECT).otherwise(contract_error(F.col("reply"), SPELLING))
    get = lambda x, k: v.string_of(v.get(x, k))
    listed = F.transform(
        v.listed(F.col("reply"), "issues"),
        lambda x: F.struct(
            get(x, "severity").alias("severity"),
            pointers.to_pointer(get(x, "location")).alias("location"),
            t.strip(get(x, "reason")).alias("reason"),
            t.strip(get(x, "suggestion")).alias("suggestion"),
            get(x, "corrected_text").alias("corrected_text"),
        ),
    )
    fallback = F.array(
        F.struct(
            F.lit("needs_review").alias("severity"),
            F.lit("/spelling").alias("location"),
            F.lit("The spelling reply could not be used.").alias("reason"),
            F.lit("Review by hand or run it again.").alias("suggestion"),
            F.lit(None).cast("string").alias("corrected_text"),
        )
    )
    keep = [c for c in replies.columns if c != "content"]
    step = parsed.withColumn("error", error)
    chosen = F.when(F.col("error").isNull(), listed).otherwise(fallback)
    return step.select(*keep, "error", F.posexplode(chosen).alias("pos", "i")).select(
        *keep,
        "error",
        "pos",
        "i.*",
        F.lit("spelling_wording").alias("category"),
        F.lit("fix_spelling_wording").alias("repair_intent"),
    )


# --- plan evaluations -------------------------------------------------------------------------------------------


def missing_fields(value: Column, required: list[str]) -> Column:
    """Required names that an object lacks, in name order."""
    return F.array_sort(
        F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(v.as_map(value)))
    )


def _not_in(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(~v.string_of(value).isin(allowed), F.lit(True))


def _errors(*texts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*texts)), "; ")


def plan_reply_error(content: Column, reply: Column) -> Column:
    """All errors of a plan evaluation joined into one text, '' when there is none."""
    missing = missing_fields(reply, dims.RESULT_FIELDS)
    status = lambda name, allowed: F.when(
        _not_in(v.get(reply, name), allowed), F.concat(F.lit(f"{name} is not valid: "), F.coalesce(v.text_of(v.get(reply, name)), F.lit("null")))
    )

    def issue_error(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("issues["), (i + 1).cast("string"), F.lit("] "))
        lacks = missing_fields(x, dims.ISSUE_FIELDS)
        return F.when(~v.is_object(x), F.concat(at, F.lit("is not an object"))).when(
            F.size(lacks) > 0, F.concat(at, F.lit("lacks "), F.array_join(lacks, ", "))
        )

    issues = v.as_array(v.get(reply, "issues"))
    inside = _errors(
        F.when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", "))),
        status("overall_status", list(dims.PLAN_STATUS_RANK)),
        status("coverage_status", dims.COVERAGE_STATUSES),
        status("confidence", dims.CONFIDENCES),
        F.when(issues.isNull(), "issues is not a list"),
        F.nullif(F.array_join(F.array_compact(F.transform(issues, issue_error)), "; "), F.lit("")),
    )
    fenced = F.when(t.strip(content).startswith("```"), "reply starts with a code fence")
    body = F.when(reply.isNull(), F.lit(NO_OBJECT)).otherwise(F.nullif(inside, F.lit("")))
    return _errors(fenced, body)


def check_plan_replies(replies: DataFrame) -> DataFrame:
    """Validity of plan evaluations (record_id, content, ...); invalid ones become low-confidence reviews."""
    parsed = replies.withColumn("reply", v.parse_reply(F.col("content")))
    step = parsed.withColumn("error", plan_reply_error(F.col("content"), F.col("reply")))
    ok = F.col("error") == ""
    given = lambda name, fallback: F.when(
        ok, F.try_variant_get("reply", f"$.{name}", "string")
    ).otherwise(fallback)
    return step.select(
        *[c for c in replies.columns if c != "content"],
        ok.alias("valid"),
        "error",
        given("overall_status", "needs_review").alias("overall_status"),
        given("coverage_status", "unclear").alias("coverage_status"),
        given("confidence", "low").alias("confidence"),
        F.when(ok, F.col("reply")).alias("reply"),
    )


def plan_repair_error(reply: Column) -> Column:
    """All errors of a plan repair reply joined into one text, '' when there is none."""
    missing = missing_fields(reply, dims.REPAIR_FIELDS)
    listed = v.as_array(v.get(reply, "repair_suggestions"))

    def suggestion_error(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("suggestion "), (i + 1).cast("string"), F.lit(" "))
        lacks = missing_fields(x, dims.SUGGESTION_FIELDS)
        banned = F.array_sort(
            F.array_intersect(F.map_keys(v.as_map(x)), F.array(*[F.lit(k) for k in dims.PATCH_STYLE_KEYS]))
        )
        decision = t.truncate_text(v.content_text(v.get(x, "primary_decision")), None)
        hedge = t.ambiguous_phrase(decision)
        inside = _errors(
            F.when(F.size(banned) > 0, F.concat(at, F.lit("has patch keys "), F.array_join(banned, ", "))),
            F.when(F.size(lacks) > 0, F.concat(at, F.lit("lacks "), F.array_join(lacks, ", "))),
            F.when(decision == "", F.concat(at, F.lit("has no decision"))),
            F.when(hedge.isNotNull(), F.concat(at, F.lit("hedges: "), hedge)),
        )
        return F.when(~v.is_object(x), F.concat(at, F.lit("is not an object"))).otherwise(
            F.nullif(inside, F.lit(""))
        )

    inside = _errors(
        F.when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", "))),
        F.when(listed.isNull(), "repair_suggestions is not a list"),
        F.when(_not_in(v.get(reply, "preview_strategy"), dims.PREVIEW_STRATEGIES), "preview_strategy is not valid"),
        F.nullif(F.array_join(F.array_compact(F.transform(listed, suggestion_error)), "; "), F.lit("")),
        F.when(_not_in(v.get(reply, "repair_confidence"), dims.CONFIDENCES), "repair_confidence is not valid"),
    )
    return F.when(reply.isNull(), F.lit(NO_OBJECT)).otherwise(inside)


def check_plan_repair(replies: DataFrame) -> DataFrame:
    """Plan repair replies (record_id, content): a preview is used only if it passes the earlier plan gate."""
    parsed = replies.withColumn("reply", v.parse_reply(F.col("content")))
    step = parsed.withColumns(
        {"error": plan_repair_error(F.col("reply")), "preview": v.get(F.col("reply"), "rewritten_question_plan_preview")}
    )
    ok = F.col("error") == ""
    full = F.coalesce(F.try_variant_get("reply", "$.preview_strategy", "string") == "full_object", F.lit(False))
    problems = F.when(
        full, F.coalesce(F.size(rules_plan.strict_problems(F.col("preview"), require_text=False)), F.lit(1))
    ).otherwise(F.when(~v.absent(F.col("preview")), 1).otherwise(0))
    step = step.withColumn("n_problems", F.when(ok, problems))
    usable = ok & full & (F.col("n_problems") == 0)
    n_suggestions = F.size(v.listed(F.col("reply"), "repair_suggestions"))
    manual = F.try_variant_get("reply", "$.manual_review_required", "boolean")
    return step.select(
        "record_id",
        ok.alias("valid"),
        "error",
        F.when(usable, "full_object").otherwise("not_safe").alias("preview_strategy"),
        F.when(usable, F.col("preview")).alias("preview"),
        F.when(~ok, "low").otherwise(F.try_variant_get("reply", "$.repair_confidence", "string")).alias("confidence"),
        (
            ~ok
            | (~usable & ~v.absent(F.col("preview")))
            | (~usable & (n_suggestions == 0))
            | F.coalesce(manual, F.lit(True))
        ).alias("manual_review"),
    )


# --- normalising plan evaluations -------------------------------------------------------------------------------


def normalize_plan_issues(issues: DataFrame) -> DataFrame:
    """Fill in the enums of plan issues and note summaries that say nothing."""
    one_of = lambda c, allowed, default: F.when(F.col(c).isin(allowed), F.col(c)).otherwise(default)
    known_type = F.when(F.col("issue_type").isin(dims.ISSUE_TYPES), F.col("issue_type")).otherwise("")
    summary = t.strip(F.coalesce("summary", F.lit("")))
    impact = t.strip(F.coalesce("impact_on_generation", F.lit("")))
    note = F.lit("Note: the summary only names a kind of problem; read the evidence.")
    return issues.withColumns(
        {
            "issue_level": one_of("issue_level", dims.ISSUE_LEVELS, "plan"),
            "severity": one_of("severity", dims.PLAN_ISSUE_SEVERITIES, "needs_review"),
            "issue_type": one_of("issue_type", dims.ISSUE_TYPES, "selected_scope_issue"),
            "confidence": one_of("confidence", dims.CONFIDENCES, "medium"),
            "summary": summary,
            "is_generic": t.generic_summary(summary, known_type),
            "impact_on_generation": F.when(
                t.generic_summary(summary, known_type), F.concat_ws(" ", t.non_blank(impact), note)
            ).otherwise(impact),
            "requires_human_review": F.coalesce("requires_human_review", F.lit(False)),
        }
    )


def structural_rows(records: DataFrame, rollup: DataFrame) -> DataFrame:
    """Prefilled evaluations of records that no model is asked about."""
    return (
        kept(rollup, ~F.col("structural_valid"))
        .join(records, "record_id")
        .select(
            "record_id",
            F.lit("structural_error").alias("overall_status"),
            F.lit("not_evaluable").alias("coverage_status"),
            F.lit("high").alias("confidence"),
            F.col("reason").alias("summary"),
            "evidence",
            F.lit("structural_error").alias("issue_type"),
            F.lit(True).alias("requires_human_review"),
        )
    )


def skipped_rows(records: DataFrame) -> DataFrame:
    """Prefilled evaluations of records whose source is not fit to be evaluated."""
    return records.select(
        "record_id",
        F.lit("skipped_due_to_source_issue").alias("overall_status"),
        F.lit("not_evaluable").alias("coverage_status"),
        F.lit("high").alias("confidence"),
    )
