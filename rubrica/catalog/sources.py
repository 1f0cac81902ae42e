"""Reading, unwrapping, flattening and pointers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.functions import pointers, text as t, variants as v
from rubrica.operators import flatten
from rubrica.session import checkpoint_dir
from rubrica.sources import chunks, documents, replies, sinks

# Payloads of every shape: an object, a list, a wrapper, a scalar and an empty list, in turn.
PAYLOAD = (
    "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ', 7, {\"id\": \"', event_type, '\"}]') "
    "WHEN 2 THEN concat('{\"generatedQuestions\": [', props, ']}') WHEN 3 THEN '5' ELSE '[]' END"
)
PAYLOAD_ROWS = (
    "SELECT event_id AS batch_id, 0 AS pos, 'item[0]' AS id, true AS is_object FROM events WHERE event_id % 5 IN (0, 1, 2) "
    "UNION ALL SELECT event_id, 1, 'item[1]', false FROM events WHERE event_id % 5 = 1 "
    "UNION ALL SELECT event_id, 2, event_type, true FROM events WHERE event_id % 5 = 1"
)


def payloads(spark, sf):
    events = rel.table(spark, sf, "events")
    return documents.parse_payloads(events.select("event_id", F.expr(PAYLOAD).alias("body")), "event_id", "body")


@query("unwrap_json_props", PAYLOAD_ROWS)
def unwrap_json_props(spark, sf):
    return documents.unwrap_payload(payloads(spark, sf)).select("batch_id", "pos", "id", "is_object")


@query("empty_batches", "SELECT event_id AS batch_id, 'bad' AS severity FROM events WHERE event_id % 5 IN (3, 4)")
def empty_batches(spark, sf):
    given = payloads(spark, sf)
    return documents.check_batch(given.select("batch_id"), documents.unwrap_payload(given)).select("batch_id", "severity")


@query(
    "empty_documents",
    rel.with_sql("q", "SELECT q.doc_id FROM q WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = q.doc_id)"),
)
def empty_documents(spark, sf):
    from rubrica.operators import rules_object

    return rules_object.empty_items(rel.q(spark, sf).select("doc_id"), rel.inter(spark, sf), ["doc_id"])


@query("limit_per_batch", f"SELECT batch_id, pos, id FROM ({PAYLOAD_ROWS}) t WHERE pos < 2")
def limit_per_batch(spark, sf):
    listed = documents.unwrap_payload(payloads(spark, sf))
    return documents.limit_per_batch(listed, 2).select("batch_id", "pos", "id")


@query("document_id", f"SELECT batch_id, pos, id FROM ({PAYLOAD_ROWS}) t")
def document_id(spark, sf):
    return documents.unwrap_payload(payloads(spark, sf)).select("batch_id", "pos", "id")


@query(
    "repaired_only",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'",
)
def repaired_only(spark, sf):
    results = rel.objects(spark, sf).join(rel.q(spark, sf), "doc_id").withColumn(
        "new_doc", F.when(F.col("status") == "F", F.col("doc"))
    )
    kept = sinks.repaired_only(results)
    return kept.select(F.regexp_replace(v.first_text(F.col("new_doc"), "id"), "^q", "").cast("bigint").alias("id"))


@query(
    "flatten_object",
    rel.object_sql(
        "SELECT k AS doc_id, CAST(i AS INT) AS item_pos, CAST(j AS INT) AS inter_pos, iid, itype, CAST(m AS INT) AS opt_pos, "
        "CASE WHEN k % 29 = 3 THEN 'A' ELSE substr('ABCD', m + 1, 1) END AS opt_id, 'opt ' || (m % (2 + k % 3)) AS opt_text "
        "FROM ia, (VALUES (0), (1), (2), (3)) w(m) WHERE m < n_opt",
        upto="ia",
    ),
)
def flatten_object(spark, sf):
    return flatten.flatten_object(rel.objects(spark, sf))["options"].withColumnsRenamed({"id": "opt_id", "text": "opt_text"})


@query(
    "flatten_specs",
    rel.object_sql(
        "SELECT k AS doc_id, CAST(i AS INT) AS item_pos, ref AS ref_iid, stype, "
        "CAST(row_number() OVER (PARTITION BY k, i ORDER BY j) - 1 AS INT) AS spec_pos FROM sp",
        upto="sp",
    ),
)
def flatten_specs(spark, sf):
    return flatten.specs(rel.objects(spark, sf)).select("doc_id", "item_pos", "ref_iid", "stype", "spec_pos")


@query(
    "flatten_plan",
    rel.plan_sql(
        "SELECT k AS record_id, CAST(q AS INT) AS question_pos, CAST(m AS INT) AS item_pos, CAST(x AS INT) AS inter_pos, itype FROM px",
        upto="px",
    ),
)
def flatten_plan(spark, sf):
    return flatten.flatten_plan(rel.plan_records(spark, sf)).drop("inter")


@query(
    "path_table",
    "SELECT event_id AS doc_id, '' AS pointer, 0 AS depth, 'object' AS kind FROM events "
    "UNION ALL SELECT event_id, '/k', 1, 'integer' FROM events",
)
def path_table(spark, sf):
    docs = rel.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.try_parse_json("props").alias("doc"))
    return flatten.path_table(docs).select("doc_id", "pointer", "depth", "kind")


@query(
    "path_table_nested",
    rel.plan_sql(
        "SELECT kind, count(*) AS n FROM (SELECT 'question' AS kind FROM pq UNION ALL SELECT 'item' FROM pi "
        "UNION ALL SELECT 'interaction' FROM px) t GROUP BY kind",
        upto="px",
    ),
)
def path_table_nested(spark, sf):
    docs = rel.plan_records(spark, sf).select(F.col("record_id").alias("doc_id"), F.col("record").alias("doc"))
    found = flatten.path_table(docs)
    level = (
        F.when(F.col("pointer").rlike("/interactions/[0-9]+$"), "interaction")
        .when(F.col("pointer").rlike("/questionItems/[0-9]+$"), "item")
        .when(F.col("pointer").rlike("/plan/[0-9]+$"), "question")
    )
    return found.select(level.alias("kind")).filter(F.col("kind").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "find_values",
    "SELECT event_id AS doc_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS value FROM events",
)
def find_values(spark, sf):
    docs = rel.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.try_parse_json("props").alias("doc"))
    return flatten.find_values(docs, "k").select("doc_id", F.try_variant_get("value", "$", "bigint").alias("value"))


@query(
    "content_text",
    "SELECT doc_id, trim(regexp_replace(text, '\\n+', ' ', 'g')) AS content FROM ("
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' ') AS text FROM documents) t",
)
def content_text(spark, sf):
    """Text of blocks nested two levels deep, built from the lines of each document."""
    lines = F.split("text", "\n", -1)
    blocks = F.transform(lines, lambda s: F.struct(F.array(F.struct(s.alias("text"))).alias("content")))
    docs = rel.table(spark, sf, "documents").select("doc_id", F.to_variant_object(blocks).alias("doc"))
    return docs.select("doc_id", v.content_text(F.col("doc")).alias("content"))


@query(
    "deep_text",
    "SELECT conv_id AS doc_id, turn, text || chr(10) || 'note ' || role AS content FROM ("
    "SELECT conv_id, turn, role, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS text FROM conversations) t",
)
def deep_text(spark, sf):
    """Distinct texts of a solution and of its nested content, each turn as one solution object."""
    doc = F.struct(
        F.array(F.struct(F.col("text").alias("text"))).alias("stem"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("note "), F.col("role")).alias("text"))).alias("content"))).alias("hints"),
    )
    docs = rel.table(spark, sf, "conversations").select("conv_id", "turn", F.to_variant_object(doc).alias("doc"))
    texts = F.concat(*[v.deep_texts(v.get(F.col("doc"), k)) for k in ("stem", "hints")])
    return docs.select(
        F.col("conv_id").alias("doc_id"), "turn", F.array_join(F.array_distinct(texts), "\n").alias("content")
    )


@query(
    "text_nodes",
    rel.with_sql(
        "nodes",
        "SELECT doc_id, CASE WHEN pos = 0 THEN '/instruction/0/text' ELSE '/solutions/0/solutionContent/' || (pos - 1) || '/text' END AS pointer, "
        "role, text FROM nodes",
    ),
)
def text_nodes(spark, sf):
    """Documents with their first line as instruction and the others as solution blocks."""
    lines = F.split("text", "\n", -1)
    block = lambda s: F.struct(F.lit("text").alias("type"), s.alias("text"))
    doc = F.struct(
        F.transform(F.slice(lines, 1, 1), block).alias("instruction"),
        F.array(F.struct(F.transform(F.slice(lines, F.lit(2), F.size(lines)), block).alias("solutionContent"))).alias("solutions"),
    )
    docs = rel.table(spark, sf, "documents").select("doc_id", F.to_variant_object(doc).alias("doc"))
    return flatten.text_nodes(docs).select("doc_id", "pointer", "role", "text")


LOCATIONS = {
    0: ("concat('generatedQuestion.questionItems[', l_linenumber, '].stem[', l_suppkey % 4, ']')", "'/questionItems/' || l_linenumber || '/stem/' || (l_suppkey % 4)"),
    1: ("concat('$.solutions[', l_linenumber, '].text')", "'/solutions/' || l_linenumber || '/text'"),
    2: ("concat('/$/questionItems/', l_linenumber)", "'/questionItems/' || l_linenumber"),
    3: ("concat(' $/hints/', l_linenumber, ' ')", "'/hints/' || l_linenumber"),
    4: ("'generatedQuestion'", "''"),
    5: ("concat('items[x', l_linenumber, ']')", "'items[x' || l_linenumber || ']'"),
    6: ("'generatedQuestions'", "'generatedQuestions'"),
}


@query(
    "to_pointer",
    "SELECT l_orderkey AS doc_id, l_linenumber AS line, l_suppkey AS sk, CASE l_partkey % 7 "
    + " ".join(f"WHEN {n} THEN {s[1]}" for n, s in LOCATIONS.items())
    + " END AS pointer FROM lineitem",
)
def to_pointer(spark, sf):
    cases = " ".join(f"WHEN {n} THEN {s[0]}" for n, s in LOCATIONS.items())
    return rel.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("sk"),
        pointers.to_pointer(F.expr(f"CASE l_partkey % 7 {cases} END")).alias("pointer"),
    )


@query(
    "pointer_index",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN regexp_extract(location, '[0-9]+', 0) END AS item_index, "
        "CASE WHEN pos % 2 = 1 THEN regexp_extract(location, '[0-9]+', 0) END AS solution_index FROM issues",
    ),
)
def pointer_index(spark, sf):
    place = F.when(F.col("pos") % 2 == 0, F.concat("location", F.lit("/stem"))).otherwise(
        F.replace("location", F.lit("questionItems"), F.lit("solutions"))
    )
    return rel.issues(spark, sf).select(
        "doc_id",
        "pos",
        pointers.pointer_index(place, "questionItems").alias("item_index"),
        pointers.pointer_index(place, "solutions").alias("solution_index"),
    )


_PRE = "location || '/stem', location || '/interactions', location || '/answerSpecs'"


@query(
    "context_paths",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, array_to_string(CASE "
        f"WHEN category IN ('solution_anchor_consistency', 'answer_internal_consistency', 'choice_quality') THEN [location, '/instruction', {_PRE}, '/solutions'] "
        "WHEN category = 'hint_quality' THEN [location, location || '/stem', location || '/hints', location || '/interactions', location || '/answerSpecs', '/solutions'] "
        f"WHEN category = 'pedagogical_quality' THEN [location, '/instruction', {_PRE}] "
        "WHEN category IN ('interaction_schema', 'render_schema') THEN [location, location || '/interactions', location || '/answerSpecs'] "
        f"WHEN category = 'solution_quality' THEN [location, '/instruction', {_PRE}] "
        "ELSE [location] END, ' ') AS paths FROM issues",
    ),
)
def context_paths(spark, sf):
    found = pointers.context_paths(F.col("category"), F.col("location"))
    return rel.issues(spark, sf).select("doc_id", "pos", F.array_join(found, " ").alias("paths"))


@query(
    "deepest_paths",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN location || '/stem /solutions/' || (pos % 4) "
        "WHEN pos % 3 = 1 THEN location || ' /solutions/' || (pos % 4) ELSE '/solutions/' || (pos % 4) || ' ' || location || '/stem' END AS paths FROM issues",
    ),
)
def deepest_paths(spark, sf):
    solution = F.concat(F.lit("$.solutions["), (F.col("pos") % 4).cast("string"), F.lit("]"))
    stem = F.concat("location", F.lit("/stem"))
    given = (
        F.when(F.col("pos") % 3 == 0, F.array(F.col("location"), stem, solution))
        .when(F.col("pos") % 3 == 1, F.array(F.col("location"), F.col("location"), solution))
        .otherwise(F.array(F.lit("/solutions"), solution, F.col("location"), stem))
    )
    return rel.issues(spark, sf).select("doc_id", "pos", F.array_join(pointers.deepest_paths(given), " ").alias("paths"))


@query(
    "safe_patch_path",
    "SELECT o_orderkey AS doc_id, o_orderkey % 6 IN (1, 3, 5) AS safe FROM orders",
)
def safe_patch_path(spark, sf):
    paths = F.array(*[F.lit(p) for p in ("/difficulty", "/questionItems/0/stem", "$.answer.text", "/answerSpecs", "stem text[", "$.bloomed")])
    return rel.q(spark, sf).select("doc_id", pointers.safe_patch_path(F.get(paths, (F.col("doc_id") % 6).cast("int"))).alias("safe"))


@query(
    "valid_fix_path",
    rel.object_sql(
        "SELECT d.k AS doc_id, EXISTS (SELECT 1 FROM sp WHERE sp.k = d.k AND sp.i = d.k % 3) AND d.k % 4 <> 3 AS valid FROM d",
        upto="sp",
    ),
)
def valid_fix_path(spark, sf):
    """The shape of a fix path, and whether it leads to a value of the document."""
    item = (F.col("doc_id") % 3).cast("string")
    leaf = F.when(F.col("doc_id") % 4 == 3, "coordinates").when(F.col("doc_id") % 4 == 2, "correctOptionIds").otherwise("correctOptionId")
    path = F.concat(F.lit("/questionItems/"), item, F.lit("/answerSpecs/0/expected/"), leaf)
    return rel.objects(spark, sf).select(
        "doc_id",
        (pointers.fix_path_shape(path) & v.at_pointer(F.col("doc"), path).isNotNull()).alias("valid"),
    )


@query(
    "patch_scope",
    rel.with_sql(
        "issues",
        "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN pos % 2 = 0 WHEN pos % 3 = 1 THEN pos % 2 = 1 ELSE true END AS allowed FROM issues",
    ),
)
def patch_scope(spark, sf):
    intent = F.when(F.col("pos") % 3 == 0, "align_hint_to_solution").when(F.col("pos") % 3 == 1, "clean_solution_reasoning").otherwise("fix_schema")
    place = F.when(F.col("pos") % 2 == 0, F.concat("location", F.lit("/hints/0"))).otherwise(F.lit("/solutions/0/solutionContent"))
    return rel.issues(spark, sf).select("doc_id", "pos", pointers.patch_scope(intent, place).alias("allowed"))


@query(
    "parse_reply",
    "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) END AS k FROM events",
)
def parse_reply(spark, sf):
    """Replies that are bare JSON, fenced, surrounded by words, or broken."""
    content = (
        F.when(F.col("event_id") % 4 == 0, F.col("props"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("The answer is "), "props", F.lit(" as asked")))
        .otherwise(F.concat(F.lit("{"), "props"))
    )
    reply = v.parse_reply(content)
    return rel.table(spark, sf, "events").select("event_id", F.try_variant_get(reply, "$.k", "bigint").alias("k"))


@query(
    "parse_reply_plain",
    "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events",
)
def parse_reply_plain(spark, sf):
    return rel.table(spark, sf, "events").select(
        "event_id", F.try_variant_get(v.parse_reply(F.col("props")), "$.k", "bigint").alias("k")
    )


@query("canonical_equal", "SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 1 AS same FROM orders")
def canonical_equal(spark, sf):
    k = F.col("doc_id").cast("string")
    left = F.concat(F.lit('{"a": '), k, F.lit(', "b": {"x": 1, "y": 2}}'))
    right = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"b": {"y": 2, "x": 2}, "a": '), k, F.lit("}"))).otherwise(
        F.concat(F.lit('{"b": {"y": 2, "x": 1}, "a": '), k, F.lit("}"))
    )
    return rel.q(spark, sf).select("doc_id", v.canonical_equal(F.try_parse_json(left), F.try_parse_json(right)).alias("same"))


@query(
    "required_fields",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE 'b' END AS missing FROM events",
)
def required_fields(spark, sf):
    from rubrica.operators import contracts

    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit("{"), F.lit('{"a": 1, ')))
    missing = contracts.missing_fields(F.try_parse_json(body), ["k", "b", "a"])
    return rel.table(spark, sf, "events").select("event_id", F.array_join(missing, ",").alias("missing"))


@query("collapse_ws", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS collapsed FROM documents")
def collapse_ws(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", t.collapse_ws(F.col("text")).alias("collapsed"))


@query(
    "snippet",
    "SELECT doc_id, trim(regexp_replace(concat_ws(' ', nullif(trim(text, chr(9) || chr(10) || chr(13) || ' '), ''), source), '\\s+', ' ', 'g')) AS snippet FROM documents",
)
def snippet(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", t.snippet(F.col("text"), F.col("source")).alias("snippet"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(b) > 500 THEN left(b, 497) || '...' ELSE b END AS body FROM "
    "(SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS b FROM documents) t",
)
def truncate_text(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", t.truncate_text(F.col("text"), 500).alias("body"))


@query(
    "cell_text",
    "SELECT doc_id, replace(replace(trim(text, chr(9) || chr(10) || chr(13) || ' '), '|', chr(92) || '|'), chr(10), '<br>') AS cell FROM documents",
)
def cell_text(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", t.cell_text(F.col("text")).alias("cell"))


@query(
    "clamp",
    "SELECT event_id, CAST(least(greatest(coalesce(n, 3), 1), 3) AS INT) AS plan_rounds, "
    "CAST(least(greatest(coalesce(nullif(n, 0), 1), 1), 3) AS INT) AS object_rounds FROM "
    "(SELECT event_id, CASE WHEN event_id % 7 < 6 THEN event_id % 7 - 1 END AS n FROM events) t",
)
def clamp(spark, sf):
    n = F.when(F.col("event_id") % 7 < 6, (F.col("event_id") % 7 - 1).cast("string")).otherwise("many")
    return rel.table(spark, sf, "events").select(
        "event_id", t.clamp(n, 3).alias("plan_rounds"), t.clamp(n, 1, zero_is_default=True).alias("object_rounds")
    )


@query(
    "case_text",
    "SELECT conv_id, turn, concat_ws(chr(10), nullif(trim(role), ''), nullif(trim(text, chr(9) || chr(10) || chr(13) || ' '), '')) AS case_text FROM conversations",
)
def case_text(spark, sf):
    doc = F.to_variant_object(F.struct(F.col("role").alias("instruction"), F.array(F.struct("text")).alias("stem")))
    docs = rel.table(spark, sf, "conversations").select("conv_id", "turn", doc.alias("doc"))
    parts = [F.nullif(v.content_text(v.get(F.col("doc"), k)), F.lit("")) for k in ("instruction", "stem")]
    return docs.select("conv_id", "turn", F.concat_ws("\n", *parts).alias("case_text"))


@query(
    "payload_elements",
    "WITH d AS (SELECT doc_id, text, coalesce(source, 'none') AS batch_id, doc_id % 7 = 0 AS two, "
    "CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS k FROM documents), "
    "p AS (SELECT *, CAST(sum(k) OVER (PARTITION BY batch_id ORDER BY doc_id) AS INT) AS upto FROM d) "
    "SELECT batch_id, upto AS pos, 'd' || doc_id AS id, true AS is_object, length(text) AS n_text FROM p "
    "UNION ALL SELECT batch_id, upto - 1, 'item[' || (upto - 1) || ']', false, NULL FROM p WHERE two "
    "UNION ALL SELECT DISTINCT batch_id, 0, 'item[0]', false, NULL FROM p",
)
def payload_elements(spark, sf):
    """One payload per source, a bare list or a wrapper with a member before its list; all its documents as elements."""
    docs = rel.table(spark, sf, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("batch_id"))
    bare = F.length("batch_id") % 2 == 0
    refs = F.array(F.struct("doc_id")).alias("refs")
    element = F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", refs))
    number = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(", "))).otherwise("")
    # The chunks of a document follow each other below those of the next one.
    step = 1 << 32
    written = docs.select("batch_id", ((F.col("doc_id") + 1) * step).alias("at"), F.concat(F.lit(", "), number, element).alias("body"))
    sources = docs.select("batch_id").distinct()
    head = F.when(bare, "[0").otherwise('{"meta": [{"generatedQuestions": []}], "generatedQuestions": [0')
    heads = sources.select("batch_id", F.lit(0).cast("bigint").alias("at"), head.alias("body"))
    ends = sources.select("batch_id", F.lit(1 << 62).alias("at"), F.when(bare, "]").otherwise("]}").alias("body"))
    split = written.unionByName(heads).unionByName(ends).select("batch_id", "at", F.split("body", r"\}", -1).alias("parts"))
    cut = split.select("batch_id", "at", F.size("parts").alias("k"), F.posexplode("parts").alias("i", "value"))
    pieces = cut.select("batch_id", (F.col("at") + F.col("i")).alias("n"), "value", (F.col("i") < F.col("k") - 1).alias("closed"))
    found = chunks.split_elements(pieces.filter((F.col("value") != "") | F.col("closed")), 1000 * step)
    n_text = F.length(F.try_variant_get("doc", "$.text", "string")).cast("bigint")
    return found.select("batch_id", "pos", "id", "is_object", n_text.alias("n_text"))


@query(
    "read_replies",
    "SELECT 'e' || event_id AS doc_id, CASE event_id % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'judge' ELSE 'resolver' END AS stage, "
    "CAST(event_id % 2 AS INT) AS run_no, props AS content, value AS latency, CAST(NULL AS INT) AS round FROM events",
)
def read_replies(spark, sf):
    """Replies written as results by every task and read with the schema of replies; what was not written is NULL."""
    stage = F.when(F.col("event_id") % 3 == 0, "split").when(F.col("event_id") % 3 == 1, "judge").otherwise("resolver")
    given = rel.table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("doc_id"),
        stage.alias("stage"),
        (F.col("event_id") % 2).cast("int").alias("run_no"),
        F.col("props").alias("content"),
        F.col("value").alias("latency"),
    )
    folder = f"{checkpoint_dir(spark)}/replies-{uuid4().hex}"
    sinks.write_results(given, folder)
    return replies.read_replies(spark, folder).select("doc_id", "stage", "run_no", "content", "latency", "round")


@query(
    "choices",
    "WITH e AS (SELECT event_id, event_type, CAST(event_id % 4 AS INT) AS n FROM events) "
    "SELECT event_id, CASE event_id % 5 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE n END AS n_choices, "
    "CASE WHEN event_id % 5 = 3 THEN event_type WHEN event_id % 5 < 3 AND n > 0 THEN event_type || '0' END AS first_choice FROM e",
)
def choices(spark, sf):
    """Choices under the keys of the configuration, which go before those of the interaction; a key that is no list is passed over."""
    events = rel.table(spark, sf, "events")
    listed = F.expr("transform(slice(array(0, 1, 2), 1, cast(event_id % 4 as int)), m -> concat(event_type, m))")
    whole = F.to_json(listed)
    one = F.to_json(F.array("event_type"))
    body = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"config": {"choices": '), whole, F.lit('}, "options": ["x"]}')))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"config": {"options": 5, "answers": '), whole, F.lit('}, "items": ["x"]}')))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"config": "none", "statements": '), whole, F.lit("}")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"answers": ["x", "y"], "options": null, "items": '), one, F.lit("}")))
        .otherwise(F.lit('{"config": {"options": {}}, "choices": "x"}'))
    )
    found = v.choices(F.try_parse_json(body))
    return events.select(
        "event_id", F.size(found).alias("n_choices"), F.try_variant_get(F.get(found, F.lit(0)), "$", "string").alias("first_choice")
    )
