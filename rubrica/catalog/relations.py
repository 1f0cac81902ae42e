"""Relations of the document model derived from the given tables, for Spark and as SQL.

The given tables hold no assessment documents, so orders stand for documents, line items for interactions and
specs, events for replies and issues, text lines for text nodes and conversations for solution states. Nested
documents are built row by row from orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica import dims
from rubrica.functions.expressions import spread
from rubrica.operators import ordering

TYPE_CASE = (
    "CASE {c} WHEN 0 THEN 'single_choice' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'true_false' "
    "WHEN 3 THEN 'short_answer' WHEN 4 THEN 'coordinate_input' WHEN 5 THEN 'essay' WHEN 6 THEN 'fill_blank' "
    "ELSE 'unknown_type' END"
)
CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in dims.CATEGORIES) + "]"
INTENT_CASE = (
    "CASE category "
    + " ".join(f"WHEN '{c}' THEN '{i}'" for c, i in dims.DEFAULT_INTENT.items())
    + f" ELSE '{dims.MANUAL}' END"
)
SEVERITY_RANK = "CASE severity WHEN 'bad' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END"
CATEGORY_RANK = (
    "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in dims.CATEGORY_ORDER.items()) + " ELSE 99 END"
)
GATE = (
    "CASE WHEN category = 'solution_quality' AND repair_intent = 'needs_manual_review' THEN 1 "
    "WHEN category = 'solution_quality' AND repair_intent = 'clean_solution_reasoning' THEN 2 "
    "WHEN category = 'runtime' THEN 3 END"
)

SQL = {
    "q": "SELECT o_orderkey AS doc_id, o_orderpriority AS prio, o_orderstatus AS status FROM orders",
    "inter": (
        "SELECT l_orderkey AS doc_id, l_returnflag AS item, l_linenumber AS iid, "
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, "
        f"l_extendedprice) AS pos, {TYPE_CASE.format(c='l_partkey % 8')} AS itype, l_partkey AS pk, l_suppkey AS sk "
        "FROM lineitem"
    ),
    "opt": (
        "SELECT i.doc_id, i.item, i.iid, i.pos, i.itype, k.k, substr('ABCD', k.k + 1, 1) AS opt_id, p.p_name AS opt_text "
        "FROM inter i, (VALUES (0), (1), (2), (3)) k(k), part p "
        "WHERE p.p_partkey = (i.pk + k.k * 7) % (SELECT count(*) FROM part) "
        "AND i.itype IN ('single_choice', 'multiple_choice') AND k.k <= i.sk % 5"
    ),
    "spec": (
        "SELECT l_orderkey AS doc_id, l_returnflag AS item, "
        "l_linenumber + CASE WHEN l_tax >= 0.08 THEN 10 ELSE 0 END AS ref_iid, "
        f"{TYPE_CASE.format(c='(l_partkey + CASE WHEN l_discount >= 0.10 THEN 1 ELSE 0 END) % 8')} AS stype, "
        "substr('ABCDE', CAST(l_suppkey % 5 AS INT) + 1, 1) AS correct_opt, l_partkey AS pk, l_suppkey AS sk, "
        "l_extendedprice AS ep FROM lineitem WHERE CAST(l_quantity AS INT) % 10 <> 0"
    ),
    "runs": (
        "SELECT user_id AS doc_id, CAST(floor((rn - 1) / 2) AS BIGINT) AS pair, CAST((rn - 1) % 2 + 1 AS INT) AS run_no, "
        "event_id, CASE event_type WHEN 'purchase' THEN 'bad' WHEN 'signup' THEN 'uncertain' WHEN 'error' THEN NULL "
        "ELSE 'good' END AS verdict, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 AS to_order, value AS latency "
        "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e"
    ),
    "raw_issues": (
        "SELECT user_id % 40 AS doc_id, event_id AS pos, CASE event_type WHEN 'error' THEN 'bad' "
        "WHEN 'signup' THEN 'needs_review' ELSE 'warning' END AS severity, "
        f"{CATEGORY_LIST}[CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 + 1] AS category, "
        "'/questionItems/' || CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 5 AS VARCHAR) AS location, "
        "CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS reason, "
        "substr('review the field again', 1, CAST(event_id % 22 AS INT) + 1) AS suggestion FROM events"
    ),
    "issues": f"SELECT *, {INTENT_CASE} AS repair_intent FROM raw_issues",
    "cover": (
        "SELECT d.lang AS rec_lang, d.source AS rec_source, d.doc_id AS subpart, CASE WHEN l.quality = 1 THEN 'present' "
        "WHEN l.quality = 0 THEN 'unclear' ELSE 'absent' END AS coverage_state "
        "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
    ),
    "nodes": (
        "SELECT doc_id, CAST(pos AS INT) AS pos, '/instruction/' || CAST(pos AS VARCHAR) || '/text' AS pointer, "
        "CASE WHEN pos = 0 THEN 'instruction' ELSE 'solution' END AS role, line AS text "
        "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
        "unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) t"
    ),
    "states": (
        "SELECT conv_id AS sol, CAST(turn + CASE WHEN conv_id % 10 = 3 AND turn >= 2 THEN 1 ELSE 0 END AS INT) AS ord, "
        "role AS path, text FROM conversations"
    ),
}
NEEDS = {"opt": ["inter"], "issues": ["raw_issues"]}


def with_sql(names: str, body: str, **more: str) -> str:
    """`body` with the named relations, and further ones, in front of it."""
    order: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in order:
                order.append(part)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return "WITH " + ", ".join(ctes) + " " + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def itype_of(code: Column) -> Column:
    names = ["single_choice", "multiple_choice", "true_false", "short_answer", "coordinate_input", "essay", "fill_blank"]
    out = None
    for n, name in enumerate(names):
        out = F.when(code == n, name) if out is None else out.when(code == n, name)
    return out.otherwise("unknown_type")


def q(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status")
    )


def inter(spark, sf, with_pos: bool = False) -> DataFrame:
    """Interactions; their position in the document is worked out only where it is asked for."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_returnflag").alias("item"),
        F.col("l_linenumber").alias("iid"),
        itype_of(F.col("l_partkey") % 8).alias("itype"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("ep"),
    )
    if not with_pos:
        return lines.drop("ep")
    order = [F.col("pk"), F.col("sk"), F.col("ep")]
    return ordering.split_row_number(lines, ["doc_id"], [F.col("item"), F.col("iid")], order, "pos").drop("ep")


def choice_inter(spark, sf) -> DataFrame:
    """Choice interactions with their options, at most four each, as an array."""
    part = table(spark, sf, "part")
    n_parts = part.agg(F.count("*").alias("n")).scalar()
    choice = inter(spark, sf, with_pos=True).filter(F.col("itype").isin(dims.CHOICE_TYPES))
    wanted = choice.select(
        "doc_id", "item", "iid", "pos", "itype", F.explode(F.sequence(F.lit(0), F.least(F.col("sk") % 5, F.lit(3)).cast("int"))).alias("k"), "pk"
    ).withColumn("p_partkey", (F.col("pk") + F.col("k") * 7) % n_parts)
    named = wanted.join(part.select("p_partkey", "p_name"), "p_partkey")
    listed = named.groupBy("doc_id", "item", "iid", "pos", "itype").agg(
        F.array_sort(
            F.collect_list(
                F.struct("k", F.substring(F.lit("ABCD"), F.col("k") + 1, F.lit(1)).alias("id"), F.col("p_name").alias("text"))
            )
        ).alias("options")
    )
    keys = ["doc_id", "item", "iid", "pos", "itype"]
    return choice.select(*keys).join(listed, keys, "left").withColumn(
        "options",
        F.coalesce(
            F.transform("options", lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text"))),
            F.array().cast("array<struct<id:string,text:string>>"),
        ),
    )


def opt(spark, sf) -> DataFrame:
    return choice_inter(spark, sf).select(
        "doc_id", "item", "iid", "pos", "itype", F.posexplode("options").alias("k", "o")
    ).select("doc_id", "item", "iid", "pos", "itype", "k", F.col("o.id").alias("opt_id"), F.col("o.text").alias("opt_text"))


def spec(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter(F.col("l_quantity").cast("int") % 10 != 0)
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_returnflag").alias("item"),
        (F.col("l_linenumber") + F.when(F.col("l_tax") >= 0.08, 10).otherwise(0)).alias("ref_iid"),
        itype_of((F.col("l_partkey") + F.when(F.col("l_discount") >= 0.10, 1).otherwise(0)) % 8).alias("stype"),
        F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5).cast("int") + 1, F.lit(1)).alias("correct_opt"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("ep"),
    )


def runs(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    timed = events.withColumn("at", F.unix_micros("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.unix_micros(F.col("ts").cast("timestamp")))
    bucket = ordering.quantile_bucket(timed, "at", 64)
    numbered = ordering.split_row_number(timed, ["user_id"], [bucket], [F.col("ts"), F.col("event_id")], "rn")
    return numbered.select(
        F.col("user_id").alias("doc_id"),
        F.floor((F.col("rn") - 1) / 2).alias("pair"),
        ((F.col("rn") - 1) % 2 + 1).cast("int").alias("run_no"),
        "event_id",
        F.when(F.col("event_type") == "purchase", "bad")
        .when(F.col("event_type") == "signup", "uncertain")
        .when(F.col("event_type") == "error", None)
        .otherwise("good")
        .alias("verdict"),
        (k % 7).alias("to_order"),
        F.col("value").alias("latency"),
    )


def raw_issues(spark, sf) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    names = F.array(*[F.lit(c) for c in dims.CATEGORIES])
    return table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("doc_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", "bad")
        .when(F.col("event_type") == "signup", "needs_review")
        .otherwise("warning")
        .alias("severity"),
        F.get(names, k % 10).alias("category"),
        F.concat(F.lit("/questionItems/"), (k % 5).cast("string")).alias("location"),
        F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("reason"),
        F.substring(F.lit("review the field again"), F.lit(1), (F.col("event_id") % 22).cast("int") + 1).alias("suggestion"),
    )


def issues(spark, sf) -> DataFrame:
    from rubrica.operators.issues import default_intent

    return raw_issues(spark, sf).withColumn("repair_intent", default_intent(F.col("category")))


def cover(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return (
        table(spark, sf, "documents")
        .select("doc_id", "lang", "source")
        .join(labels, "doc_id", "left")
        .select(
            F.col("lang").alias("rec_lang"),
            F.col("source").alias("rec_source"),
            F.col("doc_id").alias("subpart"),
            F.when(F.col("quality") == 1, "present").when(F.col("quality") == 0, "unclear").otherwise("absent").alias("coverage_state"),
        )
    )


def texts(spark, sf) -> DataFrame:
    """Documents, dealt out by hash: a table may be one row group, which is one task however large it is.

    `rubrica.source.partitions` gives the number of partitions, else the session's number for shuffles counts.
    """
    parts = spark.conf.get("rubrica.source.partitions", None) or spark.conf.get("spark.sql.shuffle.partitions")
    # By key and text, since keys may repeat or be null; with a number, as for the keys of orders.
    return table(spark, sf, "documents").select("doc_id", "text").repartition(int(parts), "doc_id", "text")


def nodes(spark, sf) -> DataFrame:
    return (
        spread(texts(spark, sf), ["doc_id"], F.split("text", "\n", -1), "text", "pos")
        .select(
            "doc_id",
            "pos",
            F.concat(F.lit("/instruction/"), F.col("pos").cast("string"), F.lit("/text")).alias("pointer"),
            F.when(F.col("pos") == 0, "instruction").otherwise("solution").alias("role"),
            "text",
        )
    )


def states(spark, sf) -> DataFrame:
    gap = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") >= 2), 1).otherwise(0)
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sol"), (F.col("turn") + gap).cast("int").alias("ord"), F.col("role").alias("path"), "text"
    )


# --- nested documents --------------------------------------------------------------------------------------------

OBJECT_TYPES_SQL = (
    "['single_choice', 'multiple_choice', 'true_false', 'short_answer', 'coordinate_input', 'essay', 'fill_blank', 'mystery']"
)
IID = "if(k % 7 = 0, concat('x', j), concat('x', i, '_', j))"
ITYPE = f"get({OBJECT_TYPES_SQL.replace('[', 'array(').replace(']', ')')}, cast((k + i + j) % 8 as int))"
OBJECT_JSON = f"""
to_json(named_struct(
  'id', concat('q', k),
  'instruction', if(k % 17 = 0, null, array(named_struct(
      'id', 'b0', 'type', 'text', 'text', if(k % 19 = 1, '', concat('Task ', k, ' = ?'))))),
  'questionItems', transform(slice(array(0, 1, 2), 1, cast(k % 4 as int)), i -> named_struct(
      'id', if((k + i) % 23 = 0, '', concat('i', i)),
      'stem', array(named_struct('id', 's', 'type', 'text', 'text',
          concat('Solve ', k * (i + 1), if(k % 2 = 0, ' and explain each step of the work', '')))),
      'interactions', transform(slice(array(0, 1), 1, cast((k + i) % 3 as int)), j -> named_struct(
          'id', {IID}, 'type', {ITYPE},
          'config', named_struct(
              'options', transform(slice(array(0, 1, 2, 3), 1, cast((k + j) % 5 as int)), m -> named_struct(
                  'id', if(k % 29 = 3, 'A', substr('ABCD', m + 1, 1)),
                  'content', array(named_struct('id', 'o', 'type', 'text', 'text', concat('opt ', m % (2 + k % 3)))))),
              'dimensions', cast(k % 3 as int),
              'slots', array(named_struct('id', 'p0'), named_struct('id', 'p1'))),
          'display', named_struct('width', 1))),
      'answerSpecs', transform(filter(slice(array(0, 1), 1, cast((k + i) % 3 as int)), j -> (k + i + j) % 10 <> 0),
          j -> named_struct(
          'interactionId', if((k + i + j) % 11 = 3, 'zz', {IID}),
          'type', if((k + j) % 13 = 5, 'fill_blank', {ITYPE}),
          'expected', named_struct(
              'correctOptionId', substr('ABCDE', cast((k + 3 * i + j) % 5 as int) + 1, 1),
              'correctOptionIds', array(substr('ABCDE', cast(k % 5 as int) + 1, 1), substr('ABCDE', cast((k + j) % 5 as int) + 1, 1)),
              'correct', if(k % 6 = 0, null, k % 2 = 0),
              'correctValue', if(k % 9 = 0, null, 'v'),
              'coordinates', array(named_struct('slotId', concat('p', k % 3)))))),
      'hints', array(named_struct('name', 'h', 'content', array(named_struct('id', 'h', 'type', 'text', 'text', concat('Hint ', k))))))),
  'solutions', if(k % 5 = 0, null, array(named_struct('solverName', 's', 'solutionContent', array(
      named_struct('id', 'c', 'type', 'text', 'text', concat('Step ', k)),
      named_struct('id', 'c', 'type', 'text', 'text', concat('Result = ', k * 2))))))
))
"""


def order_keys(spark, sf) -> DataFrame:
    """The keys of orders, dealt out by hash before anything is built from them.

    Documents cost far more than the eight bytes of a key, and a table may be one row group, which is one task; only
    keys move, whatever the size.
    """
    # With a number, since partitions of keys alone are small enough to be merged again at run time.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).repartition(parts, "k")


def event_keys(spark, sf) -> DataFrame:
    """The keys of events, dealt out as those of orders are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "events").select("event_id").repartition(parts, "event_id")


def object_json(spark, sf) -> DataFrame:
    """One JSON document per order (doc_id, k, body)."""
    orders = order_keys(spark, sf)
    return orders.select(F.col("k").alias("doc_id"), "k", F.expr(OBJECT_JSON).alias("body"))


def objects(spark, sf) -> DataFrame:
    return object_json(spark, sf).select("doc_id", F.try_parse_json("body").alias("doc"))


# The same documents as flat relations, for SQL.
OBJECT_SQL = {
    "d": "SELECT o_orderkey AS k FROM orders",
    "it": "SELECT k, i FROM d, (VALUES (0), (1), (2)) u(i) WHERE i < k % 4",
    "ia": (
        "SELECT k, i, j, CASE WHEN k % 7 = 0 THEN 'x' || j ELSE 'x' || i || '_' || j END AS iid, "
        f"{OBJECT_TYPES_SQL}[(k + i + j) % 8 + 1] AS itype, (k + j) % 5 AS n_opt, "
        "row_number() OVER (PARTITION BY k, CASE WHEN k % 7 = 0 THEN 'x' || j ELSE 'x' || i || '_' || j END ORDER BY i, j) AS use_no "
        "FROM it, (VALUES (0), (1)) v(j) WHERE j < (k + i) % 3"
    ),
    "sp": (
        "SELECT k, i, j, itype, n_opt, use_no, CASE WHEN (k + i + j) % 11 = 3 THEN 'zz' ELSE iid END AS ref, "
        "CASE WHEN (k + j) % 13 = 5 THEN 'fill_blank' ELSE itype END AS stype, (k + 3 * i + j) % 5 AS one, "
        "[k % 5, (k + j) % 5] AS many, (k + i + j) % 11 <> 3 AND use_no = 1 AS known FROM ia WHERE (k + i + j) % 10 <> 0"
    ),
    "graded": "SELECT DISTINCT k, i FROM sp",
    "found": (
        "SELECT k, 'G02' AS rule, 'needs_review' AS severity FROM d WHERE k % 17 = 0 "
        "UNION ALL SELECT k, 'G07', 'bad' FROM d WHERE k % 19 = 1 AND k % 17 <> 0 "
        "UNION ALL SELECT k, 'G11', 'bad' FROM d WHERE k % 4 = 0 "
        "UNION ALL SELECT k, 'G12', 'bad' FROM d WHERE k % 4 = 0 AND k % 17 = 0 "
        "UNION ALL SELECT k, 'G14', 'bad' FROM it WHERE (k + i) % 23 = 0 "
        "UNION ALL SELECT k, 'G18', 'bad' FROM it WHERE (k + i) % 3 = 0 "
        "UNION ALL SELECT k, 'G21', 'bad' FROM ia WHERE use_no > 1 "
        "UNION ALL SELECT k, 'G23', 'bad' FROM ia WHERE itype = 'mystery' "
        "UNION ALL SELECT k, CASE WHEN n_opt = 0 THEN 'G26' WHEN n_opt = 1 THEN 'G27' ELSE 'G28' END, 'bad' FROM ia "
        "WHERE itype IN ('single_choice', 'multiple_choice') AND (n_opt < 2 OR k % 29 = 3) "
        "UNION ALL SELECT k, 'G30', 'needs_review' FROM ia WHERE itype IN ('single_choice', 'multiple_choice') AND n_opt > 2 + k % 3 "
        "UNION ALL SELECT k, 'G31', CASE WHEN itype IN ('essay', 'short_answer') THEN 'needs_review' ELSE 'bad' END FROM ia "
        "WHERE use_no = 1 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.k = ia.k AND sp.i = ia.i AND sp.ref = ia.iid) "
        "AND NOT (itype = 'essay' AND (k % 5 <> 0 OR EXISTS (SELECT 1 FROM graded g WHERE g.k = ia.k AND g.i = ia.i))) "
        "UNION ALL SELECT k, 'G33', 'bad' FROM sp WHERE NOT known "
        "UNION ALL SELECT k, 'G35', 'bad' FROM sp WHERE known AND stype <> itype "
        "UNION ALL SELECT k, 'G38', 'bad' FROM sp WHERE known AND itype = 'single_choice' AND n_opt > 0 "
        "AND CASE WHEN k % 29 = 3 THEN one <> 0 ELSE one >= n_opt END "
        "UNION ALL SELECT k, 'G40', 'bad' FROM sp WHERE known AND itype = 'multiple_choice' AND many[1] = many[2] "
        "UNION ALL SELECT k, 'G41', 'bad' FROM (SELECT *, unnest(many) AS m FROM sp) t WHERE known AND itype = 'multiple_choice' "
        "AND n_opt > 0 AND CASE WHEN k % 29 = 3 THEN m <> 0 ELSE m >= n_opt END "
        "UNION ALL SELECT k, 'G42', 'bad' FROM sp WHERE known AND itype = 'true_false' AND k % 6 = 0 "
        "UNION ALL SELECT k, 'G43', 'needs_review' FROM sp WHERE known AND itype = 'short_answer' AND k % 9 = 0 "
        "UNION ALL SELECT k, 'G44', 'bad' FROM sp WHERE known AND itype = 'coordinate_input' AND k % 3 = 0 "
        "UNION ALL SELECT k, 'G45', 'bad' FROM sp WHERE known AND itype = 'coordinate_input' AND k % 3 = 2 "
        "UNION ALL SELECT k, 'G46', 'needs_review' FROM ia WHERE itype = 'essay' AND k % 2 = 1 "
        "UNION ALL SELECT k, 'G47', 'needs_review' FROM ia WHERE itype = 'essay' AND k % 5 = 0 "
        "AND NOT EXISTS (SELECT 1 FROM graded g WHERE g.k = ia.k AND g.i = ia.i)"
    ),
}


def object_sql(body: str, upto: str = "found", **more: str) -> str:
    names = list(OBJECT_SQL)
    chosen = names[: names.index(upto) + 1]
    ctes = [f"{n} AS ({OBJECT_SQL[n]})" for n in chosen] + [f"{n} AS ({s})" for n, s in more.items()]
    return "WITH " + ", ".join(ctes) + " " + body


PLAN_TYPES_SQL = "'single_choice', 'matching', '', 'riddle', 'ordering'"
PLAN_LIST = f"""
to_json(transform(slice(array(0, 1, 2), 1, cast(1 + k % 3 as int)), q -> named_struct(
  'questionOrder', if(k % 5 = 0, 1, q + 1),
  'questionStatement', if((k + q) % 13 = 0, ' ', concat('Part ', q)),
  'questionItems', transform(slice(array(0, 1), 1, cast((k + q) % 3 as int)), m -> named_struct(
      'itemOrder', if((k + q) % 7 = 0, 1, m + 1),
      'requirement', if((k + q + m) % 11 = 0, '', 'Find the value'),
      'interactions', transform(slice(array(0, 1), 1, cast((k + q + m) % 3 as int)), x -> named_struct(
          'interactionOrder', if(k % 6 = 0, 0, x + 1),
          'interactionType', get(array({PLAN_TYPES_SQL}), cast((k + q + m + x) % 5 as int)),
          'interactionRequirement', if((k + x) % 17 = 0, '', 'Answer'))))))))
"""
RECORD_JSON = f"""
concat('{{"_id": "', if(k % 31 = 0, '', concat('r', k)), '", "name": "n", "question": "', if(k % 37 = 0, ' ', 'Question'), '"',
  CASE WHEN k % 41 = 0 THEN ''
       WHEN k % 41 = 1 THEN ', "question_plan": "text"'
       WHEN k % 41 = 2 THEN ', "question_plan": []'
       WHEN k % 41 = 3 THEN ', "question_plan": {{"type": "advanced_question_plan"}}'
       ELSE concat(', "question_plan": {{"type": "advanced_question_plan", "plan": ', {PLAN_LIST}, '}}') END, '}}')
"""


def plan_records(spark, sf) -> DataFrame:
    """One source record with a plan per order (record_id, record)."""
    orders = order_keys(spark, sf)
    return orders.select(F.col("k").alias("record_id"), F.try_parse_json(F.expr(RECORD_JSON)).alias("record"))


_TYPE = f"[{PLAN_TYPES_SQL}][(k + q + m + x) % 5 + 1]"
PLAN_SQL = {
    "d": "SELECT o_orderkey AS k FROM orders",
    "pq": "SELECT k, q FROM d, (VALUES (0), (1), (2)) u(q) WHERE q < 1 + k % 3 AND k % 41 > 3",
    "pi": "SELECT k, q, m FROM pq, (VALUES (0), (1)) u(m) WHERE m < (k + q) % 3",
    "px": f"SELECT k, q, m, x, {_TYPE} AS itype FROM (SELECT * FROM pi, (VALUES (0), (1)) u(x)) t WHERE x < (k + q + m) % 3",
    # ord: the place of each finding in the reading order of the tree.
    "found": (
        "SELECT k, 'L01' AS rule, [0] AS ord, '_id' AS field FROM d WHERE k % 31 = 0 "
        "UNION ALL SELECT k, 'L02', [1], 'question' FROM d WHERE k % 37 = 0 "
        "UNION ALL SELECT k, 'L03', [2], 'question_plan' FROM d WHERE k % 41 = 0 "
        "UNION ALL SELECT k, 'L04', [2], 'question_plan' FROM d WHERE k % 41 = 1 "
        "UNION ALL SELECT k, 'L05', [3], 'question_plan.plan' FROM d WHERE k % 41 IN (1, 3) "
        "UNION ALL SELECT k, 'L06', [3], 'question_plan.plan' FROM d WHERE k % 41 = 2 "
        "UNION ALL SELECT k, 'L09', [5, q, -2], 'plan[' || q || '].questionStatement' FROM pq WHERE (k + q) % 13 = 0 "
        "UNION ALL SELECT k, 'L11', [5, q, -1], 'plan[' || q || '].questionItems' FROM pq WHERE (k + q) % 3 = 0 "
        "UNION ALL SELECT k, 'L13', [5, q, m, -2], 'plan[' || q || '].questionItems[' || m || '].requirement' FROM pi WHERE (k + q + m) % 11 = 0 "
        "UNION ALL SELECT k, 'L15', [5, q, m, -1], 'plan[' || q || '].questionItems[' || m || '].interactions' FROM pi WHERE (k + q + m) % 3 = 0 "
        "UNION ALL SELECT k, 'L08', [5, q, m, x, 1], 'plan[' || q || '].questionItems[' || m || '].interactions[' || x || '].interactionOrder' FROM px WHERE k % 6 = 0 "
        "UNION ALL SELECT k, CASE WHEN itype = '' THEN 'L17' ELSE 'L18' END, [5, q, m, x, 2], "
        "'plan[' || q || '].questionItems[' || m || '].interactions[' || x || '].interactionType' FROM px WHERE itype IN ('', 'riddle') "
        "UNION ALL SELECT k, 'L19', [5, q, m, x, 3], 'plan[' || q || '].questionItems[' || m || '].interactions[' || x || '].interactionRequirement' FROM px WHERE (k + x) % 17 = 0 "
        "UNION ALL SELECT k, 'L20', [5, q, m, 1073741824], 'plan[' || q || '].questionItems[' || m || '].interactions.interactionOrder' FROM pi WHERE k % 6 = 0 AND (k + q + m) % 3 = 2 "
        "UNION ALL SELECT k, 'L20', [5, q, 1073741824], 'plan[' || q || '].questionItems.itemOrder' FROM pq WHERE (k + q) % 7 = 0 AND (k + q) % 3 = 2 "
        "UNION ALL SELECT k, 'L20', [5, 1073741824], 'question_plan.plan.questionOrder' FROM d WHERE k % 41 > 3 AND k % 5 = 0 AND k % 3 > 0"
    ),
}


def plan_sql(body: str, upto: str = "found", **more: str) -> str:
    names = list(PLAN_SQL)
    chosen = names[: names.index(upto) + 1]
    ctes = [f"{n} AS ({PLAN_SQL[n]})" for n in chosen] + [f"{n} AS ({s})" for n, s in more.items()]
    return "WITH " + ", ".join(ctes) + " " + body
