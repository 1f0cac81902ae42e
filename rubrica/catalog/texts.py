"""Text hygiene over the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog import relations as rel
from rubrica.catalog.registry import query
from rubrica.functions import text as t
from rubrica.operators import hygiene

# Formulas as one token per span, all with ordinal 0; LENGTH adds the further digits of ordinals from 10 on.
PROTECTED = r"regexp_replace(text, '(\$\$.*?\$\$|\$.*?\$|```.*?```)', '__MATH_SEGMENT_0__', 'gs')"
SPANS = r"len(regexp_extract_all(text, '(?s)(\$\$.*?\$\$|\$.*?\$|```.*?```)'))"
LENGTH = "(length(protected) + " + " + ".join(f"greatest(0, {SPANS} - {10**k})" for k in range(1, 6)) + ")"
NODES = rel.SQL["nodes"]
TRIM = "trim({c}, chr(9) || chr(13) || chr(10) || ' ')"


def hits(spark, sf, rule):
    return hygiene.text_hygiene(rel.nodes(spark, sf)).filter(F.col("rule") == rule)


def hygiene_sql(condition, cols="doc_id, pos"):
    return rel.with_sql("nodes", f"SELECT {cols} FROM p WHERE {condition}", p=f"SELECT *, {PROTECTED} AS protected FROM nodes")


CONDITIONS = {
    "H1": f"role IN ('instruction', 'stem') AND length({TRIM.format(c='protected')}) < 5",
    "H2": r"regexp_matches(protected, '[ \t\x0b\x0c\x{a0}\x{2000}-\x{200a}\x{3000}]{2,}')",
    "H3": r"regexp_matches(protected, '\s+[,.;:!?]')",
    "H4": r"regexp_matches(protected, '[,.;:!?][^\s\d,.;:!?]')",
    "H5": r"regexp_matches(protected, ',,|\.\.|;;|!!|\?\?')",
    "H7": "contains(protected, '�') OR contains(protected, 'Ã') OR contains(protected, 'Â') OR contains(protected, 'Æ') OR contains(protected, 'á»') OR contains(protected, 'Ä')",
    "H8": f"{LENGTH} > 650 AND length(protected) - length(replace(replace(replace(protected, '.', ''), '?', ''), '!', '')) <= 1",
    "H9": "abs((length(protected) - length(replace(protected, '(', ''))) - (length(protected) - length(replace(protected, ')', '')))) >= 2",
}


@query("hygiene_short", hygiene_sql(CONDITIONS["H1"]))
def hygiene_short(spark, sf):
    return hits(spark, sf, "H1").select("doc_id", "pos")


@query(
    "hygiene_spacing",
    rel.with_sql(
        "nodes",
        f"SELECT doc_id, pos, 'H2' AS rule FROM p WHERE {CONDITIONS['H2']} UNION ALL SELECT doc_id, pos, 'H3' FROM p WHERE {CONDITIONS['H3']}",
        p=f"SELECT *, {PROTECTED} AS protected FROM nodes",
    ),
)
def hygiene_spacing(spark, sf):
    found = hygiene.text_hygiene(rel.nodes(spark, sf)).filter(F.col("rule").isin("H2", "H3"))
    return found.select("doc_id", "pos", "rule")


@query("hygiene_punct", hygiene_sql(CONDITIONS["H4"]))
def hygiene_punct(spark, sf):
    return hits(spark, sf, "H4").select("doc_id", "pos")


@query("hygiene_repeat_punct", hygiene_sql(CONDITIONS["H5"]))
def hygiene_repeat_punct(spark, sf):
    return hits(spark, sf, "H5").select("doc_id", "pos")


WORD = r"[\p{L}\p{M}\p{N}_]"


def tokens(column):
    """Words and what is between them, and whether a word of letters alone repeats the one before it."""
    return (
        f"SELECT *, regexp_full_match(t, '[{t.dims.WORD_CHARS}]+') AND regexp_full_match(gap, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+') AND lower(t) = lower(prev) AS again FROM ("
        "SELECT *, lag(t) OVER here AS gap, lag(t, 2) OVER here AS prev FROM (SELECT doc_id, pos, unnest(l) AS t, unnest(range(len(l))) AS i FROM "
        f"(SELECT doc_id, pos, regexp_extract_all({column}, '{WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS l FROM p) x) y WINDOW here AS (PARTITION BY doc_id, pos ORDER BY i)) z"
    )


REPEATS = {
    "p": f"SELECT *, {PROTECTED} AS protected FROM nodes",
    "safe": tokens("protected"),
    "hit": "SELECT doc_id, pos, arg_min(prev || gap || t, i) AS found FROM safe WHERE again GROUP BY doc_id, pos",
}


@query(
    "hygiene_repeat_word",
    # Of a row of equal words, pairs are found from the left, so every second one goes with the gap before it.
    rel.with_sql(
        "nodes",
        "SELECT hit.doc_id, hit.pos, 'A word repeats: ' || found || '.' AS reason, corrected_text FROM hit JOIN (SELECT doc_id, pos, string_agg(t, '' ORDER BY i) AS corrected_text FROM "
        "(SELECT *, coalesce(lead(gone) OVER (PARTITION BY doc_id, pos ORDER BY i), false) AS before_gone FROM odd) o WHERE NOT gone AND NOT before_gone GROUP BY doc_id, pos) c "
        "ON c.doc_id = hit.doc_id AND c.pos = hit.pos",
        **REPEATS,
        raw=tokens("text"),
        rows="SELECT *, sum(CASE WHEN coalesce(again, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pos, word ORDER BY i) AS chain FROM "
        f"(SELECT *, regexp_matches(t, '{WORD}') AS word FROM raw) w",
        odd="SELECT *, coalesce(again, false) AND sum(CASE WHEN coalesce(again, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos, word, chain ORDER BY i) % 2 = 1 AS gone FROM rows",
    ),
)
def hygiene_repeat_word(spark, sf):
    return hits(spark, sf, "H6").select("doc_id", "pos", "reason", "corrected_text")


@query("hygiene_encoding", hygiene_sql(CONDITIONS["H7"]))
def hygiene_encoding(spark, sf):
    return hits(spark, sf, "H7").select("doc_id", "pos")


@query("hygiene_long", hygiene_sql(CONDITIONS["H8"]))
def hygiene_long(spark, sf):
    return hits(spark, sf, "H8").select("doc_id", "pos")


@query("hygiene_parens", hygiene_sql(CONDITIONS["H9"]))
def hygiene_parens(spark, sf):
    return hits(spark, sf, "H9").select("doc_id", "pos")


ACCENTLESS = (
    "SELECT doc_id, pos FROM (SELECT doc_id, pos, protected, list_filter(regexp_extract_all(lowered, '[A-Za-zÀ-ỹ_]{3,}'), lambda w: regexp_full_match(w, '[a-z]+')) AS plain, "
    "lowered FROM (SELECT *, regexp_replace(lower(protected), '"
    + "|".join(sorted(t.dims.WHITELIST, key=len, reverse=True))
    + f"', ' ', 'g') AS lowered FROM p) a) b WHERE length(protected) >= 20 AND len(plain) >= 6 AND NOT regexp_matches(lowered, '[{t.dims.ACCENTED}]')"
)


@query("accentless_text", rel.with_sql("nodes", ACCENTLESS, p=f"SELECT *, {PROTECTED} AS protected FROM nodes"))
def accentless_text(spark, sf):
    return rel.nodes(spark, sf).filter(t.accentless_text(t.protect_math(F.col("text")))).select("doc_id", "pos")


GRADES = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{r[0]}'" for k, r in hygiene.RULES.items()) + " END"


@query(
    "hygiene_summary",
    rel.with_sql(
        "nodes",
        f"SELECT rule, {GRADES} AS severity, count(*) AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS rule FROM p WHERE {c}" for k, c in CONDITIONS.items())
        + f" UNION ALL SELECT 'H6' FROM hit UNION ALL SELECT 'H10' FROM ({ACCENTLESS}) a) t GROUP BY rule",
        **REPEATS,
    ),
)
def hygiene_summary(spark, sf):
    return hygiene.hygiene_summary(hygiene.text_hygiene(rel.nodes(spark, sf)))


@query(
    "protect_math",
    "SELECT doc_id, regexp_replace(text, '(\\$\\$.*?\\$\\$|\\$.*?\\$|```.*?```)', '#', 'gs') AS protected, "
    "len(regexp_extract_all(text, '(?s)(\\$\\$.*?\\$\\$|\\$.*?\\$|```.*?```)')) AS n FROM documents",
)
def protect_math(spark, sf):
    return rel.table(spark, sf, "documents").select(
        "doc_id",
        F.regexp_replace(t.protect_math(F.col("text")), "__MATH_SEGMENT_[0-9]+__", "#").alias("protected"),
        F.size(t.math_segments(F.col("text"))).cast("bigint").alias("n"),
    )


@query("math_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def math_roundtrip(spark, sf):
    docs = rel.table(spark, sf, "documents")
    restored = t.restore_math(t.protect_math(F.col("text")), t.math_segments(F.col("text")))
    return docs.select("doc_id", F.md5(restored).alias("digest"))


@query(
    "candidate_nodes",
    rel.with_sql(
        "nodes",
        f"SELECT doc_id, pos FROM p WHERE {CONDITIONS['H4']} OR {CONDITIONS['H5']} UNION ALL SELECT doc_id, pos FROM nodes "
        f"WHERE doc_id % 7 = 0 AND doc_id NOT IN (SELECT doc_id FROM p WHERE {CONDITIONS['H4']} OR {CONDITIONS['H5']})",
        p=f"SELECT *, {PROTECTED} AS protected FROM nodes",
    ),
)
def candidate_nodes(spark, sf):
    """Nodes with punctuation issues; documents that only have an issue of the whole text give all their nodes."""
    nodes = rel.nodes(spark, sf)
    hit = hygiene.text_hygiene(nodes).filter(F.col("rule").isin("H4", "H5")).select("doc_id", "location")
    whole = nodes.filter((F.col("pos") == 0) & (F.col("doc_id") % 7 == 0)).select("doc_id", F.lit("/spelling").alias("location"))
    return hygiene.candidate_nodes(nodes, hit.unionByName(whole)).select("doc_id", "pos")


@query(
    "spelling_request",
    rel.with_sql(
        "nodes",
        f"SELECT doc_id, pointer AS path, role FROM p WHERE {' OR '.join(f'({c})' for c in CONDITIONS.values())} "
        f"OR (doc_id, pos) IN (SELECT doc_id, pos FROM hit) OR (doc_id, pos) IN ({ACCENTLESS})",
        **REPEATS,
    ),
)
def spelling_request(spark, sf):
    nodes = rel.nodes(spark, sf)
    return hygiene.spelling_request(hygiene.candidate_nodes(nodes, hygiene.text_hygiene(nodes))).select("doc_id", "path", "role")


@query(
    "check_text",
    rel.with_sql(
        "nodes",
        "SELECT d.doc_id, coalesce(f.n_issues, 0) AS n_issues, coalesce(f.n_request, 0) AS n_request FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_issues, count(DISTINCT pos) AS n_request FROM ("
        + " UNION ALL ".join(f"SELECT doc_id, pos FROM p WHERE {c}" for c in CONDITIONS.values())
        + f" UNION ALL SELECT doc_id, pos FROM hit UNION ALL SELECT doc_id, pos FROM ({ACCENTLESS}) a) t GROUP BY doc_id) f ON f.doc_id = d.doc_id",
        **REPEATS,
    ),
)
def check_text(spark, sf):
    """Findings and request of every document, from one look at its lines."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            F.concat(F.lit("/instruction/"), i.cast("string"), F.lit("/text")).alias("pointer"),
            F.when(i == 0, "instruction").otherwise("solution").alias("role"),
            line.alias("text"),
        ),
    )
    found = hygiene.check_text(rel.texts(spark, sf).select("doc_id", lines.alias("nodes")))
    return found.select("doc_id", F.size("issues").cast("bigint").alias("n_issues"), F.size("request").cast("bigint").alias("n_request"))


@query(
    "spelling_merge",
    rel.with_sql(
        "issues",
        "SELECT doc_id, location, reason, turn, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, location, reason ORDER BY turn, pos) AS n "
        "FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END AS turn FROM issues) s) t WHERE n = 1",
    ),
)
def spelling_merge(spark, sf):
    found = rel.issues(spark, sf)
    merged = hygiene.spelling_merge(found.filter(F.col("pos") % 3 == 0), found.filter(F.col("pos") % 3 != 0))
    return merged.select("doc_id", "location", "reason", "turn", "pos")
