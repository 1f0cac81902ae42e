"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rubrica.llm import best_fit, conversation_repair, exact_dedup, hard_negatives, language_id, mixing, packing, pii, simhash, substrings, token_counts, toxicity, vector_graph
from rubrica.llm.common import table
from rubrica.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


@query("op6_simhash_blocks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({NORMAL}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
    FROM d WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the one of its equal texts that stays."""
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(
    "op1_mixing",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM d GROUP BY source),
    r AS (
        SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
            (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER before, 0)) / sum(weight) OVER onward AS level
        FROM s
        WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            onward AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    t AS (
        SELECT source, source_size,
            least(2.0::DOUBLE * source_size, weight * coalesce((SELECT max(level) FROM r WHERE level <= ratio), 0.0::DOUBLE)) AS target
        FROM r),
    c AS (
        SELECT doc_id, size, source_size, target,
            sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS c
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
        CAST(least(size, greatest(0, floor(target) - c)) + least(size, greatest(0, floor(target) - source_size - c)) AS BIGINT) AS taken
    FROM c
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, in the order in which training first meets them."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every context limit."""
    return token_counts.context_table(token_counts.histogram(table(spark, sf_dir, "documents", "text")))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_substrings")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows that occur earlier."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_vector_graph")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in as few sequences of 2048 ids as best fit gives."""
    return best_fit.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "op12_hard_negatives",
    """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    n AS (
        SELECT p.anchor_id, positive_id,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
            other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
            AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, below each of its positives; every seventh label is wrong."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.summaries(vectors, noisy)
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation, after damage to about a quarter of its rows."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    damaged = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return conversation_repair.audited(damaged, rows)
