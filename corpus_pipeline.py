"""From raw documents to packed training sequences: five stages, each a whole job over what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one. All
but the last return the columns of docs as they came, whatever they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rubrica.llm import exact_dedup, mixing, packing, simhash, toxicity
from rubrica.llm.common import table
from rubrica.session import checkpoint_dir, configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the nearest labelled examples call toxic."""
    configure(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    configure(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    configure(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and in the order, as the curriculum of their source takes them."""
    configure(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Scores of a trained model and ids of a tokenizer decide the rows; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what passes between them is written to the folder that all executors share."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
