"""Exact duplicates by static binary-fuse filters.

Documents fall into immutable snapshots and one incoming batch. Each snapshot has one binary-fuse filter per bucket of
digests. Duplicates inside a batch are grouped by digest; the distinct new digests are screened by the filters of their
bucket, and only positives join the snapshots' exact digests. All groups of two or more rows are then checked byte by
byte: their texts, and no others, are grouped whole.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.

Defined results: a null text equals an empty one; rows that share the kept doc_id and text are all kept (a row has no
other name); a null doc_id stays only where the whole group has none; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.session import cut_lineage

#: Digests a filter's bucket holds on average; the number of buckets follows the number of rows.
BUCKET_ROWS = 50_000


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of the normalised text, 32 bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"))


# --- binary-fuse filters -----------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments for n keys."""
    length = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    return length, max(1, math.ceil(n * factor / length) - 2)


def _slots(h: np.ndarray, length: int, count: int) -> np.ndarray:
    """The three slots of each hash, in neighbouring segments; one row for each."""
    base = ((h >> np.uint64(32)) * np.uint64(count * length)) >> np.uint64(32)
    low = np.uint64(length - 1)
    return np.stack([base, (base + np.uint64(length)) ^ ((h >> np.uint64(18)) & low), (base + np.uint64(2 * length)) ^ (h & low)]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, table) of a filter over 64-bit keys; repeated keys count once.

    Keys are peeled in rounds: all that are alone in a slot go at once, and get their slot's value in reverse order.
    """
    keys = np.unique(keys.astype(np.uint64))
    length, count = _shape(len(keys))
    size = (count + 2) * length
    for seed in range(1, 1000):
        h = _mixed(keys, seed)
        slots, rounds = _slots(h, length, count), []
        number, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.add.at(number, row, 1)
            np.bitwise_xor.at(total, row, index)
        left = len(keys)
        while left:
            at = np.flatnonzero(number == 1)
            if not len(at):
                break
            key, first = np.unique(total[at], return_index=True)
            rounds.append((key, at[first]))
            for row in slots:
                np.subtract.at(number, row[key], 1)
                np.bitwise_xor.at(total, row[key], key)
            left -= len(key)
        if not left:
            break
    else:
        raise ValueError("no seed lets the filter be built")
    out, mark = np.zeros(size, np.uint8), _mark(h)
    for key, own in reversed(rounds):
        a, b, c = (out[row[key]] for row in slots)
        out[own] = mark[key] ^ a ^ b ^ c  # the slot itself is still zero
    return seed, length, count, out.tobytes()


def may_contain(keys: np.ndarray, seed: int, length: int, count: int, table: bytes) -> np.ndarray:
    h = _mixed(keys.astype(np.uint64), seed)
    a, b, c = (np.frombuffer(table, np.uint8)[row] for row in _slots(h, length, count))
    return _mark(h) == a ^ b ^ c


def _keys(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[8:16] for d in digest), np.uint64)


def build_filters(groups: DataFrame) -> DataFrame:
    """(snapshot, bucket, seed, length, segments, filter) from distinct (snapshot, bucket, digest)."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *build_filter(_keys(rows["digest"])))])

    return groups.groupBy("snapshot", "bucket").applyInPandas(build, "snapshot int, bucket int, seed int, length int, segments int, filter binary")


def screen(new: DataFrame, filters: DataFrame) -> DataFrame:
    """The distinct new (bucket, digest) that the filter of at least one snapshot lets through."""

    def test(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keys, hit = _keys(rows["digest"]), np.zeros(len(rows), bool)
        for f in held.itertuples():
            hit |= may_contain(keys, f.seed, f.length, f.segments, f.filter)
        return rows.loc[hit, ["digest"]]

    return new.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest binary")


# --- the operator ------------------------------------------------------------------------------------------------


def duplicates(docs: DataFrame, part=None) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of docs (doc_id, text).

    part: an integer column over doc_id; its largest value, 2, is the incoming batch, smaller ones are snapshots.
    By default documents are dealt to two snapshots and the batch by a hash of doc_id.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) if part is None else part
    rows = cut_lineage(digests(docs).withColumn("part", part.cast("int")))
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    groups = cut_lineage(rows.groupBy("part", "digest").agg(F.count("*").alias("n")).withColumn("bucket", bucket))
    held = groups.where("part < 2")
    new = groups.where("part >= 2").select("bucket", "digest")
    filters = build_filters(held.select(F.col("part").alias("snapshot"), "bucket", "digest"))
    exact = held.groupBy("digest").agg(F.count("*").alias("snapshots"), F.sum("n").alias("n"))
    both = screen(new, filters).join(exact, "digest").select("digest")
    repeated = groups.where("n > 1").select("digest").unionByName(exact.where("snapshots > 1").select("digest")).unionByName(both).distinct()
    checked = byte_checked(docs, repeated)
    size, keep = F.coalesce("size", F.lit(1)), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    out = rows.select("doc_id", "digest").join(checked, "digest", "left").select("doc_id", "digest", keep.alias("keep_id"), size.cast("long").alias("group_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def byte_checked(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(digest, keep, size) of groups whose texts are the same byte for byte; equal digests of unequal texts end the job.

    Texts of a group are combined before they are shuffled, so a group of any size sends one text from each task.
    """
    wide = docs.select("doc_id", normalised().alias("norm")).withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    same = wide.join(repeated, "digest", "left_semi").groupBy("digest", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    one = same.groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"), F.count("*").alias("texts"))
    return one.select("digest", "keep", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("texts differ under one digest")).cast("long")).alias("size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, without those of which an equal text with a larger doc_id stays."""
    gone = duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id", "digest").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"))
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["digest"] == gone["digest"])
    return keyed.join(gone, same, "left_anti").select("row.*")
