"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has one bit for each of 64 places, set where more than half of the XXH64 values of the text's word
shingles have it. Two fingerprints that differ in at most 4 bits agree on at least 2 of 6 blocks, so every close pair
meets under one of the 15 pairs of blocks, where the Hamming distance is verified.

Defined results: null and empty texts have fingerprint zero and link with each other; rows with equal fingerprints are
one node, so copies add nothing; rows that repeat a doc_id each get their own row; a null doc_id gets a row and is
never a component's smallest id unless all are null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import components, utf8, whole_groups
from rubrica.session import cut_lineage

SHINGLE, SEED, DISTANCE, BLOCKS = 4, 42, 4, 6
#: A bucket of more fingerprints is dealt out as pairs of its parts. Groups of up to so many rows are compared by lag.
PART, SMALL = 20_000, 24


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        parts = [whole]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        parts = [whole[a:b] for a, b in zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist())]
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(parts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        values = np.fromiter((fingerprint(t.as_py()) for t in text), np.uint64, len(text)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the bits they cover, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(masks, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def _spanning(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect all that close pairs connect: each member found is compared with those not yet found only."""
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                found = left[near]
                yield from ((at, x) for x in found)
                todo.extend(found)
                left = left[~near]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, ["mask", "key", "i", "j"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            size = np.diff(np.append(first, len(fp)))
            group, small = np.repeat(np.arange(len(first)), size), np.repeat(size <= SMALL, size)
            us, vs = [], []
            for lag in range(1, min(SMALL, len(fp))):
                a = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
                if not len(a):
                    break
                a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= distance]
                us.append(a)
                vs.append(a + lag)
            for g in np.flatnonzero(size > SMALL):
                links = np.array(list(_spanning(fp[first[g] : first[g] + size[g]], distance)), np.int64).reshape(-1, 2)
                us.append(links[:, 0] + first[g])
                vs.append(links[:, 1] + first[g])
            if us:
                u, v = (fp[np.concatenate(x).astype(np.int64)].view(np.int64) for x in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def block_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(u, v): verified links between distinct fingerprints fp that connect what all close pairs connect.

    A bucket with more than `part` fingerprints is split by a hash and each pair of its parts becomes a task's group,
    so no bucket is gathered whole.
    """
    masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(blocks, distance))))
    keyed = fps.select("fp", F.inline(masks))
    large = keyed.groupBy("mask", "key").count().where(F.col("count") > part)
    parts = F.coalesce(F.ceil(F.col("count") / part), F.lit(1))
    dealt = (
        keyed.join(large, ["mask", "key"], "left")
        .select("mask", "key", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"), parts.cast("int").alias("parts"))
        .select("mask", "key", "fp", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
        .select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    ordered = dealt.repartition("mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j", "fp")
    return ordered.mapInArrow(_links(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most `distance` bits reach."""
    rows = cut_lineage(fingerprints(docs))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(block_links(nodes.select("fp"), distance, blocks)).withColumnRenamed("id", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, without those whose group has a smaller doc_id. Rows with null doc_id stay."""
    found = near_duplicates(docs)
    dropped = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") > F.col("component_id")).alias("drop")).where("drop")
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
