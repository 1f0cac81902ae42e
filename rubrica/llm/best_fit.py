"""Best-fit packing planned over the histogram of lengths.

Every text is encoded once, in pieces: a document is one piece unless it is longer than a sequence, and only then is it
cut. What goes on is one narrow row a piece. Pieces of one length are interchangeable, so the plan needs only how many there
are of each: at most as many numbers as a sequence has places, whatever the size of the corpus. Best fit runs over these counts,
longest first. Sequences that hold the same lengths form a run of consecutive numbers, and a run is filled as a whole: the least
room that a length fits into is filled before the next. The plan is a list of slot runs (length, rank from, sequence,
pieces in each, offset). Pieces then take the planned slots by their rank within their length.

Ranks come from buckets: a length is split into buckets of about BUCKET pieces by a hash, each bucket is numbered alone, and the
bucket counts of a length, summed up, give every bucket its first rank. So a length that a third of all documents
share is spread over many tasks.

The plan has a few rows a length: each length that meets a run of sequences cuts it in three at most. It is sent to all
tasks; the driver sees the histogram and the plan, never a piece.

Defined results: a null or empty text is the closing id alone; bytes that are no UTF-8 count as U+FFFD; rows that repeat
a doc_id are packed one by one; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import utf8
from rubrica.llm.encoding import word_encoder
from rubrica.session import cut_lineage

LENGTH, CLOSING = 2048, 0
#: Pieces of one length that are numbered together.
BUCKET = 4096
#: Pieces in one batch of rows.
BATCH = 10_000


def _cut(length: int, closing: int, path: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        end = np.array([closing], "<u2").tobytes()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(encoder.encode(text.as_py().decode(errors="replace")) + end, "<u2")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                if len(rows) >= BATCH:
                    yield out()
        if rows:
            yield out()

    return run


def pieces(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; path names the tokenizer's file as executors see it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )
    rows = docs.select("doc_id", utf8().alias("text"))
    return rows.mapInArrow(_cut(length, closing, path, schema), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Slot runs (length, first rank, first sequence, pieces in each sequence, offset) for `counts` pieces a length.

    `spare` holds runs of sequences (room left, first sequence, number), least room first. A length goes to the runs with
    the least room that holds it, as many pieces into each sequence as fit, which is what best fit does piece by piece.
    """
    spare: list[tuple[int, int, int]] = []
    slots, made = [], 0

    def fill(left: int, first: int, many: int, size: int, rank: int, wanted: int) -> tuple[int, list[tuple[int, int, int]]]:
        """Puts up to `wanted` pieces into a run of sequences; what was placed, and the runs it leaves."""
        each = left // size
        full = min(many, wanted // each)
        after = []
        if full:
            slots.append((size, rank, first, each, room - left))
            after.append((left - each * size, first, full))
        rest = min(each, wanted - full * each) if full < many else 0
        if rest:
            slots.append((size, rank + full * each, first + full, rest, room - left))
            after.append((left - rest * size, first + full, 1))
        unused = many - full - bool(rest)
        if unused:
            after.append((left, first + many - unused, unused))
        return full * each + rest, after

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        at = bisect_left(spare, (size,))
        changed = []
        while rank < total and at < len(spare):
            placed, after = fill(*spare.pop(at), size, rank, total - rank)
            rank += placed
            changed += after
        if rank < total:
            new = -(-(total - rank) // (room // size))
            changed += fill(room, made, new, size, rank, total - rank)[1]
            made += new
        for run in changed:
            if run[0]:
                insort(spare, run)
    return slots


def _place(slots: np.ndarray, schema: pa.Schema):
    """Gives every ranked piece its slot: the last slot run of its length that starts at or before its rank."""
    size, rank, first, each, offset = slots.T if len(slots) else np.zeros((5, 0), np.int64)
    order = np.lexsort((rank, size))
    size, rank, first, each, offset = (c[order] for c in (size, rank, first, each, offset))
    bounds = {int(s): (int(np.searchsorted(size, s)), int(np.searchsorted(size, s, "right"))) for s in np.unique(size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(lengths), np.int64)
            for s in np.unique(lengths):
                mine = lengths == s
                low, high = bounds[int(s)]
                at[mine] = low + np.searchsorted(rank[low:high], ranks[mine], "right") - 1
            nth = ranks - rank[at]
            found = {"sequence_id": first[at] + nth // each[at], "offset": offset[at] + nth % each[at] * lengths}
            columns = [pa.array(found[f.name]) if f.name in found else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def pack(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in its sequence."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, length, closing, path))  # encoded once; counted, ranked and placed from here
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    slots = np.array(plan(counts, length), np.int64).reshape(-1, 5)

    split = F.create_map(*[F.lit(x).cast("long") for s, n in sorted(counts.items()) if n > BUCKET for x in (s, -(-n // BUCKET))]) if counts and max(counts.values()) > BUCKET else None
    buckets = F.coalesce(split[F.col("length")], F.lit(1).cast("long")) if split is not None else F.lit(1).cast("long")
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    kind = cut.schema["doc_id"].dataType.simpleString()
    doc_id = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("doc_id", doc_id), ("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")])
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    known = spark.sparkContext.broadcast(slots)
    return ranked.mapInArrow(lambda batches: _place(known.value, schema)(batches), columns)
