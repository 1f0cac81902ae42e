"""Packing documents into sequences along a space-filling curve.

A document's hashed vector, of its distinct token ids, is projected to a few dimensions by the signs of the ids' hashes;
the Hilbert key of that point puts documents with like words close together. Documents are range-sorted by the key, and
each range is packed as one stream that is cut every 4096 ids. What is left at the end of a range is cut into sequences
whose lengths are powers of two, so no padding is needed anywhere, and ranges need to know nothing of each other.

Texts pass through Python once: ids and key are made together and written as a checkpoint, which the sample for the
range bounds and the sort then read. The bounds come from a sample of the keys, so another run may deal the same documents to
other sequences; pieces cover the same ids in any run.

Copies share one key, so a hash of doc_id breaks the tie and lets a large group of copies be spread over ranges.

Defined results: a null or empty text is the closing id alone; bytes that are no UTF-8 count as U+FFFD; rows that
repeat a doc_id are packed one by one, each with its own pieces; a null doc_id stays null; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import utf8
from rubrica.llm.encoding import word_encoder
from rubrica.session import cut_lineage

LENGTH, CLOSING = 4096, 2
DIMENSIONS, BITS = 4, 8
#: Bytes of ids in one batch of rows.
BATCH = 4 << 20


@cache
def signs(dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1 or -1 for every 16-bit id and dimension, from bits of the id's hash."""
    h = np.array([zlib.crc32(i.to_bytes(2, "little")) for i in range(1 << 16)], np.uint32)
    return np.stack([np.where(h & np.uint32(1 << (7 * d + 3)), 1.0, -1.0) for d in range(dimensions)], axis=1)


def project(ids: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A point, about standard normal in each dimension, from the distinct ids of a text."""
    distinct = np.unique(ids)
    return signs(dimensions)[distinct].sum(axis=0) / max(1, len(distinct)) ** 0.5


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position along the Hilbert curve of integer points (n, dimensions), each coordinate below 2 ** bits.

    Coordinates are undone to the transposed form of the index by reflections and exchanges from the highest bit down
    (J. Skilling, Programming the Hilbert curve, 2004), then their bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(n):
            swap = np.where(x[i] & high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> level & 1
    return key


def curve_keys(points: np.ndarray) -> np.ndarray:
    cells = np.clip((points + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


class _Stream:
    """Cuts one stream of ids into sequences and reports the pieces of each document."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.open: list[tuple] = []  # pieces of the sequence being filled: doc_id, start, ids, doc_tokens
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            piece = ids[start : start + self.length - self.filled]
            self.open.append((doc_id, start, piece, len(ids)))
            self.filled += len(piece)
            start += len(piece)
            if self.filled == self.length:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc_id, start, ids, tokens in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def end(self) -> None:
        """Cuts what is open into sequences whose lengths are the powers of two of its length."""
        pieces, total = self.open[::-1], self.filled
        self.open, self.filled = [], 0
        for bit in range(total.bit_length() - 1, -1, -1):
            room = total & (1 << bit)
            if not room:
                continue
            while room:
                doc_id, start, ids, tokens = pieces.pop()
                self.open.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            self.close()


def _code(path: str | None, doc_id: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)

        def out(docs: list, points: list, ids: list) -> pa.RecordBatch:
            keys = curve_keys(np.array(points).reshape(-1, DIMENSIONS))
            return pa.RecordBatch.from_arrays([pa.array(docs, doc_id), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

        for batch in batches:
            docs, points, ids, held = [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                coded = encoder.encode(text.as_py().decode(errors="replace"))
                docs.append(doc)
                ids.append(coded)
                points.append(project(np.frombuffer(coded, "<u2")))
                held += len(coded)
                if held > BATCH:
                    yield out(docs, points, ids)
                    docs, points, ids, held = [], [], [], 0
            if docs:
                yield out(docs, points, ids)

    return run


def _pack(length: int, closing: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(length, TaskContext.get().partitionId() << 32)
        end = np.array([closing], "<u2").tobytes()

        def out() -> pa.RecordBatch:
            rows, stream.rows = stream.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                stream.add(doc_id, np.frombuffer(ids.as_py() + end, "<u2"))
                if len(stream.rows) > 10_000:
                    yield out()
        stream.end()
        if stream.rows:
            yield out()

    return run


def pack(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every document.

    path names the word tokenizer's file as executors see it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_id = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("doc_id", doc_id)] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    rows = docs.select("doc_id", utf8().alias("text"))
    coded = cut_lineage(rows.mapInArrow(_code(path, doc_id), f"doc_id {kind}, key long, ids binary"))
    ordered = coded.repartitionByRange("key", F.xxhash64("doc_id")).sortWithinPartitions("key", F.xxhash64("doc_id"), "doc_id", "ids")
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.select("doc_id", "ids").mapInArrow(_pack(length, closing, schema), columns)
