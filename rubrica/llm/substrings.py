"""Long repeated passages by compaction of the graph of word k-mers.

The k-mers of all texts are the edges of a De Bruijn graph. A window of 20 words is a path in it; neighbouring windows
that have the same minimizer (the smallest hash among the 15 six-word k-mers inside) form a nonbranching run, and runs
meet by minimizer. Two windows with the same words have the same minimizer at the same place, so they always meet.

1. Minimizers of all runs are counted. Those that occur once cannot belong to a repeated window. The others set a bit in
   a bitmap of fixed size; where bits are shared by chance, runs are only compared for nothing.
2. Runs whose minimizer may be repeated go to its task with the hashes of their windows and their source coordinates.
   There every window is kept at its smallest (document, start) and marked at all others.
3. Marked windows return to their documents, whose words they cover are removed.

Before runs are shuffled, each batch marks what it can: a run equal to one with a smaller coordinate in the same batch is
settled there, so a passage that very many documents share sends one run from each batch. Minimizers that occur more than
OFTEN times (a frequent phrase, or the edges of a shared passage, where runs differ) are marked in a second bitmap; their
runs are dealt out by window, each window to the task of its own hash, and a batch settles all but the first of each. So a
task gets at most OFTEN runs of one minimizer, or one row of a window from each batch.

Defined results: a null text has no words; a null doc_id counts as larger than all others; rows with the same doc_id
are one document to the rule, so equal starts in them remove nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import utf8, whole_groups

WINDOW, KMER = 20, 6
#: log2 of the bits of each map of minimizers, of the repeated and of the frequent ones: 16 MB at any size of the input.
BITS = 27
#: Runs of a minimizer that occurs more often are dealt out by window.
OFTEN = 4096
LAST = (1 << 63) - 1
REMEMBERED = 300_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, for hashes of all windows by one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def rolling(self, h: np.ndarray, width: int) -> np.ndarray:
        while len(self.up) < len(h):
            n = len(self.up)
            self.up = np.append(self.up, self.up * np.uint64(pow(_BASE, n, 1 << 64)))
            self.down = np.append(self.down, self.down * np.uint64(pow(_INVERSE, n, 1 << 64)))
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64))
        out = (sums[width:] - sums[:-width]) * self.down[: len(h) - width + 1]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


class _Reader:
    """Runs of one text: minimizer, first window, windows; and the hash of every window."""

    def __init__(self, window: int, kmer: int):
        self.window, self.kmer = window, kmer
        self.hashes, self.powers = _Hashes(), _Powers()

    def read(self, text: bytes):
        words = text.split()
        if len(words) < self.window:
            return None
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        small = self.powers.rolling(h, self.kmer)
        width = self.window - self.kmer + 1
        at = np.lib.stride_tricks.sliding_window_view(small, width).argmin(axis=1) + np.arange(len(small) - width + 1)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return small[at[first]], first, np.diff(np.append(first, len(at))), h


def _minimizers(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(window, kmer)
        for batch in batches:
            found = [r[0] for t in batch.column("text") if (r := reader.read(t.as_py())) is not None]
            if found:
                m, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n)], ["m", "n"])

    return run


def repeated_minimizers(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, bits: int = BITS, often: int = OFTEN) -> np.ndarray:
    """Two bitmaps as rows of bytes: minimizers that occur more than once, and more than `often` times. Their size
    depends on `bits` alone."""
    counts = docs.select(utf8().alias("text")).mapInArrow(_minimizers(window, kmer), "m long, n long")
    repeated = counts.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.col("m").bitwiseAND(F.lit((1 << bits) - 1))
    bit = "shiftleft(1L, CAST(m & 63 AS INT))"
    maps = F.expr(f"bit_or({bit})").alias("repeated"), F.expr(f"bit_or(CASE WHEN n > {often} THEN {bit} ELSE 0L END)").alias("frequent")
    found = repeated.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(*maps).toArrow()
    out = np.zeros((2, 1 << (bits - 6)), np.int64)
    for row, name in zip(out, ("repeated", "frequent")):
        row[found.column("word").to_numpy()] = found.column(name).to_numpy()
    return out.view(np.uint8)


RUN = "m long, doc long, tag long, pos int, marked int, hashes binary"


def _first_equal(rows, m, runs) -> tuple[list, list]:
    """Of the runs of a batch, those to send, and those settled here: equal to one with a smaller coordinate."""
    sent, settled, seen = [], [], {}
    for i in rows:
        key = (int(m[i]), runs[i][3])
        if key in seen and runs[seen[key]][0] != runs[i][0]:
            settled.append(i)
        else:
            seen.setdefault(key, i)
            sent.append(i)
    return sent, settled


def _first_windows(h, doc, tag, pos):
    """Of the windows of a batch, the rows (h, doc, tag, pos) to send, and stretches (doc, tag, pos, size) of the others, all
    of which also start at a smaller coordinate in the batch. Rows that are repeated whole count once."""
    order = np.lexsort((tag, pos, doc, h))
    h, doc, tag, pos = (x[order] for x in (h, doc, tag, pos))
    new = np.append(True, h[1:] != h[:-1])
    same = np.append(False, ~new[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]) & (tag[1:] == tag[:-1]))
    of = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (doc != doc[of]) | (pos != pos[of])
    sent, rest = np.flatnonzero(~later & ~same), np.flatnonzero(later & ~same)
    doc_, tag_, pos_ = (x[rest[np.lexsort((pos[rest], tag[rest], doc[rest]))]] for x in (doc, tag, pos))
    start = np.flatnonzero(np.append(True, (np.diff(pos_) != 1) | (np.diff(tag_) != 0) | (np.diff(doc_) != 0))[: len(pos_)])
    return (h[sent], doc[sent], tag[sent], pos[sent]), (doc_[start], tag_[start], pos_[start], np.diff(np.append(start, len(pos_))))


def _runs(window: int, kmer: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, maps = _Reader(window, kmer), shared.value
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            ms, runs, single = [], [], []
            for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                if (found := reader.read(text.as_py())) is None:
                    continue
                m, first, count, h = found
                place = m & mask
                may, frequent = (maps[:, (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if may.any():
                    windows = reader.powers.rolling(h, window)
                    few = may & ~frequent
                    for x, a, n in zip(m[few], first[few].tolist(), count[few].tolist()):
                        ms.append(x)
                        runs.append((doc, tag, a, windows[a : a + n].tobytes()))
                    if frequent.any():
                        at = np.flatnonzero(np.repeat(frequent, count))
                        single.append((windows[at], np.full(len(at), doc, np.int64), np.full(len(at), tag, np.int64), at))
            order = sorted(range(len(runs)), key=lambda i: (runs[i][0], runs[i][2]))
            sent, settled = _first_equal(order, ms, runs)
            rows = [(int(ms[i].view(np.int64)), *runs[i][:3], 0, runs[i][3]) for i in sent]
            gone = [(*runs[i][:3], len(runs[i][3]) // 8) for i in settled]
            if single:
                (h, *where), stretches = _first_windows(*(np.concatenate(c) for c in zip(*single)))
                rows += [(m, *w, 0, m.to_bytes(8, "little", signed=True)) for m, *w in zip(h.view(np.int64).tolist(), *(c.tolist() for c in where))]
                gone += zip(*(c.tolist() for c in stretches))
            rows += [(xxhash.xxh64_intdigest(b"%d" % g[0]) >> 1, *g, b"") for g in gone]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["m", "doc", "tag", "pos", "marked", "hashes"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that also start at a smaller coordinate; rows come sorted by minimizer and coordinate."""
    for t, first in whole_groups(batches, ["m"]):
        settled = t.column("marked").to_numpy()
        lengths = np.array([len(b) // 8 for b in t.column("hashes").to_pylist()], np.int64)
        doc, tag, pos = (t.column(c).to_numpy() for c in ("doc", "tag", "pos"))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
        row = np.repeat(np.arange(t.num_rows), lengths)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        order = np.lexsort((pos[row] + within, doc[row], h, group[row]))
        g, x, d, p = group[row][order], h[order], doc[row][order], (pos[row] + within)[order]
        new = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))[: len(order)]
        head = np.flatnonzero(new)
        of = np.repeat(head, np.diff(np.append(head, len(order))))
        later = np.zeros(len(order), bool)
        later[order] = (d != d[of]) | (p != p[of])
        at = np.flatnonzero(later)
        start = at[np.append(True, (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]]))[: len(at)]]
        size = np.diff(np.append(np.searchsorted(at, start), len(at)))
        whole = np.flatnonzero(settled)
        rows = np.append(row[start], whole)
        begin = np.append((pos[row] + within)[start], pos[whole])
        size = np.append(size, settled[whole])
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(tag[rows]), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc", "tag", "start", "size"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, sizes in zip(batch.column("text"), batch.column("starts").to_pylist(), batch.column("sizes").to_pylist()):
                words = text.as_py().split()
                n_words.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.array(starts) + np.array(sizes) + window - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, bits: int = BITS, often: int = OFTEN) -> DataFrame:
    """(doc, tag, start, size): stretches of `size` windows, from word `start`, that also start earlier.

    doc is doc_id, or the largest long for null; tag is a hash of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated_minimizers(docs, window, kmer, bits, often))
    runs = keyed(docs).select("doc", "tag", "text").mapInArrow(_runs(window, kmer, bits, shared), RUN)
    met = runs.repartition("m").sortWithinPartitions("m", "doc", "pos")
    return met.mapInArrow(_mark, "doc long, tag long, start int, size int")


def keyed(docs: DataFrame) -> DataFrame:
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), tag.alias("tag"), utf8().alias("text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, bits: int = BITS, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of every document that stay, joined by spaces, in UTF-8."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_spans(docs, window, kmer, bits, often)
    marked = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = keyed(docs).join(marked, ["doc", "tag"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.size").alias("sizes"))
    return joined.mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, kept binary")
