"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier for each bit, a logistic regression over hashed letter n-grams,
predicts that bit of a text's codeword. Decoding is loss-weighted: a codeword's distance is the sum of the bits'
logistic losses, each weighted by how reliable its classifier was on rows kept back from its training. The nearest
codeword wins; where the runner-up is almost as near, the text is flagged as ambiguous.

Bounds: the classifiers are fitted on about SAMPLE labelled rows, spread evenly over the languages by a hash of doc_id.
Everything else covers all rows, and every text is read whole.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing is labelled; with one
language only, that one with score 1; a null doc_id counts as the empty text; repeated rows are predicted each; bytes that
are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import utf8

SAMPLE, SIZE, LONGEST = 2400, 1 << 13, 4
STEPS, RATE, DECAY = 120, 2.0, 1e-5
#: A text is ambiguous if the runner-up has at least this share of the winner's probability.
AMBIGUOUS = 0.5

_CLASS = np.full(256, 32, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray | None:
    """Numbers of a text's hashed n-grams of 1 to 4 bytes, other bytes than letters as spaces; None without letters."""
    if not any(map(str.isalpha, text)):  # numbers of other kinds, as ² ½ Ⅷ, are no letters
        return None
    b = _CLASS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    h, out = b * np.uint32(2654435761), np.zeros(SIZE, np.int64)
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(b) < n:
                break
            h = (h[:-1] ^ (b[n - 1 :] + np.uint32(n * 977))) * np.uint32(2246822519)
        out += np.bincount((h >> np.uint32(7)) % np.uint32(SIZE), minlength=SIZE)
    return out


def vector(text: str) -> np.ndarray | None:
    """Square roots of the n-grams' shares: a vector of length 1."""
    counts = grams(text)
    return None if counts is None else np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language. Few languages get all ways to part them in two, many a fixed random code."""
    if languages <= 1:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        bits = [(1, *rest) for rest in product((1, 0), repeat=languages - 1) if not all(rest)]
        return np.array(bits, np.int8).T
    rng, length = np.random.default_rng(11), int(np.ceil(10 * np.log2(languages)))
    code = rng.integers(0, 2, (languages, length)).astype(np.int8)
    while len(np.unique(code, axis=0)) < languages:
        code = rng.integers(0, 2, (languages, length)).astype(np.int8)
    return code[:, (code.min(axis=0) == 0) & (code.max(axis=0) == 1)]


class Model:
    """Codewords, one linear classifier for each bit, and the bits' reliabilities."""

    def __init__(self, vectors: np.ndarray, languages: list[str]):
        self.names = sorted(set(languages))
        self.code = 2.0 * codewords(len(self.names)) - 1
        self.weights = np.zeros((SIZE + 1, self.code.shape[1]), np.float32)
        self.reliable = np.ones(self.code.shape[1])
        if not self.code.size:
            return
        target = self.code[[self.names.index(x) for x in languages]].astype(np.float32)
        kept = np.arange(len(vectors)) % 5 == 4
        first = self._fit(vectors[~kept], target[~kept])
        if kept.any():
            error = np.mean(np.sign(self._margins(vectors[kept], first)) != target[kept], axis=0)
            error = np.clip(error, 0.5 / kept.sum(), 0.49)
            self.reliable = np.log((1 - error) / error)
            self.reliable /= self.reliable.mean()
        self.weights = self._fit(vectors, target)

    @staticmethod
    def _margins(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return vectors @ weights[:-1] + weights[-1]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Logistic regressions of all bits at once by accelerated gradient descent."""
        w = v = np.zeros((SIZE + 1, y.shape[1]), np.float32)
        for step in range(STEPS):
            slope = -y / (1 + np.exp(np.clip(y * self._margins(x, v), -30, 30))) / len(x)
            gradient = np.vstack([x.T @ slope, slope.sum(axis=0)]) + DECAY * v
            new = v - np.float32(RATE) * gradient
            w, v = new, new + np.float32(step / (step + 3)) * (new - w)
        return w

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        x = vector(text) if self.names else None
        if x is None:
            return "und", 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        margins = self._margins(x, self.weights)
        loss = (np.logaddexp(0, -self.code * margins) * self.reliable).sum(axis=1)
        p = np.exp(-(loss - loss.min()) * 2 / self.code.shape[1])
        order = np.argsort(-p, kind="stable")
        return self.names[order[0]], float(p[order[0]] / p.sum()), bool(p[order[1]] >= AMBIGUOUS * p[order[0]])


def held_out():
    """Whether a document is held out; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> Model:
    """A model from about SAMPLE rows of docs (doc_id, text, lang) that are not held out and have a language."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    if not sizes:
        return Model(np.zeros((0, SIZE), np.float32), [])
    each = max(1, SAMPLE // len(sizes))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r["count"])) for r in sizes], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                counts = grams(text.as_py().decode(errors="replace"))
                if counts is not None:
                    at = np.flatnonzero(counts).astype(np.int16)
                    row = [pa.array([lang]), pa.array([at.tobytes()]), pa.array([np.minimum(counts[at], 65535).astype(np.uint16).tobytes()])]
                    yield pa.RecordBatch.from_arrays(row, ["lang", "at", "n"])

    sample = usable.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("doc_id", utf8().alias("text"), "lang")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE).mapInArrow(read, "lang string, at binary, n binary").collect()
    x = np.zeros((len(rows), SIZE), np.float32)
    for own, r in zip(x, rows):
        own[np.frombuffer(bytes(r.at), np.int16)] = np.frombuffer(bytes(r.n), np.uint16)
        own[:] = np.sqrt(own / own.sum())
    return Model(x, [r.lang for r in rows])


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every document of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py().decode(errors="replace")) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", held_out().alias("held_out"), utf8().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
