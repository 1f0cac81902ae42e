"""Toxicity by the nearest labelled examples.

Features are the words of a text and their beginnings. Those that go with the label are selected from counts over the
labelled rows; texts become TF-IDF vectors over them. A block-max inverted index of labelled examples finds the nearest
by exact cosine: examples lie in blocks, every feature has its largest weight in each block, and a block is opened only
if the bound of its cosines can still beat the k-th best. Votes weighted by distance give a raw share, which is
calibrated on the examples, each scored without itself.

Bounds: the model is fitted on at most ROWS labelled rows of each label, the first by a hash of doc_id; the index holds
at most EXAMPLES of their texts, the vocabulary at most TERMS features. Sampled labels are weighted back to the shares
of all labels. Every text is scored whole.

Defined results: a text without features, an empty or a null one get the share of label 1 among labelled texts without
features; without any labelled row every score is 0; several labels of one document count as several rows; a label that
is null counts as none; rows that repeat a doc_id are scored each; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rubrica.llm.common import utf8
from rubrica.session import cut_lineage

ROWS, TERMS, CANDIDATES, EXAMPLES = 12_000, 1024, 20_000, 4096
BEGINNINGS = (4, 5, 6, 7, 8, 9)
LEAST_BEGINNING = BEGINNINGS[0]
NEAREST, BLOCK = 15, 64
#: A feature must be in so many texts of label 1, make the label at least so many times as likely, and tell so much of it.
LEAST, LIFT, GAIN = 4, 2.0, 7.0

_WORD = re.compile(r"[^\W\d_]+")


def features(text: bytes) -> Counter:
    """How often each word occurs, and, marked by a star, each beginning of a longer word."""
    words = Counter(_WORD.findall(text.decode(errors="replace").lower()))
    for w, n in list(words.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                words[f"{w[:k]}*"] += n
    return words


def _counts(known: frozenset | None):
    """Documents of each label that have a feature; only known ones if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                own = features(text.as_py())
                found[toxic].update(own.keys() if known is None else known & own.keys())
            terms = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in found)], ["term", "negative", "positive"])

    return run


def select_terms(train: DataFrame) -> tuple[dict[str, float], int, int]:
    """({feature: idf}, rows of label 0, rows of label 1), from the labelled rows (text, toxic)."""
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    schema = "term string, negative long, positive long"
    total = [F.sum(c).alias(c) for c in ("negative", "positive")]
    first = train.where("toxic = 1").mapInArrow(_counts(None), schema).groupBy("term").agg(*total).where(F.col("positive") >= LEAST)
    known = {r.term: r.positive for r in first.orderBy(F.desc("positive"), "term").limit(CANDIDATES).collect()}
    other = train.where("toxic = 0").mapInArrow(_counts(frozenset(known)), schema).groupBy("term").agg(*total)
    negative = {r.term: r.negative for r in other.collect()}  # candidates only
    gain = {}
    for term, a in known.items():
        b = negative.get(term, 0)
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        if p >= LIFT * q:
            share = (a + b) / (n0 + n1)
            gain[term] = a * math.log(p / share) + (n1 - a + 1e-9) * math.log(max(1e-9, 1 - p) / max(1e-9, 1 - share))
    best = sorted((t for t in gain if gain[t] > GAIN), key=lambda t: (-gain[t], t))[:TERMS]
    return {t: math.log((n0 + n1 + 1) / (known[t] + negative.get(t, 0) + 1)) + 1 for t in best}, n0, n1


class Vectors:
    """TF-IDF vectors over the selected features."""

    def __init__(self, idf: dict[str, float]):
        self.at = {t: i for i, t in enumerate(idf)}
        self.idf = np.array(list(idf.values()))
        self.terms, self.names = list(idf), frozenset(idf)
        self.openings = frozenset(t[:LEAST_BEGINNING] for t in idf)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, weights of length 1); empty where no selected feature occurs."""
        own: Counter = Counter()
        names = self.names
        for w, n in Counter(_WORD.findall(text.decode(errors="replace").lower())).items():
            if w in names:
                own[w] += n
            if w[:LEAST_BEGINNING] in self.openings:
                for k in BEGINNINGS:
                    if len(w) > k and f"{w[:k]}*" in names:
                        own[f"{w[:k]}*"] += n
        terms = sorted(self.at[t] for t in own)
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.array(terms)
        w = (1 + np.log([own[self.terms[i]] for i in terms])) * self.idf[at]
        return at, w / np.linalg.norm(w)


class BlockMaxIndex:
    """Exact nearest examples by cosine. Examples with a common strongest feature lie together, so blocks are skipped."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels, weights, terms: int):
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.order = np.array(order, np.int64)
        self.labels, self.weights = np.asarray(labels, float)[self.order], np.asarray(weights, float)[self.order]
        blocks = -(-len(order) // BLOCK)
        self.bound = np.zeros((terms, blocks))
        post: list[dict[int, list]] = [{} for _ in range(blocks)]
        for row, i in enumerate(order):
            for t, w in zip(vectors[i][0].tolist(), vectors[i][1].tolist()):
                post[row // BLOCK].setdefault(t, []).append((row % BLOCK, w))
                self.bound[t, row // BLOCK] = max(self.bound[t, row // BLOCK], w)
        self.post = [{t: (np.array([r for r, _ in p]), np.array([w for _, w in p])) for t, p in b.items()} for b in post]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest with a cosine above 0, ties by row. skip: a row left out."""
        bound = weights @ self.bound[terms]
        rows, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == k and bound[b] < least:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                if t in self.post[b]:
                    at, own = self.post[b][t]
                    score[at] += w * own
            found = np.flatnonzero(score > 0)
            found = found[found + b * BLOCK != skip]
            rows, cosines = np.append(rows, found + b * BLOCK), np.append(cosines, score[found])
            if len(rows) > k:
                best = np.lexsort((rows, -cosines))[:k]
                rows, cosines = rows[best], cosines[best]
            least = cosines.min() if len(cosines) else 0.0
        best = np.lexsort((rows, -cosines))
        return rows[best], cosines[best]

    def share(self, terms, weights, prior: float, skip: int = -1) -> float:
        """The vote of label 1; nearer examples weigh more, and the prior has a small vote."""
        rows, cosines = self.nearest(terms, weights, skip=skip)
        votes = self.weights[rows] / (1.05 - np.minimum(cosines, 1))
        return float((votes @ self.labels[rows] + prior * 0.5) / (votes.sum() + 0.5))


class Model:
    """Selected features, index and calibration: everything a task needs to score texts."""

    def __init__(self, idf: dict[str, float], examples: list[tuple[bytes | None, int, float]], bare: tuple[float, float]):
        """examples: (text, label, weight) with features; bare: labelled rows of label 0 and 1 without features."""
        self.vectors = Vectors(idf)
        kept = [(v, y, w) for t, y, w in examples if len((v := self.vectors.of(t))[0])]
        rows = [w * y for _, y, w in kept], [w for _, _, w in kept]
        self.prior = sum(rows[0]) / sum(rows[1]) if kept else 0.0
        self.bare = (bare[1] + 0.5 * bare[1] / max(1.0, sum(bare))) / (sum(bare) + 0.5) if sum(bare) else 0.0
        self.index = BlockMaxIndex([v for v, _, _ in kept], [y for _, y, _ in kept], [w for _, _, w in kept], max(1, len(idf))) if kept else None
        self.steps = self._calibrate([v for v, _, _ in kept]) if kept else None

    def _calibrate(self, vectors) -> tuple[np.ndarray, np.ndarray]:
        """Raw shares and the observed ones, made monotone by pooling neighbours that are out of order."""
        ix = self.index
        raw = np.array([ix.share(*vectors[i], self.prior, skip=row) for row, i in enumerate(ix.order)])
        pools = []
        for i in np.argsort(raw, kind="stable"):
            pools.append([raw[i], ix.weights[i] * ix.labels[i], ix.weights[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                x, y, w = pools.pop()
                pools[-1] = [x, pools[-1][1] + y, pools[-1][2] + w]
        return np.array([p[0] for p in pools]), np.array([(p[1] + self.prior * 0.5) / (p[2] + 0.5) for p in pools])

    def score(self, text: bytes) -> tuple[float, list[int]]:
        """(score, numbers of the nearest examples)."""
        terms, weights = self.vectors.of(text)
        if self.index is None or not len(terms):
            return self.bare, []
        share = self.index.share(terms, weights, self.prior)
        raw, observed = self.steps
        at = min(int(np.searchsorted(raw, share)), len(raw) - 1)
        return float(min(1.0, max(0.0, observed[at]))), self.index.order[self.index.nearest(terms, weights)[0]].tolist()


def sampled_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight): at most ROWS labels of each kind that may be learnt from, and the rows each stands for."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").where(~held_out())
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS).withColumn("weight", F.lit(sizes.get(y, 0) / max(1, min(ROWS, sizes.get(y, 0))))) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, weight) of sampled labelled documents; the broadcast side has at most 2 * ROWS rows."""
    return docs.where(~held_out()).select("doc_id", utf8().alias("text")).join(F.broadcast(sampled_labels(labels)), "doc_id")


def held_out():
    """Whether a document is held out; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows; what reaches the driver is bounded by TERMS, CANDIDATES and EXAMPLES."""
    train = cut_lineage(labelled(docs, labels))
    idf, n0, n1 = select_terms(train.select("text", "toxic"))
    names = frozenset(idf)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text a labelled row leaves when only its selected features count, empty if there are none."""
        for batch in batches:
            kept = [" ".join(w for w in _WORD.findall(t.as_py().decode(errors="replace").lower()) if w in names or any(f"{w[:k]}*" in names for k in BEGINNINGS if len(w) > k)).encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("weight"), pa.array(kept, pa.binary())], ["doc_id", "toxic", "weight", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut_lineage(train.mapInArrow(reduced, f"doc_id {kind}, toxic int, weight double, kept binary"))
    sizes = {(r.toxic, r.empty): r.rows for r in rows.groupBy("toxic", (F.length("kept") == 0).alias("empty")).agg(F.sum("weight").alias("rows")).collect()}
    examples = []
    for label in (0, 1):
        order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("kept")
        taken = rows.where((F.col("toxic") == label) & (F.length("kept") > 0)).select("doc_id", "kept").orderBy(*order).limit(EXAMPLES // 2).collect()
        examples += [(bytes(r.kept), label, sizes[label, False] / len(taken)) for r in taken]
    return Model(idf, examples, (sizes.get((0, True), 0), sizes.get((1, True), 0)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    return verdicts(docs, fit(docs.select("doc_id", "text"), labels))


def verdicts(docs: DataFrame, model: Model) -> DataFrame:
    toxic = _score_column(model)
    out = docs.select("doc_id", held_out().alias("held_out"), toxic(utf8()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score_column(model: Model):
    shared = SparkSession.active().sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(bytes(t))[0] for t in text], dtype="float64")

    return score


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, features, examples): the selected features a text has and the numbers of its nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.vectors.terms
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            scored = [shared.value.score(t) for t in texts]
            found = [[names[i] for i in shared.value.vectors.of(t)[0]] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in scored], pa.float64()), pa.array(found, pa.list_(pa.string())), pa.array([e for _, e in scored], pa.list_(pa.int64()))], ["doc_id", "score", "features", "examples"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, features array<string>, examples array<long>")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half."""
    toxic = _score_column(fit(docs.select("doc_id", "text"), labels))
    return docs.where(toxic(utf8()) < 0.5)
