"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax output.

Words are split at ASCII white space; each gives the bucket of "<word>" and those of its n-grams of 3 and 4 code points.
Training: numpy stochastic gradient descent on the driver over a bounded sample of labelled rows; the sample's features
are made where the rows are. Scoring: the output is linear in the mean vector, so a bucket's part in it is one number;
the workers keep the sum of each word they have met.

Null and empty texts have the mean vector zero, and so the score of the bias. Every row gives one row. Labels for which
there is no document, null labels and null ids are not used; without labels of both kinds the score is 0.5 throughout.
Of several labels of an id the larger counts, of several documents of an id the one of the least features. An empty
table gives no rows; a very long text is scored by itself, with memory in proportion to it. Of the documents only the id
and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import slices, span_digests, tidy

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (3, 4)
#: Labelled rows of each label that are learned from, at most: those of the least hash of their id.
SAMPLE = 1500
#: Bytes of features that come to the driver for it, at most.
SAMPLE_BYTES = 256 << 20
EPOCHS, RATE, SEED = 6, 0.5, 11
#: Words that a worker remembers.
CACHE_WORDS = 500_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one after the other, and the number of each word's."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    length = np.array(list(map(len, marked)), np.int64)
    first = np.cumsum(length) - length
    starts, ends, owner = [first], [first + length], [np.arange(len(words))]
    for n in GRAMS:
        many = np.maximum(length - n + 1, 0) * (length > n)
        own = np.repeat(np.arange(len(words)), many)
        at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        starts.append(at)
        ends.append(at + n)
        owner.append(own)
    whose = np.concatenate(owner)
    order = np.argsort(whose, kind="stable")
    digest = span_digests(points, np.concatenate(starts)[order], np.concatenate(ends)[order])
    return (digest & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(whose, minlength=len(words))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs."""
    words: dict[bytes, int] = {}
    for w in text.split():
        words[w] = words.get(w, 0) + 1
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, counts = word_features(list(words))
    total = np.bincount(ids, np.repeat(np.array(list(words.values())), counts), BUCKETS).astype(np.int64)
    here = np.flatnonzero(total)
    return here, total[here]


@dataclass
class Model:
    """A number for each bucket (its vector's part in the difference of the two outputs) and the difference of the biases."""

    weights: np.ndarray
    bias: float

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, one document at a time; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    share = np.bincount([y for _, _, y in rows], minlength=2)
    if not share.all():
        return Model(np.zeros(BUCKETS), 0.0)
    weight = len(rows) / (2 * share)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            ids, counts, y = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            part = (counts / max(1, counts.sum())).astype(np.float32)
            mean = part @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= np.float32(weight[y] * step)
            back = p @ layer
            layer -= np.outer(p, mean)
            bias -= p
            if len(ids):
                # A bucket's gradient is its share of the document; without the share's smallness learning would take too long.
                vectors[ids] -= np.outer(np.minimum(part * len(ids), 4), back)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: str) -> Column:
    """Whether the crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` rows of each label that are not held out, and at most half of `sample_bytes` of their features."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    ranked = known.withColumn("_h", F.xxhash64("_id"))
    chosen = None
    for y in (0, 1):  # a top-k of each label, so that the rows to be joined are bounded
        some = ranked.filter(F.col("_y") == y).orderBy("_h", "_id").limit(sample).select("_id", "_y")
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for _, _, data, edge in slices(batch.column(2)):
                for a, b in zip(edge.tolist(), edge[1:].tolist()):
                    here, many = document_features(data[a:b])
                    ids.append(here.astype(np.uint32).tobytes())
                    counts.append(many.astype(np.uint32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["id", "y", "ids", "counts"])

    head = rows.schema["_id"].dataType.simpleString()
    # One row of each id, so that what comes to the driver is bounded by the sample.
    found = rows.mapInArrow(tidy(run), f"id {head}, y int, ids binary, counts binary").groupBy("id").agg(F.min(F.struct("y", "ids", "counts")).alias("s"))
    # Of each label, in the order of the sample, what fits the driver.
    own = F.octet_length("s.ids") + F.octet_length("s.counts")
    before = F.sum(own).over(Window.partitionBy("s.y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("_bytes", before).filter(F.col("_bytes") <= sample_bytes // 2).select("id", "s.*").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["ids"]), bytes(r["counts"])))
    return fit([(np.frombuffer(r["ids"], np.uint32).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(np.int64), r["y"]) for r in got])


class WordSums:
    """The sum of the weights of each word's buckets, and their number, for words met."""

    def __init__(self, model: Model, most: int = CACHE_WORDS):
        self.model, self.most = model, most
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((2, 1 << 12))

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        get = self.known.get
        place = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(place < 0)
        if missing.size:
            fresh = list(dict.fromkeys(words[k] for k in missing.tolist()))
            ids, counts = word_features(fresh)
            low, high = len(self.known), len(self.known) + len(fresh)
            if high > self.values.shape[1]:
                self.values = np.concatenate([self.values, np.zeros((2, high))], axis=1)
            self.values[0, low:high] = np.add.reduceat(self.model.weights[ids], np.cumsum(counts) - counts)
            self.values[1, low:high] = counts
            self.known.update(zip(fresh, range(low, high)))
            place[missing] = [self.known[words[k]] for k in missing.tolist()]
        return self.values[:, place]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher where label 1 is likelier) and predicted (1 where score >= 0.5) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = WordSums(sent.value)
        for batch in batches:
            found = []
            for _, _, data, edge in slices(batch.column(1)):
                each = [data[a:b].split() for a, b in zip(edge.tolist(), edge[1:].tolist())]
                counts = np.array(list(map(len, each)), np.int64)
                values = sums.of([w for own in each for w in own])
                row = np.repeat(np.arange(len(each)), counts)
                found.append(sent.value.score(np.bincount(row, values[0], len(each)), np.bincount(row, values[1], len(each))))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    head = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"doc_id {head}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row, by a model trained on the rows that are not held out."""
    scored = score(docs, train(docs, labels, id_col, text, label), id_col, text)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
