"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

A word is a run of letters and digits or a run of signs. It falls into one of WORDS buckets by a hash,
and each bucket has a sparse ternary index vector, fixed by a seed. A word's vector is the sum of the
index vectors of its neighbours over all its places in the whole corpus, brought to length one; the
sums are whole numbers, so they are the same in any order. A document is its words' vectors pooled:
mean, spread, and how alike the vectors of words at small distances are. A network with one hidden
layer tells the class, and its logits are divided by a temperature that is fitted on documents the
network hasn't learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, plus

#: Buckets of words, dimensions of their vectors, entries of an index vector that aren't zero, neighbours on each side.
WORDS, DIMENSIONS, ENTRIES, NEAR = 1 << 13, 32, 4, 2
#: Distances between words whose vectors are compared, and words of a stretch for the greatest and least likeness.
APART, STRETCH = (1, 2, 3), 24
FEATURES = 2 * DIMENSIONS + 3 * len(APART) + 1
#: Training takes at most about so many labelled rows of a class, picked by a hash.
SAMPLE = 4000
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-3
#: One in so many training rows is kept for the temperature.
HELD = 5
#: Words that are gathered before they are counted, and that are pooled at once.
BLOCK = 1 << 17

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> np.ndarray:
    """The bucket of each word of a text."""
    found = _WORD.findall((text or "").encode("utf-8", "replace"))
    return np.fromiter(map(crc32, found), np.uint32, len(found)).astype(np.int64) % WORDS


def index_vectors() -> np.ndarray:
    """Each bucket's index vector, and a zero one that stands between documents."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS + 1, DIMENSIONS), np.int8)
    place = rng.random((WORDS, DIMENSIONS)).argsort(axis=1)[:, :ENTRIES]
    np.put_along_axis(out[:WORDS], place, np.tile(np.array([1, -1], np.int8), (WORDS, ENTRIES // 2)), axis=1)
    return out


class Contexts:
    """Sums of neighbours' index vectors, for the words of documents added one by one."""

    def __init__(self):
        self.index = index_vectors()
        self.total = np.zeros((WORDS + 1, DIMENSIONS), np.int64)
        self.seen = np.zeros(WORDS + 1, bool)
        self.docs: list[np.ndarray] = []
        self.n = 0
        self.gap = np.full(NEAR, WORDS)

    def add(self, doc: np.ndarray) -> None:
        self.docs += [doc, self.gap]
        self.n += len(doc)
        if self.n >= BLOCK:
            self.flush()

    def flush(self) -> None:
        b = np.concatenate([self.gap, *self.docs])
        self.docs, self.n = [], 0
        for i in range(NEAR, len(b) - NEAR, BLOCK):
            end = min(i + BLOCK, len(b) - NEAR)
            own = self.index[b[i - NEAR : end + NEAR]]
            # entries of at most 2 * NEAR neighbours fit one byte
            around = sum(own[NEAR + k : len(own) - NEAR + k] for k in (*range(-NEAR, 0), *range(1, NEAR + 1)))
            order = np.argsort(b[i:end].astype(np.uint16), kind="stable")
            word = b[i:end][order]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            self.total[word[starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)
            self.seen[word[starts]] = True

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets seen, and their sums."""
        self.flush()
        at = np.flatnonzero(self.seen[:WORDS])
        return at, self.total[at]


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def pooled(doc: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, and for each distance the mean likeness of words so
    far apart and the least and greatest mean over stretches; the logarithm of its length."""
    n = len(doc)
    out = np.zeros(FEATURES)
    if not n:
        return out
    total, square, ones = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.ones(min(n, BLOCK), np.float32)
    alike = [np.zeros(max(0, n - k), np.float32) for k in APART]
    for i in range(0, n, BLOCK):
        v = vectors[doc[i : i + BLOCK + max(APART)]]
        own = v[:BLOCK]
        total += ones[: len(own)] @ own
        square += ones[: len(own)] @ (own * own)
        for k, a in zip(APART, alike, strict=True):
            got = np.einsum("ij,ij->i", v[:-k], v[k:])[:BLOCK]
            a[i : i + len(got)] = got
    out[:DIMENSIONS] = total / n
    out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(0, square / n - (total / n) ** 2))
    for j, a in enumerate(alike):
        if len(a):
            starts = np.arange(0, max(1, len(a) - STRETCH // 2), STRETCH)
            means = np.add.reduceat(a, starts) / np.diff([*starts, len(a)])
            out[2 * DIMENSIONS + 3 * j : 2 * DIMENSIONS + 3 * j + 3] = a.mean(), means.min(), means.max()
    out[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    shift: np.ndarray
    second: np.ndarray
    base: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.first + self.shift) @ self.second + self.base

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


@dataclass
class Model:
    network: Network
    vectors: np.ndarray = field(repr=False)


def _trained(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Adam on the weighted cross entropy, over all rows at each step."""
    rng = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        back = weight * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / weight.sum()
        inner = np.outer(back, p[2]) * (1 - h * h)
        grads = [z.T @ inner + DECAY * p[0], inner.sum(0), h.T @ back + DECAY * p[2], np.array([back.sum()])]
        for a, g, u, v in zip(p, grads, m, s, strict=True):
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= RATE * (1 - t / (EPOCHS + 1)) * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def _temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy, by golden section over its logarithm."""

    def loss(t: float) -> float:
        z = np.clip(logits / np.exp(t), -40, 40)
        return float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())

    a, b, r = -2.0, 2.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Network:
    """From pooled rows of labels 0 and 1; share: of rows labelled 1 among all. Rows of one class give
    its score everywhere, no rows at all one half."""
    if len(y) == 0 or y.min() == y.max():
        z = np.zeros(FEATURES)
        return Network(z, z + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0 if not len(y) else 30.0 if y[0] else -30.0)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    # the last rows of each class by order, so that both are held out
    rank = np.zeros(len(y), int)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    out = rank % HELD == HELD - 1
    if min((y[out] == 1).sum(), (y[out] == 0).sum()) == 0:
        return _trained(x, y, weight)
    net = _trained(x[~out], y[~out], weight[~out])
    net.temperature = _temperature(net.logits(x[out]), y[out], weight[out])
    return net


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector for each bucket, from all texts of docs: at most WORDS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Contexts()
        for b in lean(batches):
            for text in b.column(0):
                c.add(words(text.as_py()))
        at, sums = c.sums()
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[:, i]) for i in range(DIMENSIONS))], ["word", *(f"s{i}" for i in range(DIMENSIONS))])

    names = [f"s{i}" for i in range(DIMENSIONS)]
    rows = docs.select("text").mapInArrow(count, "word long, " + ", ".join(f"{n} long" for n in names))
    got = rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((WORDS, DIMENSIONS))
    out[got.column(0).to_numpy()] = np.array([got.column(i + 1).to_numpy() for i in range(DIMENSIONS)]).T.reshape(-1, DIMENSIONS)
    return unit(out).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors of all docs (doc_id, text); labels (doc_id, quality) of rows whose crc32(doc_id) mod 3
    isn't 1, of each class about `sample` rows with the smallest hashes. Labels other than 0 and 1 and null
    ids are left out; a document labelled twice counts as 1 if one label says so."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vectors)  # WORDS by DIMENSIONS
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    bar = lambda k: int(np.ceil((1 << 20) * min(1.0, sample / max(1, counts.get(k, 0)))))
    # ids of about two samples
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("quality") == 1, bar(1)).otherwise(bar(0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(near), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("at"), "text")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            if b.num_rows:
                x = [pooled(words(t.as_py()), held.value) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["quality", "at", "x"])

    got = rows.mapInArrow(pool, "quality int, at long, x array<double>").toArrow()  # about two samples of rows of FEATURES numbers
    y, at = got.column(0).to_numpy(), got.column(1).to_numpy()
    x = np.array(got.column(2).to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T[::-1], y, at)) if len(y) else np.zeros(0, int)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return Model(fit(x[order], y[order], min(max(share, 1e-3), 1 - 1e-3)), vectors)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any other columns) with score (0 to 1, higher: label 1 likelier) and predicted (1 if
    score >= 0.5).

    Null and empty texts have no words and are pooled as zeros. Whole texts are read, however long. Columns
    of docs named like those added are replaced. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in lean(batches):
            if b.num_rows:
                s = m.network.scores(np.array([pooled(words(t.as_py()), m.vectors) for t in b.column(at)]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, plus(docs.schema, "score double, predicted int"))
