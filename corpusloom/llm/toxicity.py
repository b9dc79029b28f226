"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately, one on windows of toxic and one on windows of
ordinary text. A window is a word with its spaces (long ones are cut into overlapping pieces), each
byte written twice, so that a match is worth more than what telling its place costs. What a
dictionary holds are the windows that recur in documents of its class, the most frequent ones last,
where places cost least; the library's trainer provides the entropy tables. (The trainer's own choice
of content leaves out recurring words at random, and then the lengths differ for no reason.)

Every window of a text is compressed with either dictionary. It is evidence if the toxic dictionary
takes no more than KNOWN bytes (it holds the window as a whole) and the ordinary one more than that.
This threshold and the weights of the evidence in a document (the largest differences, how many
exceed each of CLEAR, out of how many) are calibrated on folds, each compressed with dictionaries of
the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, plus, released

#: Training takes at most so many toxic and ordinary rows, of texts up to so many characters.
SAMPLE, ORDINARY, SAMPLE_CHARS = 2000, 4000, 20_000
FOLDS = 3
#: Longer words are cut into pieces of so many bytes that overlap by half.
PIECE = 24
#: A dictionary holds windows that recur in so many documents of its class, or in this share of them.
TOXIC_DOCS, TOXIC_SHARE = 4, 0.006
ORDINARY_DOCS, ORDINARY_SHARE = 3, 0.0008
#: Sizes, which only the rarest of very many windows exceed.
TOXIC_BYTES, ORDINARY_BYTES = 1 << 18, 1 << 21
#: Bytes over the least possible that a window held as a whole may take; the best one is calibrated.
KNOWN = (0, 1, 2, 3)
CLEAR = (2, 4, 6, 8)
FEATURES = 4 + 2 * len(CLEAR)
#: Windows whose lengths a worker remembers (about 120 bytes each).
CACHE = 300_000

#: What opens a dictionary in the public zstandard format.
MAGIC = bytes([0x37, 0xA4, 0x30, 0xEC])

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, long ones in pieces; one empty window where there is none."""
    out = []
    for w in _WORD.findall((text or "").encode().lower()):
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out or [b""]


def _twice(window: bytes) -> bytes:
    out = bytearray(2 * len(window) + 4)
    out[::2] = out[1::2] = b" " + window + b" "
    return bytes(out)


class _Seen:
    """Hashes met so far, eight bytes each: sorted arrays whose sizes at least double from one to the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def fresh(self, hashes: np.ndarray) -> np.ndarray:
        """Those of some distinct hashes that weren't met yet; all are met from now on."""
        new = hashes
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, new), len(level) - 1)
            new = new[level[at] != new]
        if len(new):
            last = np.sort(new)
            while self.levels and len(self.levels[-1]) < 2 * len(last):
                last = np.sort(np.concatenate([self.levels.pop(), last]))
            self.levels.append(last)
        return new


def distinct(docs: Iterable[list[bytes]]) -> list[list[bytes]]:
    """Without those half of whose three-window runs stood in earlier ones: copies lend weight to chance. Documents come
    one at a time and share the windows that are equal, so that copies and frequent words take no room."""
    seen, one = _Seen(), {}
    out = []
    for d in docs:
        runs = np.unique(np.fromiter((hash(tuple(d[i : i + 3])) for i in range(max(1, len(d) - 2))), np.int64))
        if 2 * len(seen.fresh(runs)) >= len(runs):
            out.append([one.setdefault(w, w) for w in d])
    return out


def trained(docs: list[list[bytes]], least: int, share: float, size: int) -> bytes:
    """A dictionary of the windows that recur in docs, in the public zstandard format: the trainer's
    magic number, id and entropy tables, which end with the three repeat offsets 1, 4 and 8, then
    content. Where samples are too few for the trainer (some thousand bytes), only the content."""
    import zstandard

    in_docs = Counter(w for d in docs for w in set(d))
    least = max(least, math.ceil(share * len(docs)))
    content = b"".join(_twice(w) for w in sorted((w for w, n in in_docs.items() if n >= least), key=lambda w: (in_docs[w], w)))[-size:]
    content = content.rjust(8)
    samples = [_twice(w) for d in docs[:: max(1, len(docs) // 100)] for w in sorted(set(d))]
    try:
        made = zstandard.train_dictionary(1 << 14, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return content
    return made[: made.index(np.array([1, 4, 8], "<u4").tobytes(), 8) + 12] + content


def _compressor(dictionary: bytes):
    import zstandard as z

    p = z.ZstdCompressionParameters(window_log=21, chain_log=20, hash_log=18, search_log=8, min_match=4, target_length=64, strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    kind = z.DICT_TYPE_FULLDICT if dictionary[:4] == MAGIC else z.DICT_TYPE_RAWCONTENT
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary, dict_type=kind), compression_params=p).compress


class Distance(dict):
    """window -> its length with the ordinary dictionary times 65,536, and its length with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def __missing__(self, window: bytes) -> int:
        w = _twice(window)
        out = len(self.ordinary(w)) << 16 | len(self.toxic(w))
        if len(self) >= CACHE:
            self.clear()
        self[window] = out
        return out

    def lengths(self, text: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text), np.int64, len(text))


def _distance(toxic: bytes, ordinary: bytes) -> Distance:
    """One for a worker process and model, as loading a dictionary takes as long as many documents."""
    here = kept("toxicity")
    if here.get("of") != (toxic, ordinary):
        here.update({"of": (toxic, ordinary), "distance": Distance(toxic, ordinary)})
    return here["distance"]


def features(lengths: np.ndarray, known: int) -> np.ndarray:
    """The three largest differences of windows the toxic dictionary holds (-1 for missing ones), how
    many are clear, which share of all, log of all. Sums and shares are taken over the whole text."""
    n = len(lengths)
    held = lengths[(lengths & 0xFFFF) <= known]
    hits = (held >> 16) - (held & 0xFFFF)
    hits = np.sort(hits[hits > -1])[::-1]
    counts = np.array([(hits >= k).sum() for k in CLEAR])
    out = np.full(FEATURES, -1.0)
    out[: min(3, len(hits))] = hits[:3]
    out[3 : 3 + len(CLEAR)] = np.minimum(8, np.log1p(counts))
    out[3 + len(CLEAR) : -1] = np.sqrt(counts / n)
    out[-1] = math.log1p(n)
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    known: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def scores(self, found: np.ndarray) -> np.ndarray:
        x = (found - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale and weights of a logistic regression, and its loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return mean, scale, w, float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() + (ridge * w * w).sum() / 2)


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """From texts of both classes; share: of toxic rows among all labelled ones. Without texts of a
    class every score is that of the other."""
    if not toxic or not ordinary:
        w = np.zeros(FEATURES + 1)
        w[-1] = 30.0 if toxic else -30.0
        return Model(bytes(8), bytes(8), 0, np.zeros(FEATURES), np.ones(FEATURES), w)
    hot, usual = (distinct(windows(t) for t in texts) for texts in (toxic, ordinary))
    make = lambda a, b: (trained(a, TOXIC_DOCS, TOXIC_SHARE, TOXIC_BYTES), trained(b, ORDINARY_DOCS, ORDINARY_SHARE, ORDINARY_BYTES))
    got, y = [], []
    for k in range(FOLDS):
        others = lambda x: [t for i, t in enumerate(x) if i % FOLDS != k] or x  # noqa: B023, E731
        d = Distance(*make(others(hot), others(usual)))
        for label, docs in ((1.0, hot[k::FOLDS]), (0.0, usual[k::FOLDS])):
            got += [d.lengths(t).astype(np.int32) for t in docs]
            y += [label] * len(docs)
    least = min(int((x & 0xFFFF).min()) for x in got)
    target = np.array(y)
    weight = np.where(target == 1, share / len(hot), (1 - share) / len(usual)) * len(y)
    tried = []
    for more in KNOWN:
        mean, scale, w, loss = _logistic(np.array([features(x, least + more) for x in got]), target, weight)
        tried.append((loss, more, mean, scale, w))
    _, more, mean, scale, w = min(tried, key=lambda t: t[:2])
    return Model(*make(hot, usual), least + more, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> Model:
    """Learns from docs (doc_id, text) with labels (doc_id, toxic), except rows whose crc32(doc_id) mod 5
    is 0: of each class the rows with the smallest hashes, which lie evenly over the corpus."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    most = {1: sample, 0: ordinary}
    # some of the rows may be too long or missing
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, _bar(sample, counts.get(1, 0))).otherwise(_bar(ordinary, counts.get(0, 0))))
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(near, "doc_id").withColumn("order", F.xxhash64("doc_id", "text"))
    got = {k: [r.text for r in rows.where(F.col("toxic") == k).orderBy("order", "text").limit(most[k]).collect()] for k in (1, 0)}
    try:
        return fit(got[1], got[0], min(max(share, 1e-3), 1 - 1e-3))
    finally:  # the driver's process lives on
        got.clear()
        released()


def _bar(sample: int, count: int) -> int:
    return math.ceil((1 << 20) * min(1.0, 1.2 * sample / max(count, 1)))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any other columns) with score (0 to 1), predicted (1 if score >= 0.5) and
    top_saving, the largest difference of a window that the toxic dictionary holds (-1: none).

    Null and empty texts are one empty window. Whole texts are read, however long. Columns of docs
    named like those added are replaced. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # two dictionaries of bounded sizes and a few numbers
    docs = docs.drop("score", "predicted", "top_saving")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        d = _distance(m.toxic, m.ordinary)
        for b in lean(batches):
            if b.num_rows:
                x = np.array([features(d.lengths(windows(t.as_py())), m.known) for t in b.column(at)])
                s = m.scores(x)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 0])], [*b.schema.names, "score", "predicted", "top_saving"])

    return docs.mapInArrow(score, plus(docs.schema, "score double, predicted int, top_saving double"))
