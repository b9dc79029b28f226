"""Language identification by multilingual mixture inference.

A document's n-grams are drawn from a mixture of languages. Expectation-maximisation estimates the
proportions from the n-grams' likelihoods under each language; nested sets of languages, most
probable first, are compared by their likelihood less a penalty for each further language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, plus

#: Training takes about this many documents of a language, picked by a hash of doc_id.
SAMPLE = 2000
BINS = 1 << 15
#: A training task hands its counts on when it holds so many.
HELD = 1 << 20
#: Expectation-maximisation ends when no proportion moves by more than this, or after so many rounds of two steps.
STILL, ROUNDS = 1e-4, 250
#: What a language must promise to be let in (1: nothing), and the share that new ones start with.
GAIN, NEW = 1e-4, 0.2
#: A further language must raise the log-likelihood by this many times log(n-grams) and have this share.
PENALTY, LEAST_SHARE = 12.0, 0.1
UNKNOWN = "und"
#: Added to each count, so that no trigram is impossible.
SMOOTH = 0.5


def bins(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased letters, runs of anything else as one space."""
    import regex

    flat = regex.sub(r"[^\p{L}\p{M}]+", " ", f" {text.lower()} ")
    b = np.frombuffer(flat.encode(), np.uint8).astype(np.uint32)
    g = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15), minlength=BINS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Smoothed trigram counts of every language, only those seen: bin i's are starts[i] to starts[i + 1]."""

    langs: list[str]
    starts: np.ndarray
    lang: np.ndarray
    count: np.ndarray
    total: np.ndarray  # a language's counts with SMOOTH for each bin

    def typical(self) -> np.ndarray:
        """Mean log-likelihood of a trigram in text of each language."""
        base = SMOOTH / self.total
        p = (self.count + SMOOTH) / self.total[self.lang]
        seen = np.bincount(self.lang, minlength=len(base))
        return np.bincount(self.lang, p * np.log(p), len(base)) + (BINS - seen) * base * np.log(base)

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float], float | None]:
        """Language, score, the set chosen and its proportions, largest first, and the fit: the mean
        log-likelihood of the text's trigrams in its best language, where 1 is that of the language's
        own text and 0 that of trigrams never seen in it."""
        if not has_letter(text) or not self.langs:
            return UNKNOWN, 0.0, [], [], None
        if not hasattr(self, "_typical"):
            self._typical = self.typical()
        c = bins(text)
        at = np.flatnonzero(c)
        c = c[at].astype(float)
        n = c.sum()
        # probability of a bin in a language: what all bins have, and more where it was seen
        base = SMOOTH / self.total
        sizes = self.starts[at + 1] - self.starts[at]
        row = np.repeat(np.arange(len(at)), sizes)
        held = np.arange(len(row)) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        col = self.lang[held]
        more = self.count[held] / self.total[col]
        single = n * np.log(base) + np.bincount(col, c[row] * np.log1p(more / base[col]), len(base))
        share = self._shares(c, row, col, base, more, int(np.argmax(single)))
        order = np.lexsort((np.arange(len(share)), -share))
        order = order[share[order] >= LEAST_SHARE]
        p = _columns(order, len(c), row, col, base, more)
        best = int(np.argmax(single))
        chosen, value, parts = [best], single[best], np.ones(1)
        for k in range(2, len(order) + 1):
            s, ll = _em(p[:, :k], c, share[order[:k]] / share[order[:k]].sum())
            if ll - PENALTY * (k - 1) * math.log(n + 1) > value and s.min() >= LEAST_SHARE:
                chosen, value, parts = list(order[:k]), ll - PENALTY * (k - 1) * math.log(n + 1), s
        rank = np.argsort(-parts, kind="stable")
        chosen, parts = [chosen[i] for i in rank], parts[rank]
        return self.langs[chosen[0]], float(min(1.0, share[chosen[0]])), [self.langs[i] for i in chosen], parts.tolist(), float((single[best] / n - math.log(base[best])) / (self._typical[best] - math.log(base[best])))

    @staticmethod
    def _shares(c: np.ndarray, row: np.ndarray, col: np.ndarray, base: np.ndarray, more: np.ndarray, best: int) -> np.ndarray:
        """Every language's proportion. The likelihood is concave, so languages that can't raise it have none: from
        the best single language on, those that can are let in and the proportions fitted anew, until no other can."""
        n, chosen, part = c.sum(), np.array([best]), np.ones(1)
        while True:
            p = _columns(chosen, len(c), row, col, base, more)
            if len(chosen) > 1:
                part, _ = _em(p, c, part)
            r = c / (p @ part)
            gain = (base * r.sum() + np.bincount(col, more * r[row], len(base))) / n
            gain[chosen] = 0
            new = np.flatnonzero(gain > 1 + GAIN)
            if not len(new):
                break
            chosen = np.concatenate([chosen, new])
            part = np.concatenate([part * (1 - NEW), np.full(len(new), NEW / len(new))])
        out = np.zeros(len(base))
        out[chosen] = part
        return out


def _columns(langs: np.ndarray, n: int, row: np.ndarray, col: np.ndarray, base: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Probabilities of a document's bins in some languages."""
    place = np.full(len(base), -1)
    place[langs] = np.arange(len(langs))
    known = place[col] >= 0
    p = np.tile(base[langs], (n, 1))
    p[row[known], place[col[known]]] += more[known]
    return p


def _em(p: np.ndarray, c: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture of p's columns, by expectation-maximisation. From two steps
    the way ahead is extrapolated (squared iterative steps), which counts only where the likelihood gains by it."""
    n = c.sum()
    step = lambda s: s * (p.T @ (c / (p @ s))) / n
    value = lambda s: float(c @ np.log(p @ s))
    for _ in range(ROUNDS):
        one = step(share)
        two = step(one)
        if np.abs(two - one).max() < STILL and np.abs(one - share).max() < STILL:
            share = two
            break
        r, v = one - share, two - 2 * one + share
        size = np.sqrt(v @ v)
        a = max(1.0, np.sqrt(r @ r) / size) if size > 0 else 1.0
        far = share + 2 * a * r + a * a * v
        if a > 1 and far.min() > 0 and value(far / far.sum()) >= value(two):
            two = far / far.sum()
        share = two
    return share, value(share)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from docs (doc_id, text, lang), rows with null lang or crc32(doc_id) mod 4 = 2 excepted."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(BINS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    rate = spark.createDataFrame([(k, i, math.ceil((1 << 20) * min(1.0, sample / counts[k]))) for i, k in enumerate(langs)], "lang string, no int, bar long")
    picked = known.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("bar")).select("no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        held = 0

        def sums() -> pa.RecordBatch:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.round(np.bincount(at, np.concatenate(weights)) * 1000).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((k // BINS).astype(np.int32)), pa.array((k % BINS).astype(np.int32)), pa.array(n)], ["no", "bin", "n"])

        for b in lean(batches):
            for no, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if has_letter(text):
                    # of equal weight, so that one long document isn't a language
                    c = bins(text)
                    at = np.flatnonzero(c)
                    keys.append(no * BINS + at)
                    weights.append(c[at] * (1000 / max(1000, c.sum())))
                    held += len(at)
                    if held >= HELD:
                        yield sums()
                        keys, weights, held = [], [], 0
        if held:
            yield sums()

    got = picked.mapInArrow(count, "no int, bin int, n long").groupBy("no", "bin").agg(F.sum("n").alias("n")).toArrow()  # trigrams seen, by language
    no, at, n = (got.column(i).to_numpy() for i in range(3))
    order = np.lexsort((no, at))
    no, at, n = no[order], at[order], n[order] / 1000
    starts = np.searchsorted(at, np.arange(BINS + 1)).astype(np.int64)
    return Model(langs, starts, no.astype(np.int32), n.astype(np.float32), SMOOTH * BINS + np.bincount(no, n, len(langs)))


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any other columns) with lang_pred, score, langs (the set chosen), shares and fit
    (near 1 for text like that learned from, near 0 for text of no learned language).

    Null texts and texts without a letter are `und` with score 0, an empty set and null fit. Whole texts are
    read. Columns of docs named like those added are replaced. An empty table gives no rows; without
    training rows every row is `und`.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # the trigrams each language was seen with
    docs = docs.drop("lang_pred", "score", "langs", "shares", "fit")
    at = docs.columns.index("text")

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            if b.num_rows:
                found = [held.value.infer(t.as_py()) for t in b.column(at)]
                cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "lang_pred", "score", "langs", "shares", "fit"])

    return docs.mapInArrow(infer, plus(docs.schema, "lang_pred string, score double, langs array<string>, shares array<double>, fit double"))
