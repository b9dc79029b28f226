import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q

from ..conftest import DATA


def test_words():
    text = "Ab, cd!! é%% 9x\tz \n|"
    want = ["Ab", ",", "cd", "!!", "é", "%%", "9x", "z", "|"]
    assert Q.words(text).tolist() == [zlib.crc32(w.encode()) % Q.WORDS for w in want]
    assert len(Q.words(None)) == len(Q.words("")) == len(Q.words(" \n")) == 0


def plain_sums(docs):
    index = Q.index_vectors().astype(int)
    out = {}
    for d in docs:
        for i, w in enumerate(d):
            out.setdefault(w, np.zeros(Q.DIMENSIONS, int))
            for j in range(max(0, i - Q.NEAR), min(len(d), i + Q.NEAR + 1)):
                if j != i:
                    out[w] += index[d[j]]
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 17])
def test_context_sums_against_loops(monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, n) for n in (0, 1, 2, 3, 50, 200, 5)]
    c = Q.Contexts()
    for d in docs:
        c.add(d)
    at, sums = c.sums()
    want = plain_sums([d.tolist() for d in docs])
    assert sorted(want) == at.tolist() and all((want[w] == s).all() for w, s in zip(at.tolist(), sums, strict=True))


def plain_pool(doc, vectors):
    if not len(doc):
        return [0.0] * Q.FEATURES
    v = vectors[doc].astype(float)
    out = [*v.mean(axis=0), *v.std(axis=0)]
    for k in Q.APART:
        alike = [float(v[i] @ v[i + k]) for i in range(len(doc) - k)]
        if not alike:
            out += [0, 0, 0]
            continue
        starts = list(range(0, max(1, len(alike) - Q.STRETCH // 2), Q.STRETCH))
        means = [np.mean(alike[a:b]) for a, b in zip(starts, [*starts[1:], len(alike)], strict=True)]
        out += [np.mean(alike), min(means), max(means)]
    return [*out, np.log1p(len(doc))]


@pytest.mark.parametrize("block", [5, 1 << 17])
def test_pooling_against_loops(monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = Q.unit(rng.normal(0, 1, (Q.WORDS, Q.DIMENSIONS))).astype(np.float32)
    for n in (0, 1, 2, 4, 23, 36, 37, 300):
        doc = rng.integers(0, Q.WORDS, n)
        assert np.allclose(Q.pooled(doc, vectors), plain_pool(doc, vectors), atol=2e-4)


def test_temperature_is_the_best_divisor():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    assert abs(Q._temperature(3 * z, y, np.ones(4000)) - 3) < 0.3


def test_held_out_quality(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.score_quality(docs.select("doc_id", "text"), Q.train(docs, labels)).join(labels, "doc_id").where("quality is not null")
    held = [(r.quality, r.score, r.predicted) for r in out.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()]
    good, bad = [s for q, s, _ in held if q == 1], [s for q, s, _ in held if q == 0]
    assert len(bad) > 5 and np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([q == p for q, _, p in held]) > 0.95
    assert all((p == 1) == (s >= 0.5) and 0 <= s <= 1 for _, s, p in held)


ODD = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "x" * 100_000), (4, "x y"), (4, "x y"), (5, "word " * 50_000), (6, "😀 ok")]


def test_odd_rows(spark):
    texts = [t for _, t in ODD[:-1]] + ["\U0001f600 ok"]
    docs = spark.createDataFrame([(i, t, "s", 3) for (i, _), t in zip(ODD, texts, strict=True)], "doc_id long, text string, score string, x int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (5, 0), (None, 1), (6, None), (6, 5), (77, 1)], "doc_id long, quality int")
    got = Q.score_quality(docs, Q.train(docs, labels))
    assert got.columns == ["doc_id", "text", "x", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert got.limit(0).count() == 0


def test_labels_of_one_class_and_none(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string")
    for labels, want in (([(i, 1) for i in range(20)], 1), ([(i, 0) for i in range(20)], 0)):
        out = Q.score_quality(docs, Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
        assert {r.predicted for r in out} == {want}
    none = Q.score_quality(docs, Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert {r.score for r in none} == {0.5}
    empty = Q.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score_quality(docs.limit(0), empty).count() == 0


def test_patterns_match_bytes_of_any_text():
    for t in ("été ça", "日本 語", "a\x0bb"):
        n = len(re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", t))
        assert len(Q.words(t)) == n
