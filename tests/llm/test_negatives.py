import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives as N

from ..conftest import DATA


def plain_negatives(rows, ids, positives=5, negatives=3, scale=256):
    good = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, lab in sorted(good, key=lambda g: (g[0], g[2])):
        first.setdefault(i, (v, lab))
    out = []
    for a in sorted(set(ids) & set(first)):
        q, lab = first[a]
        scored = [(-sum(s * t for s, t in zip(q, v, strict=True)), i, k) for i, v, k in good if i != a and len(v) == len(q)]
        for place, (p, pid, _) in enumerate(sorted(s for s in scored if s[2] == lab)[:positives]):
            hits = sorted(s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(a, pid, place + 1, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(hits[:negatives])]
    return sorted(out)


def mined(spark, rows, ids, **how):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<double>, label int, score int, dim string")
    got = N.mine_negatives(df, spark.createDataFrame([(i,) for i in ids], "vec_id long"), **how).collect()
    return sorted((r.anchor_id, r.positive_id, r.positive_rank, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got), got


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_negatives_against_loops(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.6, 12)).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    ids = [*range(0, 900, 50), 5000]
    got, raw = mined(spark, rows, ids, anchor_bytes=block)
    assert got == plain_negatives(rows, ids) and got
    assert max(r.verified for r in raw) < 900


def test_negatives_of_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = lambda: rng.integers(-2, 3, 4).astype(float).tolist()
    rows = [(i, v(), i % 3) for i in range(200)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0], i % 2) for i in range(200, 320)]  # many that tie
    rows += [(0, v(), 2), (10, v(), 0), (10, [2.0, 2.0, 2.0, 2.0], 1), (None, v(), 1), (400, None, 1), (401, [None] * 4, 1), (402, [float("nan")] * 4, 1), (403, [float("inf")] * 4, 1), (404, v(), None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [1.0, 1.0], 0), (409, [0.0] * 4, 1)]
    # labels of anchors' doubles decide which is taken; keep them apart by label only
    ids = [0, 10, 210, 400, 404, 406, 409]
    assert mined(spark, rows, ids)[0] == plain_negatives(rows, ids)


def test_negatives_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** float(rng.integers(0, 6))).tolist(), i % 3) for i in range(120)]
    ids = list(range(0, 120, 10))
    assert mined(spark, rows, ids)[0] == plain_negatives(rows, ids)
    huge = [(i, [1e200 * (i + 1), 1.0], i % 2) for i in range(12)]
    assert mined(spark, huge, [0, 1])[0] is not None


def test_negatives_of_nothing(spark):
    assert mined(spark, [], [1])[0] == []
    assert mined(spark, [(1, [1.0], 1)], [])[0] == []
    assert mined(spark, [(1, [1.0], 1)], [1])[0] == []


def test_intervals_hold_the_products():
    rng = np.random.default_rng(7)
    x = N.whole(rng.normal(0, 0.2, (500, 30)), 256)
    books = N.trained(x)
    code, left = N.encoded(x, books)
    q = N.whole(rng.normal(0, 0.2, (40, 30)), 256)
    low, high = N.Anchors(np.arange(40), np.zeros(40), q).intervals(np.arange(40), books, code, left)
    true = q @ x.T
    assert (low <= true).all() and (true <= high).all()


def test_windows():
    for s in range(-300, 300):
        low, high = N.window(s, 50, 95)
        assert [n for n in range(-400, 400) if 50 * s <= 100 * n <= 95 * s] == list(range(low, high + 1))


def test_verified_share_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = N.mine_negatives(rows, rows.where("vec_id % 50 = 0")).groupBy("anchor_id").agg(F.first("verified").alias("n")).agg(F.avg("n")).first()[0]
    assert got < 0.6 * rows.count()
