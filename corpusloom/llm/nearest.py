"""Approximate nearest neighbours by stable projections indexed by a kd-tree.

Vectors of length one are projected to a few dimensions by a normal (2-stable) matrix: the squared
projected distance of two vectors, over their squared distance, is chi-square with as many degrees
of freedom. With d the k-th best true distance so far and r the least projected distance left, a
neighbour nearer than d is still left with a chance of at most 1 - F(r^2 / d^2); a search stops when
F(r^2 / d^2) reaches CONFIDENCE.

The kd-tree has two levels. The upper one, fitted on a bounded sample, divides the projected space into
cells; a cell's rows (dealt further where they are many, as in a hot spot) are shards. The lower one is
a tree in each shard, stored with it: leaves that the test rules out are skipped, the points of the others are
verified by true cosine in the order of their own projected distance, until the test holds. A query first
searches a shard of its own cell; the distance found there tells by the same test which cells are left to
search, so whole cells are skipped.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, written
from .hnsw import unit
from .vectors import cosines, matrix, usable

NEIGHBOURS = 5
DIMENSIONS = 32
CONFIDENCE = 0.97
#: Points of a leaf, and points that are verified between two tests.
LEAF, STEP = 64, 32
#: Rows of an index and of a block of queries, which meet in one task; fewer where rows take more bytes.
SHARD, QUERIES, MEETING_BYTES = 8192, 4096, 1 << 25
#: Rows of a length that the upper tree is fitted on, and its cells at most (their boxes are broadcast).
SAMPLE, CELLS = 1 << 16, 1 << 12
#: Distinct vectors kept for a query; where more tie with the last one, all that tie are looked at.
SPARE = 8
#: Products that differ by less may be equal cosines.
CLOSE = 1e-9


def chi_square(x: float, m: int) -> float:
    """Distribution function, for even m."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_inverse(p: float, m: int) -> float:
    low, high = 0.0, 100.0 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def _halves(p: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int], list[tuple[int, float, int, int]]]:
    """Rows in leaf order, limits of the leaves, and the splits (axis, value, low child, high child; a
    child of -1 - i is leaf i)."""
    order = np.arange(len(p))
    limits, splits = [0], []
    stack = [(0, len(p), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        axis = int(np.ptp(p[order[a:b]], axis=0).argmax()) if b - a > leaf else 0
        if b - a <= leaf or np.ptp(p[order[a:b], axis]) == 0:
            me = -len(limits)
            limits.append(b)
        else:
            rows = order[a:b]
            mid = (b - a) // 2
            order[a:b] = rows[np.argpartition(p[rows, axis], mid)]
            me = len(splits)
            splits.append([axis, float(p[order[a + mid], axis]), 0, 0])
            stack += [(a + mid, b, me, 3), (a, a + mid, me, 2)]
        if parent >= 0:
            splits[parent][side] = me
    return order, limits, [tuple(s) for s in splits]


class Cells:
    """The upper tree: which cell a projected point lies in."""

    def __init__(self, p: np.ndarray, cells: int):
        _, limits, self.splits = _halves(p, max(1, math.ceil(len(p) / max(1, cells))))
        self.n = len(limits) - 1

    def of(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        stack = [(0, np.arange(len(p)))] if self.splits else []
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, value, low, high = self.splits[node]
            left = p[rows, axis] < value
            stack += [(low, rows[left]), (high, rows[~left])]
        return out


class Tree:
    """kd-tree over projections: points in leaf order, leaf limits and bounding boxes."""

    def __init__(self, x: np.ndarray, order: np.ndarray, limits: np.ndarray, low: np.ndarray, high: np.ndarray):
        """x: unit rows in leaf order."""
        self.x, self.order, self.limits, self.low, self.high = x, order, limits, low, high

    @classmethod
    def build(cls, x: np.ndarray, projection: np.ndarray) -> Tree:
        p = x @ projection
        order, limits, _ = _halves(p, LEAF)
        p = p[order]
        spans = list(zip(limits, limits[1:], strict=False))
        return cls(x[order], order, np.array(limits), np.array([p[a:b].min(0) for a, b in spans]), np.array([p[a:b].max(0) for a, b in spans]))

    def nearest(self, q: np.ndarray, projection: np.ndarray, bound: float, k: int, floor: np.ndarray | None = None, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Rows (of the x built from) of the best found for each row of q, -1 for missing ones, their
        products, for queries of which more tie with the k-th than are kept all that do, and the
        number verified. floor: a product known to be reached k times elsewhere."""
        pq, width = q @ projection, k + spare
        out = np.full((len(q), width), -1)
        best = np.full((len(q), width), -np.inf)
        seen = np.zeros(len(q), np.int64)
        least = gaps(pq, self.low, self.high)
        floor = np.full(len(q), -np.inf) if floor is None else floor
        kth = floor.copy()
        p = self.x @ projection
        square = (p * p).sum(axis=1)
        leaf_of = np.repeat(np.arange(len(self.limits) - 1), np.diff(self.limits))
        for i in range(len(q)):

            def verify(at: np.ndarray) -> None:
                s, ids = np.concatenate([best[i], self.x[at] @ q[i]]), np.concatenate([out[i], self.order[at]])  # noqa: B023
                top = np.argpartition(-s, width - 1)[:width]
                best[i], out[i] = s[top], ids[top]  # noqa: B023
                kth[i] = max(floor[i], np.partition(best[i], spare)[spare])  # noqa: B023
                seen[i] += len(at)  # noqa: B023

            # the nearest leaf tells how far to look, then points go in the order of their projected distance
            first = int(least[i].argmin())
            if least[i, first] <= bound * (2 - 2 * kth[i]) + CLOSE:
                verify(np.arange(self.limits[first], self.limits[first + 1]))
            leaves = least[i] <= bound * (2 - 2 * kth[i]) + CLOSE
            leaves[first] = False
            points = np.flatnonzero(leaves[leaf_of])
            away = square[points] - 2 * (p[points] @ pq[i]) + pq[i] @ pq[i]
            near = away <= bound * (2 - 2 * kth[i]) + CLOSE
            points, away = points[near], away[near]
            by = np.argsort(away, kind="stable")
            points, away = points[by], away[by]
            for at in range(0, len(points), STEP):
                if away[at] > bound * (2 - 2 * kth[i]) + CLOSE:
                    break
                verify(points[at : at + STEP])
        ties = {}
        for i in np.flatnonzero((best.min(1) >= kth - CLOSE) & (best.min(1) > -np.inf)).tolist():
            there = np.flatnonzero(least[i] <= bound * (2 - 2 * kth[i]) + CLOSE)
            hit = [self.order[a:b][self.x[a:b] @ q[i] >= kth[i] - CLOSE] for a, b in zip(self.limits[there], self.limits[there + 1], strict=True)]
            ties[i] = np.concatenate(hit)
        return out, best, ties, seen


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(p), len(low)))
    for m in range(p.shape[1]):
        c = p[:, m : m + 1]
        out += np.maximum(0, np.maximum(low[:, m] - c, c - high[:, m])) ** 2
    return out


def projection(d: int, m: int) -> np.ndarray:
    return np.random.default_rng(d * 1000 + m).standard_normal((d, m))


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _index(pdf: pd.DataFrame, k: int, m: int) -> tuple[bytes, list[float], list[float]]:
    """A shard's tree over distinct vectors, of each the k + 1 smallest ids (no others can be results),
    and its box in the projected space."""
    pdf = pdf.sort_values("vec_id")
    x = matrix(pdf["embedding"])
    _, first, which = np.unique(x.view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(which[by], which[by])
    keep = by[place <= k]
    t = Tree.build(unit(x[first]), projection(x.shape[1], m))
    data = _pack(x=x[first], ids=pdf["vec_id"].to_numpy(np.int64)[keep], of=which[keep], order=t.order, limits=t.limits, low=t.low, high=t.high)
    return data, t.low.min(0).tolist(), t.high.max(0).tolist()


FOUND = "query_id long, vec_id long, score double, verified long"


def _search(index: bytes, names: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, m: int, bound: float) -> pd.DataFrame:
    z = np.load(io.BytesIO(index))
    x, ids, of, order = z["x"], z["ids"], z["of"], z["order"]
    tree = Tree(unit(x)[order], order, z["limits"], z["low"], z["high"])
    found, _, ties, seen = tree.nearest(unit(q), projection(x.shape[1], m), bound, k + 1, floor)
    start = np.searchsorted(of, np.arange(len(x) + 1))
    for i in ties:
        found[i] = -1
    rows, cols = np.nonzero(found >= 0)
    hit = found[rows, cols]
    score = cosines(q[rows], x[hit])
    for i, at in ties.items():
        # k + 1 vectors, best first, those of smaller ids before, hold all results
        s = cosines(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
        best = np.lexsort((ids[start[at]], -s))[: k + 1]
        rows, hit, score = np.append(rows, np.full(len(best), i)), np.append(hit, at[best]), np.append(score, s[best])
    n = start[hit + 1] - start[hit]
    rows, score, hit = np.repeat(rows, n), np.repeat(score, n), np.repeat(hit, n)
    member = ids[start[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
    other = member != names[rows]
    rows, score, member = rows[other], score[other], member[other]
    by = np.lexsort((member, -score, rows))
    by = by[(np.arange(len(by)) - np.searchsorted(rows[by], rows[by])) < k]
    # a row without a neighbour tells how many were verified for the query
    return pd.DataFrame({"query_id": np.append(names[rows[by]], names), "vec_id": pd.array([*member[by].tolist(), *[None] * len(names)], "Int64"), "score": np.append(score[by], np.full(len(names), np.nan)), "verified": np.append(np.zeros(len(by), np.int64), seen)})


def nearest_vectors(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score, verified: the k rows nearest to each query found, by cosine, and
    the number of distinct vectors that were verified for it.

    rows and queries have vec_id and embedding. A query's own vec_id is no candidate; ties go to
    the smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components,
    and null vec_ids, take no part; of rows that repeat a vec_id one is taken (the smallest hash of
    its vector). Vectors of different lengths aren't compared. Other columns are ignored; empty
    tables give no rows. Rows meet queries in blocks of bounded size, shard by shard.
    """
    spark = rows.sparkSession
    bound = chi_square_inverse(confidence, dimensions)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        good = df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        one = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min_by(v, F.xxhash64(v)).alias("embedding"))
        return one.withColumn("dim", F.size("embedding"))

    def most(of: int):
        return F.least(F.lit(of), F.greatest(F.lit(1), F.floor(F.lit(MEETING_BYTES) / (8 * F.col("dim")))))

    base = written(clean(rows), "vectors")
    asked = written(clean(queries), "queries")
    # one row a length; of each a sample by hash, whose projections tell the cells
    sizes = {r.dim: (r.n, r.cells) for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.first(most(shard))).alias("cells")).collect()}
    cells = {}
    for d, (n, wanted) in sizes.items():
        bar = math.ceil((1 << 30) * min(1.0, SAMPLE / n))
        part = base.where((F.col("dim") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < bar)).select("embedding")
        made = part.mapInPandas(lambda it: (pd.DataFrame({"p": (unit(matrix(t["embedding"])) @ projection(t["embedding"].map(len).iloc[0], dimensions)).tolist()}) for t in it if len(t)), "p array<double>")
        p = made.toArrow().column(0).to_pylist() if wanted > 1 else []
        cells[d] = Cells(np.array(p).reshape(-1, dimensions), min(int(wanted), CELLS, max(1, len(p) // 8)))
    held = spark.sparkContext.broadcast(cells)  # at most CELLS splits a length

    def placed(batches):
        for t in batches:
            out = np.zeros(len(t), np.int32)
            for d, part in t.groupby("dim"):
                if d in held.value:
                    at = t.index.get_indexer(part.index)
                    out[at] = held.value[d].of(unit(matrix(part["embedding"])) @ projection(d, dimensions))
            yield t.assign(cell=out)

    schema = "vec_id long, embedding array<double>, dim int, cell int"
    put = written(base.mapInPandas(placed, schema), "cells")
    drop(base)
    parts = put.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / most(shard)).cast("int").alias("parts"))
    parts = written(parts, "parts")
    dealt = put.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data, low, high = _index(pdf, k, dimensions)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "low": [low], "high": [high], "data": [data]})

    trees = written(dealt.groupBy("dim", "cell", "part").applyInPandas(index, "dim int, cell int, part int, low array<double>, high array<double>, data binary"), "trees")
    drop(put)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = pdf[pdf["data"].notna()]
        ask = pdf[pdf["data"].isna()]
        if not len(tree) or not len(ask):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        return _search(tree["data"].iloc[0], ask["vec_id"].to_numpy(np.int64), matrix(ask["embedding"]), ask["floor"].fillna(-np.inf).to_numpy(), k, dimensions, bound)

    def searched(wanted: DataFrame, tag: str) -> DataFrame:
        """wanted: vec_id, embedding, floor and the shard (dim, cell, part) each is sent to."""
        counts = wanted.groupBy("dim", "cell", "part").agg(F.ceil(F.count("*") / F.first(most(block))).cast("int").alias("blocks"))
        left = trees.join(counts, ["dim", "cell", "part"]).select("dim", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("floor"), "data")
        right = wanted.join(counts, ["dim", "cell", "part"]).select("dim", "cell", "part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks")).cast("int").alias("b"), "vec_id", "embedding", "floor", F.lit(None).cast("binary").alias("data"))
        return written(left.union(right).groupBy("dim", "cell", "part", "b").applyInPandas(meet, FOUND), tag)

    home = asked.mapInPandas(placed, schema).join(parts, ["dim", "cell"], "left")
    # a cell without rows, or a length without any, has no shard to begin with
    home = written(home.select("vec_id", "embedding", "dim", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "home")
    drop(asked)
    one = searched(home.withColumn("floor", F.lit(None).cast("double")), "first")
    far = one.where("vec_id is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    far = far.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("kth")).alias("floor"))
    # boxes of cells: at most CELLS a length
    box = trees.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high"))).groupBy("dim", "cell", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    boxes: dict[int, tuple] = {}
    for r in box.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("b")).orderBy("dim", "cell").collect():
        boxes.setdefault(r.dim, ([], [], []))
        for x, y in zip(boxes[r.dim], (r.cell, [v.low for v in r.b], [v.high for v in r.b]), strict=True):
            x.append(y)
    there = spark.sparkContext.broadcast({d: tuple(map(np.array, v)) for d, v in boxes.items()})

    def left_over(batches):
        for t in batches:
            at = np.empty(len(t), object)
            for i, (d, v, f) in enumerate(zip(t["dim"], t["embedding"], t["floor"], strict=True)):
                at[i] = []
                if d in there.value:
                    names, low, high = there.value[d]
                    reach = np.inf if math.isnan(f) else bound * (2 - 2 * f) + CLOSE
                    at[i] = names[gaps(unit(np.array([v], float)) @ projection(d, dimensions), low, high)[0] <= reach].tolist()
            yield t.assign(cells=at)

    ask = home.withColumnRenamed("cell", "own").withColumnRenamed("part", "own_part").join(far, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("nan"))))
    ask = ask.mapInPandas(left_over, "vec_id long, embedding array<double>, dim int, own int, own_part int, floor double, cells array<int>")
    ask = ask.select("*", F.explode("cells").alias("cell")).join(parts, ["dim", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ask = ask.where("not (cell = own and part = own_part)").select("vec_id", "embedding", F.nanvl("floor", F.lit(None).cast("double")).alias("floor"), "dim", "cell", "part")
    two = searched(written(ask, "asked"), "second")
    met = one.union(two)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.where("vec_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    looked = met.where("vec_id is null").groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return best.drop("verified").join(looked, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
