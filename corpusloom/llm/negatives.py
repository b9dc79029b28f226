"""Hard negatives by product quantisation with stored residual norms.

A vector is stored as one code for each part and, for each part, the norm of what its code leaves
over. The inner product of an anchor with it is the sum of looked-up products of the anchor's parts with
the codes' entries, give or take at most the sum over the parts of the anchor's norm times the residual's.
What this interval keeps out of reach, of an anchor's nearest rows or of its windows, is never looked at
again; all else is ranked by the exact whole-number product.

Anchors are read in blocks of bounded bytes and broadcast; each block passes over the stored table twice, for
the positives and, as their scores tell the windows, for the negatives. A task keeps the best of its rows for
each anchor, and only these are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import drop_path
from .common import drop, lean, new_path, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Components of a part, entries of a part's codebook, rounds and rows of a length that codebooks are fitted on.
#: (With 8, 4 and 2 components a part 82 %, 31 % and 3 % of 10,000 given rows are in reach of an anchor's windows.)
COMPONENTS, ENTRIES, ROUNDS, SAMPLE = 2, 256, 8, 1 << 14
#: Bytes of a broadcast block of anchors; anchors and rows that meet at once (what a few rows reach keeps out many of
#: the next ones).
ANCHOR_BYTES, ANCHORS, ROWS = 1 << 25, 128, 512
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x * float(scale))


def spans(d: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    return [(a, min(d, a + COMPONENTS)) for a in range(0, d, COMPONENTS)]


def trained(x: np.ndarray) -> list[np.ndarray]:
    """A codebook for each part, by k-means from rows spread over x."""
    out = []
    for a, b in spans(x.shape[1]):
        part = x[:, a:b]
        c = np.unique(part[np.linspace(0, len(x) - 1, min(ENTRIES, len(x))).astype(int)], axis=0)
        for _ in range(ROUNDS):
            code = nearest(part, c)
            n = np.bincount(code, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, code, part)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), ROWS):
        out[i : i + ROWS] = np.argmax(x[i : i + ROWS] @ c.T - half, axis=1)
    return out


def encoded(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms, rows by parts; norms are rounded up."""
    code, left = np.empty((len(x), len(books)), np.uint8), np.empty((len(x), len(books)), np.float32)
    for m, ((a, b), c) in enumerate(zip(spans(x.shape[1]), books, strict=True)):
        code[:, m] = nearest(x[:, a:b], c)
        with np.errstate(over="ignore", invalid="ignore"):
            left[:, m] = np.nextafter(np.sqrt(((x[:, a:b] - c[code[:, m]]) ** 2).sum(axis=1)).astype(np.float32), np.float32(np.inf))
    return code, left


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, exact; beyond 64 bits the nearest whole number of 64 bits."""
    if not len(q):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array([max(-LONG, min(LONG, s)) for s in sums], np.int64)


class Best:
    """The k best (score, name) for each of n places, higher scores first, then smaller names."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.name = np.full((n, k), -LONG - 1), np.full((n, k), LONG)

    def floor(self) -> np.ndarray:
        """What a score must reach to count."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        touched = np.unique(at)
        if not len(touched):
            return
        at = np.concatenate([at, np.repeat(touched, self.k)])
        score, name = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([name, self.name[touched].ravel()])
        by = np.lexsort((name, ~score, at))  # ~x falls as x rises
        at, score, name = at[by], score[by], name[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.score[at[keep], place[keep]], self.name[at[keep], place[keep]] = score[keep], name[keep]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.name < LONG)
        return at, self.score[at, place], self.name[at, place]


class Anchors:
    """A block of anchors of one length: names, labels, whole-number vectors, windows if they are known."""

    def __init__(self, names: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.names, self.labels, self.q, self.low, self.high = names, labels, q, low, high
        with np.errstate(over="ignore"):
            self.norms = np.sqrt(np.stack([(q[:, a:b] ** 2).sum(axis=1) for a, b in spans(q.shape[1])], axis=1))

    def intervals(self, at: np.ndarray, books: list[np.ndarray], code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the products of the anchors `at` with coded rows."""
        with np.errstate(all="ignore"):
            told = np.zeros((len(at), len(code)))
            for m, ((a, b), c) in enumerate(zip(spans(self.q.shape[1]), books, strict=True)):
                told += (self.q[at, a:b] @ c.T)[:, code[:, m]]
            reach = self.norms[at] @ left.T.astype(np.float64)
            # more than double precision can be off by
            reach = reach * (1 + 1e-9) + 1e-9 * (1 + np.abs(told)) + 1e-12 * self.norms[at].sum(axis=1)[:, None] * sum(float(np.abs(c).max()) * c.shape[1] for c in books if len(c))
            low, high = told - reach, told + reach
        bad = ~(np.isfinite(low) & np.isfinite(high))
        low[bad], high[bad] = -np.inf, np.inf
        return low, high


def search_positives(anchors: Anchors, best: Best, books: list[np.ndarray], names: np.ndarray, labels: np.ndarray, x: np.ndarray, code: np.ndarray, left: np.ndarray) -> int:
    """Adds the rows of an anchor's label to its best; how many were scored."""
    seen = 0
    for label in np.intersect1d(labels, anchors.labels).tolist():
        rows, asked = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
        for i in range(0, len(asked), ANCHORS):
            at = asked[i : i + ANCHORS]
            low, high = anchors.intervals(at, books, code[rows], left[rows])
            own = anchors.names[at][:, None] == names[rows][None, :]
            low[own], high[own] = -np.inf, -np.inf
            floor = best.floor()[at].astype(float)
            if len(rows) > best.k:  # so many rows reach at least that
                floor = np.maximum(floor, np.partition(low, len(rows) - best.k, axis=1)[:, len(rows) - best.k])
            a, r = np.nonzero((high >= floor[:, None]) & ~own)
            seen += len(a)
            best.add(at[a], products(anchors.q[at[a]], x[rows[r]]), names[rows[r]])
    return seen


def search_windows(anchors: Anchors, best: list[Best], seen: np.ndarray, books: list[np.ndarray], names: np.ndarray, labels: np.ndarray, x: np.ndarray, code: np.ndarray, left: np.ndarray) -> None:
    """Adds rows of other labels to the best of each window, and counts those scored in seen."""
    for i in range(0, len(anchors.names), ANCHORS):
        at = np.arange(i, min(i + ANCHORS, len(anchors.names)))
        low, high = anchors.intervals(at, books, code, left)
        # of the windows that aren't empty, what a row must reach and what it may at most
        open_ = anchors.low[at] <= anchors.high[at]
        floor = np.where(open_, np.maximum(anchors.low[at], np.stack([b.floor()[at] for b in best], axis=1)), LONG).min(axis=1).astype(float)
        roof = np.where(open_, anchors.high[at], -LONG).max(axis=1).astype(float)
        a, r = np.nonzero((high >= floor[:, None]) & (low <= roof[:, None]) & (anchors.labels[at][:, None] != labels[None, :]) & (anchors.names[at][:, None] != names[None, :]))
        score = products(anchors.q[at[a]], x[r])
        seen += np.bincount(at[a], minlength=len(seen))
        for w, b in enumerate(best):
            hit = (score >= anchors.low[at[a], w]) & (score <= anchors.high[at[a], w])
            b.add(at[a][hit], score[hit], names[r[hit]])


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole number n with low * score <= 100 * n <= high * score."""
    return max(-LONG, min(LONG, -(-low * score // 100))), max(-LONG, min(LONG, high * score // 100))


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: of two-byte numbers where they fit, else of doubles."""
    small = (np.abs(x).max(axis=1) < 1 << 15) if x.size else np.ones(len(x), bool)
    return [(r.astype("<i2") if s else r.astype("<f8")).tobytes() for r, s in zip(x, small, strict=True)]


def _unpacked(rows: list[bytes], d: int) -> np.ndarray:
    if all(len(r) == 2 * d for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, d).astype(np.float64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * d else "<f8").astype(np.float64) for r in rows]).reshape(-1, d)


STORED = "vec_id long, label long, dim int, x binary, code binary, left binary"
FOUND = "anchor_id long, place int, name long, score long"


def stored(rows: DataFrame, scale: int = SCALE, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """The coded table of rows (vec_id, embedding, label) and the codebooks of each vector length, fitted on
    about `sample` rows of a length picked by a hash; every row is coded."""
    spark = rows.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    # what isn't finite once it is scaled neither
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * float(scale) == float("inf")))).withColumn("dim", F.size("v"))
    counts = good.groupBy("dim").agg(F.count("*").alias("n"))
    near = good.join(F.broadcast(counts), "dim").where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 30))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(r) for r in pdf["v"]]).sort_values(["vec_id", "key"])
        books = trained(whole(np.array(pdf["v"].tolist(), np.float64), scale))
        return pd.DataFrame({"dim": [len(pdf["v"].iloc[0])], "books": [[b.ravel().tolist() for b in books]]})

    books = {r["dim"]: [np.array(b).reshape(-1, e - a) for b, (a, e) in zip(r["books"], spans(r["dim"]), strict=True)] for r in near.select("dim", "vec_id", "v").groupBy("dim").applyInPandas(train, "dim int, books array<array<double>>").collect()}
    held = spark.sparkContext.broadcast(books)  # ENTRIES rows of each length

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches, ROWS):
            dims = b.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                x = whole(b.column(2).take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), scale)
                # a length whose sample is empty has codebooks of zeros
                known = held.value.get(d) or [np.zeros((1, e - a)) for a, e in spans(d)]
                code, left = encoded(x, known)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(_packed(x), pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in left], pa.binary())], [c.split()[0] for c in STORED.split(", ")])

    return written(good.select("vec_id", "label", "v", "dim").mapInArrow(encode, STORED), "coded"), books


def mine_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score, verified.

    rows have vec_id, embedding and label; anchors a vec_id: rows with one of these are anchors. Scores are
    inner products of floor(scale * x). An anchor's positives are its best rows of the same label, its
    negatives for a positive of score s the best rows of other labels with scores from low to high percent of
    s. Ties go to smaller vec_ids. verified: rows scored exactly for an anchor's windows. Rows with null vec_id,
    label or vector, an empty vector, or a component that is null or not finite take no part; rows of
    different lengths don't meet; of anchors that share a vec_id one is taken (the smallest label, then bytes),
    other repeated rows each count, and a row with the anchor's vec_id is never its positive or negative.
    Scores beyond 64 bits count as the largest number of 64 bits. Empty tables give no rows.
    """
    spark = rows.sparkSession
    table, books = stored(rows, scale)
    held_books = spark.sparkContext.broadcast(books)
    asked = table.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    one = written(asked.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "x")).alias("r")).select("vec_id", "r.*"), "asked")
    n, size = one.agg(F.count("*"), F.coalesce(F.sum(F.length("x") + 8 * F.col("dim")), F.lit(0))).first()
    blocks = max(1, math.ceil(size / anchor_bytes))
    path = new_path(spark, "anchors")
    one.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    drop(one)
    out = new_path(spark, "negatives")

    def meet(held, names: list[str], windows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[int, tuple] = {}
            for b in lean(batches, ROWS):
                dims = b.column(2).to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in held.value:
                        continue
                    a = held.value[d]
                    if d not in state:
                        state[d] = ([Best(len(a.names), negatives) for _ in range(positives)], np.zeros(len(a.names), np.int64)) if windows else (Best(len(a.names), positives),)
                    at = np.flatnonzero(dims == d)
                    take = pa.array(at)
                    parts = len(spans(d))
                    code = np.frombuffer(b"".join(b.column(4).take(take).to_pylist()), np.uint8).reshape(-1, parts)
                    left = np.frombuffer(b"".join(b.column(5).take(take).to_pylist()), np.float32).reshape(-1, parts)
                    known = held_books.value.get(d) or [np.zeros((1, e - s)) for s, e in spans(d)]
                    rest = known, b.column(0).to_numpy()[at], b.column(1).to_numpy()[at], _unpacked(b.column(3).take(take).to_pylist(), d), code, left
                    if windows:
                        search_windows(a, *state[d], *rest)
                    else:
                        search_positives(a, *state[d], *rest)
            for d, held_state in state.items():
                who = held.value[d].names
                found = enumerate(held_state[0]) if windows else [(-1, held_state[0])]
                for w, best in found:
                    at, score, name = best.held()
                    yield pa.RecordBatch.from_arrays([pa.array(who[at]), pa.array(np.full(len(at), w + 1, np.int32)), pa.array(name), pa.array(score)], names)
                if windows:
                    # a row of place 0 tells how many were scored
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.zeros(len(who), np.int32)), pa.array(who), pa.array(held_state[1])], names)

        return table.mapInArrow(run, FOUND)

    columns = [c.split()[0] for c in FOUND.split(", ")]
    schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long, verified long"
    for block in range(blocks if n else 0):
        part = spark.read.schema("vec_id long, label long, dim int, x binary").parquet(f"{path}/block={block}").toArrow() if _exists(spark, f"{path}/block={block}") else None
        if part is None or not part.num_rows:
            continue
        found = _blocks(part, None, positives, low, high)
        held = spark.sparkContext.broadcast(found)  # anchor_bytes at about most
        by = W.partitionBy("anchor_id").orderBy(F.desc("score"), "name")
        pos = written(meet(held, columns, False).withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives), "positives")
        windows: dict[int, list[int]] = {}
        for r in pos.orderBy("anchor_id", "place").toLocalIterator():  # `positives` rows an anchor of the block
            windows.setdefault(r.anchor_id, []).append(r.score)
        held.destroy()
        held = spark.sparkContext.broadcast(_blocks(part, windows, positives, low, high))
        got = meet(held, columns, True)
        verified = F.sum(F.when(F.col("place") == 0, F.col("score"))).over(W.partitionBy("anchor_id"))
        by = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "name")
        neg = got.withColumn("verified", verified).where("place > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
        named = pos.select("anchor_id", F.col("name").alias("positive_id"), F.col("place").alias("positive_rank"), F.col("score").alias("positive_score"))
        neg = neg.select("anchor_id", F.col("place").alias("positive_rank"), "rank", F.col("name").alias("negative_id"), F.col("score").alias("negative_score"), "verified")
        done = neg.join(named, ["anchor_id", "positive_rank"]).select(*(c.split()[0] for c in schema.split(", ")))
        done.write.parquet(f"{out}/part={block}")
        held.destroy()
        drop(pos)
    drop(table)
    drop_path(spark, path)
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).select(*(c.split()[0] for c in schema.split(", ")))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _blocks(part: pa.Table, windows: dict[int, list[int]] | None, positives: int, low: int, high: int) -> dict[int, Anchors]:
    """The anchors of a block by length; windows: the positives' scores of each, best first."""
    dims = part.column("dim").to_numpy()
    out = {}
    for d in np.unique(dims).tolist():
        rows = part.take(pa.array(np.flatnonzero(dims == d)))
        names, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        q = _unpacked(rows.column("x").to_pylist(), d)
        if windows is None:
            out[d] = Anchors(names, labels, q)
            continue
        edges = np.tile(np.array([LONG, -LONG]), (len(names), positives, 1))  # empty windows
        for i, who in enumerate(names.tolist()):
            for w, s in enumerate(windows.get(who, [])):
                edges[i, w] = window(s, low, high)
        out[d] = Anchors(names, labels, q, edges[:, :, 0], edges[:, :, 1])
    return out
