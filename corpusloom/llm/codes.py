"""Product codes of vectors by whole-number k-means, with a VA-file as filter.

Components become whole numbers, vectors are cut into parts, and every part position has a codebook.
For a codebook a VA-file is built: in each dimension the entries' coordinates fall into 2^BITS cells, and
an entry is known by its cells. A part that asks for its nearest entry first makes two tables, of the least
and the greatest squared distance to each cell; sums over an entry's cells bound its distance from below
and above. Only entries whose lower bound doesn't exceed the least upper bound are looked at in full, by
whole-number distances, so that the nearest entry (the first of several as near) is always found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, plus, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of a dimension are 2^BITS; parts that are looked up at once; positions whose sums travel in one row.
BITS, BLOCK, WIDTH = 4, 1024, 16
#: Label sums are broadcast up to so many labels; beyond that the join shuffles.
BROADCAST_LABELS = 1_000_000


def finite(v: Column) -> Column:
    """Not null, and no component null or not finite."""
    v = v.cast("array<double>")
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(x: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of rows x. Beyond a bound at which distances would leave 64 bits (131,072 for vectors
    of 64 components) components count as that bound."""
    most = math.isqrt((1 << 60) // max(1, x.shape[1] // parts)) // 2
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * float(scale)), -most, most).astype(np.int64)


class VaFile:
    """Cells of the entries of one codebook."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, d = entries.shape
        cells = min(1 << bits, n)
        by = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((d, n), np.int64)
        self.low, self.high = np.empty((d, cells), np.int64), np.empty((d, cells), np.int64)
        share = np.arange(n) * cells // n  # as many entries in each
        first = np.searchsorted(share, np.arange(cells))
        last = np.append(first[1:], n) - 1
        for i in range(d):
            self.cell[i, by[:, i]] = share
            inside = entries[by[:, i], i]
            self.low[i], self.high[i] = inside[first], inside[last]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, entries by rows of x."""
        lower = np.zeros((len(self.entries), len(x)), np.int64)
        upper = np.zeros_like(lower)
        for i in range(x.shape[1]):
            a, b = self.low[i][:, None] - x[:, i], x[:, i] - self.high[i][:, None]
            lower += (np.maximum(0, np.maximum(a, b)) ** 2)[self.cell[i]]
            upper += (np.maximum(np.abs(a), np.abs(b)) ** 2)[self.cell[i]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row of x, and how many distances were computed."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero((lower <= upper.min(axis=0)).T)  # by row, then by entry
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, starts) if len(x) else distance
        hit = np.flatnonzero(distance == least[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[hit], distance[hit], len(row)


def assigned(x: np.ndarray, files: list[VaFile]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, rows by parts."""
    code, distance = np.empty((len(x), len(files)), np.int64), np.empty((len(x), len(files)), np.int64)
    size = x.shape[1] // len(files)
    for p, f in enumerate(files):
        for i in range(0, len(x), BLOCK):
            code[i : i + BLOCK, p], distance[i : i + BLOCK, p], _ = f.nearest(x[i : i + BLOCK, p * size : (p + 1) * size])
    return code, distance


def rows_of(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column have `length` components, and these as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == length)
    return at, column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)


def codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of rows (vec_id, embedding), all finite; those of `length` components count.

    They start as the parts of the smallest vec_ids, ascending (of rows that share one, the smallest vector).
    A round is one pass: each task adds up the parts it assigns to each entry, Spark adds these sums up,
    and parts * entries sums reach the driver.
    """
    spark = rows.sparkSession
    fit = rows.where(F.size("embedding") == length)
    ids = [r.vec_id for r in fit.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return [np.zeros((0, length // parts), np.int64)] * parts
    first = fit.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("embedding").alias("v")).orderBy("vec_id").collect()
    x = whole(np.array([r.v for r in first], np.float64), parts, scale)
    size = length // parts
    books = [x[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    names = ["part", "entry", "block", "n", *(f"s{i}" for i in range(WIDTH))]
    blocks = -(-size // WIDTH)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)  # parts * entries rows of a part's length

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = [VaFile(b) for b in held.value]  # noqa: B023
            k = len(files[0].entries)
            total, count = np.zeros((parts * k, size), np.int64), np.zeros(parts * k, np.int64)
            for b in lean(batches, 8 * BLOCK):
                _, v = rows_of(b.column(0), length)
                v = whole(v, parts, scale)
                code, _ = assigned(v, files)
                for p in range(parts):
                    at = code[:, p] + p * k
                    by = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                    if len(starts):
                        total[at[by][starts]] += np.add.reduceat(v[by, p * size : (p + 1) * size], starts, axis=0)
                        count += np.bincount(at, minlength=parts * k)
            used = np.flatnonzero(count)
            wide = np.zeros((parts * k, blocks * WIDTH), np.int64)
            wide[:, :size] = total
            for block in range(blocks):
                s = wide[used, block * WIDTH : (block + 1) * WIDTH]
                yield pa.RecordBatch.from_arrays([pa.array(used // k), pa.array(used % k), pa.array(np.full(len(used), block)), pa.array(count[used]), *(pa.array(s[:, i]) for i in range(WIDTH))], names)

        sums = fit.select(F.col("embedding")).mapInArrow(add, ", ".join(f"{n} long" for n in names)).groupBy("part", "entry", "block").agg(*(F.sum(n).alias(n) for n in names[3:]))
        books = [b.copy() for b in books]
        for r in sums.collect():
            at = r.block * WIDTH
            books[r.part][r.entry, at : at + WIDTH] = (np.array(r[4:], np.int64) // r.n)[: size - at]
        held.destroy()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of rows (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are dropped. The smallest vec_id whose
    vector can be cut into equal parts tells the length; other vectors stay, with null code and error. Rows with
    null vec_id or repeated ones are rows like others, but for the start. label_error adds up the errors of
    equal labels, null ones together; null where none has an error or the sum leaves 64 bits. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(finite(F.col("embedding")))
    size = F.size("embedding")
    head = good.where((size > 0) & (size % parts == 0) & F.col("vec_id").isNotNull()).groupBy().agg(F.min(F.struct("vec_id", size.alias("size"))).alias("h")).first().h
    length = head["size"] if head else 0
    books = codebooks(good, length, parts, entries, rounds, scale) if length else []
    held = spark.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b) for b in held.value]
        for b in lean(batches, 8 * BLOCK):
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if files:
                at, v = rows_of(b.column(1), length)
                c, d = assigned(whole(v, parts, scale), files)
                code[at] = ["".join(f"{k:0{digits}x}" for k in r) for r in c.tolist()]
                error[at] = d.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    done = written(good.mapInArrow(encode, plus(rows.select("vec_id", "label").schema, "code string, error long")), "codes")
    sums = written(done.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(F.col("label").alias("__label"), "label_error"), "label-errors")
    few = sums.count() <= BROADCAST_LABELS
    out = done.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

