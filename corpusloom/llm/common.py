"""Shared pieces of the training-data operators: components of a link table, schemas, words; and from
the library, tables written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop, new_path, written

__all__ = ["WORD", "components", "drop", "kept", "lean", "new_path", "plus", "released", "written"]

#: A word is a run of characters other than ASCII white space (20, 09-0D).
WORD = r"[^\x20\x09-\x0D]+"


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """schema with the fields of a DDL string after its own."""
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


def lean(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a task's batches, so that results aren't gathered for many rows at once; at the end
    of the task the memory it took goes back, as the worker process lives on."""
    try:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    finally:
        released()


def released() -> None:
    """Gives back to the system what this process no longer holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


_owner: list = [None, {}]


def kept(owner: str) -> dict:
    """What a worker process keeps between the tasks of one operator; the next operator's first task
    lets go of it, as a worker lives through many."""
    if _owner[0] != owner:
        _owner[:] = owner, {}
        gc.collect()
    return _owner[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over `links`, for each node that has a link.

    Alternating large-star and small-star rounds: each node's larger neighbours, then its smaller
    ones, are hung on the smallest. It takes a logarithmic number of rounds, rows never outnumber
    links, each round is written to the shared folder. A node's neighbours are only aggregated
    (min), never gathered, so hubs cost no more than the rows they have.
    """
    spark = links.sparkSession

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        keep = both.join(low, "u").where(F.col("v") > F.col("u") if large else F.lit(True))
        new = keep.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            new = new.union(low.select("u", F.col("m").alias("v")))
        return new.where("u <> v").distinct()

    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        nxt = written(star(star(edges, True), False), "stars")
        drop(edges)
        edges = nxt
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.written_path = edges.written_path  # so that drop() deletes what it reads
    return out
