"""Numbering rows over a whole table without gathering them in one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written


def numbered(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """df with row numbers from 0 in the order of `order`, which must tell rows apart.

    Rows are range-partitioned and sorted; each partition's numbers start where the one before
    ends. Only one count per partition passes the driver. Nulls come first. An empty table gives
    no rows; a column called `name` is replaced.
    """
    spark = df.sparkSession
    df = df.drop(name)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    if not counts:
        return placed.drop("__part").withColumnRenamed("__at", name)
    starts = [0, *accumulate(n for _, n in counts)]
    table = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "__part int, __start long")
    return placed.join(F.broadcast(table), "__part").withColumn(name, F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over the rows of the same `by` that come before, in the order of `order`, which
    must tell a key's rows apart; null values count as 0.

    There is no window by key, so one key may hold any share of the rows: rows are range-partitioned by key and
    order, each partition adds up on its own, and as only the first key of a partition can have begun before
    it, one number a partition passes the driver. Null keys are a key. An empty table gives no rows; a column
    called `name` is replaced.
    """
    spark = df.sparkSession
    df = df.drop(name)
    keys = [F.col(c) for c in (*by, *order)]
    rows = df.withColumn("__key", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")).withColumn("__value", F.coalesce(F.col(value).cast("long"), F.lit(0)))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.array(b.column(b.schema.get_field_index("__key")).to_pylist(), object)
            v = b.column(b.schema.get_field_index("__value")).to_numpy()
            total = np.cumsum(v)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            base = (total - v)[starts]  # what stands before each key's first row
            if key[0] == last:
                base[0] -= carry
            base = np.repeat(base, np.diff([*starts, len(key)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total - v - base)], [*b.schema.names, "__local"])
            last, carry = key[-1], int(total[-1] - base[-1])

    schema = T.StructType([*rows.schema.fields, T.StructField("__local", T.LongType())])
    placed = written(rows.mapInArrow(add, schema).withColumn("__at", F.monotonically_increasing_id()), "running")
    ends = placed.groupBy("__part").agg(F.min_by("__key", "__at").alias("first"), F.max_by(F.struct("__key", (F.col("__local") + F.col("__value")).alias("total")), "__at").alias("last"))
    table, held, carry = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        start = carry if r["first"] == held else 0
        table.append((r["__part"], r["first"], start))
        held, carry = r["last"]["__key"], r["last"]["total"] + (start if r["first"] == r["last"]["__key"] else 0)
    starts = F.broadcast(spark.createDataFrame(table, "__part int, __first string, __start long"))  # a row a partition
    total = F.col("__local") + F.when(F.col("__key") == F.col("__first"), F.col("__start")).otherwise(0)
    return placed.join(starts, "__part").select(*df.columns, total.alias(name))


def sharded(df: DataFrame, size: int, number: str = "row_no") -> DataFrame:
    """Six-digit key and shard of numbered rows, `size` rows a shard."""
    n = F.col(number)
    return df.withColumn("key", F.when(n < 1_000_000, F.lpad(n.cast("string"), 6, "0")).otherwise(n.cast("string"))).withColumn("shard", F.floor(n / size).cast("long"))


def batched(df: DataFrame, size: int, number: str = "row_no") -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(number) / size).cast("long"))


def from_batch(df: DataFrame, after: int) -> DataFrame:
    """Batches after the one where work stopped."""
    return df.where(F.col("batch") > after)


def first_batch(df: DataFrame, size: int, number: str = "row_no") -> DataFrame:
    """A trial run's rows: those of the first batch, by number, so that it is the same every time."""
    return df.where(F.col(number) < size)


def preview(df: DataFrame, *order: str, n: int = 10) -> DataFrame:
    """The first rows for a look at a result."""
    return df.orderBy(*order).limit(n)


def length(df: DataFrame, declared: int | None = None) -> int:
    """How many rows a dataset says to have, or a count over all of it where it says nothing."""
    return declared if declared is not None else df.count()
