"""Report tables over metric rows (task, metric, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -100.0


def selected(results: DataFrame, prefix: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """key and a column a metric, MISSING where a task lacks it; no rows if a key has no task."""
    spark = results.sparkSession
    rows = results.where(F.startswith("task", F.lit(prefix))).withColumn("key", F.replace("task", F.lit(prefix), F.lit(""))).where(F.col("key").isin(*keys))
    wide = rows.groupBy("key").pivot("metric", metrics).agg(F.last("value"))
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    whole = wanted.join(rows, "key", "left_anti").isEmpty()
    return wide.select("key", *(F.coalesce(F.col(f"`{m}`"), F.lit(MISSING)).alias(m) for m in metrics)).where(F.lit(whole))


def means(table: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means over keys; missing values count as they stand."""
    return table.agg(*(F.avg(f"`{m}`").alias(m) for m in metrics))


def lines(table: DataFrame, keys: list[str], metrics: list[str], precision: int = 1) -> list[str]:
    """Header and value lines of a report, joined by &; as many rows as keys are collected."""
    rows = {r["key"]: r for r in table.collect()} if "key" in table.columns else {}
    if not rows:
        row = table.first()
        return [" & ".join(metrics), " & ".join(str(round(row[m], precision)) for m in metrics)]
    return [
        " & ".join(k for k in keys for _ in metrics),
        " & ".join(m for _ in keys for m in metrics),
        " & ".join(str(round(rows[k][m], precision)) for k in keys for m in metrics),
    ]


def union_of_keys(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns, null where one lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
