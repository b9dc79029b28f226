"""Balancing samples between tasks and languages."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = 1e-6
# Target weights of each policy.
POLICIES: dict[str, dict[str, float]] = {
    "task-lang-balancing": {"caption-de": 1, "caption-en": 1, "translation-de": 1, "translation-es": 1, "translation-fr": 1, "translation-zh": 1, "translation-ru": 1},
    "task-balancing": {"caption-de": 5, "caption-en": 5, "translation-de": 2, "translation-es": 2, "translation-fr": 2, "translation-zh": 2, "translation-ru": 2},
    "lang-balancing": {"caption-de": 1, "caption-en": 2, "translation-de": 1, "translation-es": 2, "translation-fr": 2, "translation-zh": 2, "translation-ru": 2},
    "generalist_finetune": {"caption-de": 1, "caption-en": 1, "caption-es": 1, "caption-fr": 1, "caption-zh": 1, "caption-ru": 1, "translation-de": 1, "translation-es": 1, "translation-fr": 1, "translation-zh": 1, "translation-ru": 1},
}


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Shares, whose sum stays a little under one."""
    total = sum(weights.values()) + EPSILON
    return {k: w / total for k, w in weights.items()}


def policy(name: str) -> dict[str, float]:
    if name not in POLICIES:
        raise ValueError(f"no such policy: {name}")
    return normalised(POLICIES[name])


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(w)) for k, w in normalised(weights).items()], "key string, target double")


def group_key(kind: Column, lang: Column) -> Column:
    return F.concat_ws("-", kind, lang)


def with_target(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """df with the target of its key; rows with a key outside the policy are dropped."""
    spark = df.sparkSession
    return df.join(F.broadcast(weights_table(spark, weights).withColumnRenamed("key", key)), key)


def uniform(key: Column) -> Column:
    """A number in (0, 1), by hash."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967298.0)


def weighted_draw(df: DataFrame, group: str, weight: Column, key: Column, *values: str) -> DataFrame:
    """One row of each group, drawn in proportion to its weight: the least exponential clock."""
    clock = -F.ln(uniform(key)) / weight
    return df.groupBy(group).agg(F.min_by(F.struct(*values), F.struct(clock, key)).alias("__v")).select(group, "__v.*")


def draw(counts: dict[str, int], keys: list[str], target: dict[str, float], u: float) -> int | None:
    """Index of the candidate drawn: those behind their target share weigh 1, others next to nothing.

    A key outside the policy makes the sample invalid: None.
    """
    if not keys or any(k not in target for k in keys):
        return None
    total = sum(counts.values())
    weights = [int(target[k] * total >= counts[k]) + EPSILON for k in keys]
    left = u * sum(weights)
    for i, w in enumerate(weights):
        left -= w
        if left < 0:
            return i
    return len(keys) - 1


def hashed_uniform(*parts: object) -> float:
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296


def dynamic_sample(df: DataFrame, worker: str, order: str, candidates: str, target: dict[str, float], seed: int = 0) -> DataFrame:
    """worker, order, pick, key: the candidate (an index and its key) drawn for each sample.

    Each worker keeps counts of what it has drawn and goes through its samples in order; rows of a
    worker are sorted into one task and streamed, so only counts are held. Samples with no candidate
    or one outside the policy are skipped.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, counts = object(), defaultdict(int)
        for pdf in batches:
            rows = []
            for w, o, keys in zip(pdf[worker], pdf[order], pdf[candidates], strict=True):
                if w != now:
                    now, counts = w, defaultdict(int)
                keys = list(keys) if keys is not None else []
                i = draw(counts, keys, target, hashed_uniform(seed, w, o))
                if i is not None:
                    counts[keys[i]] += 1
                    rows.append((w, o, i, keys[i]))
            yield pd.DataFrame(rows, columns=[worker, order, "pick", "key"])

    rows = df.select(worker, order, candidates).repartition(worker).sortWithinPartitions(worker, order)
    return rows.mapInPandas(run, f"{worker} {kinds[worker]}, {order} {kinds[order]}, pick int, key string")
