"""Fanning captions out to languages and merging what a translator returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.prompts import TRANSLATOR_CODES, context_source, lookup

TARGETS = ("de", "fr", "es", "zh", "ru")
SLOTS = 5


def fan_out(df: DataFrame, captions: str | None = None, langs: tuple[str, ...] = TARGETS, slots: int = SLOTS) -> DataFrame:
    """A row for each language, in order, and, with captions (an array column), each of its first slots."""
    out = df.withColumn("lang", F.explode(F.array(*map(F.lit, langs)))).withColumn("code", lookup(TRANSLATOR_CODES, F.col("lang"), "language"))
    if captions:
        keep = [c for c in out.columns if c != captions]
        out = out.select(*keep, F.posexplode(F.slice(captions, 1, slots)).alias("slot", "caption"))
    return out


def with_context(df: DataFrame, caption: str, description: str) -> DataFrame:
    return df.withColumn("source", context_source(F.col(caption), F.col(description)))


def merged(decoded: Column, retry: Column, lang: Column, compat: bool = False) -> Column:
    """Translation with failures replaced by the retry, punctuation repaired."""
    return X.end_sentence(X.retried(decoded, retry), lang, compat)


def retry_ratio(df: DataFrame, failed: Column, batch: int | None = None) -> DataFrame:
    """Share of failures; with batch, failures over that fixed number."""
    n = F.count_if(failed)
    return df.agg((n / (F.lit(batch) if batch else F.count("*"))).alias("retry_ratio"))
