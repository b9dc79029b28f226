"""Mixing sources to target weights by cube-method balanced sampling.

A source with S words and target T takes every document floor(T / S) times, and once more with
inclusion probability T / S - floor(T / S). The flight phase moves the probabilities of three
documents at a time through the null-space of the constraints (their number and their words), until
each is 0 or 1 or fewer than three are left. Documents fly in blocks of a bounded size, the largest
first, so that small ones are left; the few left over of all blocks fly together, block by block
again, until one block a source remains. Its last one or two documents land where the words come
nearest to the target. Where that isn't near (a document may hold most of a small source's words),
single copies of other documents in that block are added or taken off while it helps.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import numbered
from .common import WORD, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that fly together.
BLOCK = 4096


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target of each source: sources by code point, null last, have the weights in turn and share the
    sum of sizes; none exceeds `most` times its size, what is cut off is shared anew by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = {}
    rest, total = set(names), Fraction(sum(sizes.values()))
    while rest:
        share = total / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * share > most * sizes[s]}
        if not over:
            return out | {s: float(weight[s] * share) for s in rest}
        for s in over:
            out[s] = float(most * sizes[s])
            total -= most * sizes[s]
        rest -= over
    return out


class _Draw:
    """Reproducible numbers in [0, 1)."""

    def __init__(self, seed: str):
        self.state = zlib.crc32(seed.encode()) | 1 << 40

    def __call__(self) -> float:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return (self.state >> 11) / (1 << 53)


def flight(p: list[float], size: list[int], seed: str) -> list[float]:
    """Probabilities after the flight phase: all but at most two are 0 or 1; their sum and the words
    they weigh are as before."""
    p = list(p)
    draw = _Draw(seed)
    open_ = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    for i, x in enumerate(p):
        if not 1e-9 < x < 1 - 1e-9:
            p[i] = float(round(x))
    hand: list[int] = []
    for i in open_:
        hand.append(i)
        while len(hand) == 3:
            a, b, c = hand
            v = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            if v[0] == v[1] == v[2] == 0:
                v = [1, -1, 0]
            scale = 1 / max(map(abs, v))
            v = [x * scale for x in v]
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(hand, v, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(hand, v, strict=True) if x)
            step = up if draw() * (up + down) < down else -down
            for k, x in zip(hand, v, strict=True):
                p[k] += step * x
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = float(round(p[k]))
            hand = [k for k in hand if 0 < p[k] < 1]
    return p


def landing(p: list[float], size: list[int]) -> list[float]:
    """The few probabilities left are rounded so that words, then documents, come nearest."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    words, count = sum(p[i] * size[i] for i in left), sum(p[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(words - sum(size[i] for k, i in enumerate(left) if m >> k & 1)), abs(count - m.bit_count()), m))
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)
    return p


def settled(copies: list[int], size: list[int], target: float, most: int) -> list[int]:
    """Copies after single additions or removals, each the one that brings the words nearest to the target."""
    copies = list(copies)
    off = sum(c * s for c, s in zip(copies, size, strict=True)) - target
    while True:
        step = -1 if off > 0 else 1
        fit = [i for i, (c, s) in enumerate(zip(copies, size, strict=True)) if 0 <= c + step <= most and 0 < s < 2 * abs(off)]
        if not fit:
            return copies
        i = min(fit, key=lambda i: abs(off + step * size[i]))
        copies[i] += step
        off += step * size[i]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, words, docs; one row a source) with its target, as `targets` has it: level by level
    over the table, so that sources may be as many as hosts. Only sums pass the driver."""
    no = numbered(sizes.withColumn("__last", F.col("source").isNull()), "__last", F.coalesce("source", F.lit("")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row_no") % len(weights) + 1).cast("int"))
    known = written(no.select("source", "words", "docs", weight.alias("w")), "sources")
    big = "decimal(38,0)"
    total = known.agg(F.coalesce(F.sum(F.col("words").cast(big)), F.lit(0)).cast("string").alias("t")).first().t
    level, capped = None, None
    while True:
        # words * most < level * w: cut off at the level so far
        over = F.lit(False) if level is None else F.col("words").cast(big) * most * level.denominator < F.col("w").cast(big) * F.lit(str(level.numerator)).cast(big)
        got = known.agg(F.count(F.when(over, 1)).alias("n"), F.coalesce(F.sum(F.when(over, F.col("words").cast(big))), F.lit(0)).cast("string").alias("words"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0)).alias("w")).first()
        if got.n == capped or not got.w:
            break
        capped, level = got.n, Fraction(int(total) - most * int(got.words), int(got.w))
    ratio = F.lit(0.0) if level is None else F.lit(level.numerator / level.denominator)
    return known.select("source", "words", "docs", F.when(over, (F.col("words") * most).cast("double")).otherwise(F.col("w") * ratio).alias("target"))


def _slim(docs: DataFrame) -> DataFrame:
    """One row a document, without its text: doc_id, source, size, two keys of the row and, of equal rows, the how-manieth it is."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *_keys())
    counted = rows.groupBy(rows.columns).agg(F.count("*").alias("__n"))
    return counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")


def _keys() -> list[Column]:
    """128 bits that tell rows apart by doc_id, source and text."""
    parts = [F.col("doc_id"), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("text")]
    return [F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit(1), *parts).alias("__k2")]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with size, source_size, target and copies.

    size is the number of words, copies how often the mix takes the row. Null and empty texts have
    size 0 and fly like the others; a null source is a source of its own. A source without words
    takes each of its rows once. Repeated rows are units of their own. Columns of docs named like
    those added are replaced, those of any other name are kept. Equal inputs give equal results. An
    empty table gives no rows.

    Decisions are made on rows without texts and joined to docs by a hash of the row; rows that are
    equal share their copies evenly.
    """
    added = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*added)
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    made = _mixed(docs.sparkSession, written(_slim(docs.select("doc_id", "source", "text")), "sizes"), weights, most, block)
    made = made.groupBy("__k1", "__k2").agg(*(F.first(c).alias(c) for c in added[:3]), F.sum("copies").alias("__sum"), F.count("*").alias("__n"))
    # other columns go along as one, so that no name of theirs meets one used here
    rows = docs.select("doc_id", "source", "text", F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"))
    rows = rows.select("*", *_keys()).join(made, ["__k1", "__k2"])
    w = W.partitionBy("__k1", "__k2").orderBy("__k1")
    # only rows that repeat are numbered
    once, more = rows.where("__n = 1").withColumn("__i", F.lit(1)), rows.where("__n > 1").withColumn("__i", F.row_number().over(w))
    rows = once.union(more)
    copies = F.expr("__sum div __n + if(__i <= __sum % __n, 1, 0)").cast("long")
    return rows.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns), *added[:3], copies.alias("copies"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Like mix_sources, without the texts: doc_id, source, size, source_size, target, copies."""
    made = _mixed(docs.sparkSession, written(_slim(docs), "sizes"), weights, most, block)
    return made.drop("__k1", "__k2", "__i")


def _mixed(spark, rows: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    by = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    plan = source_targets(by, weights, most)
    plan = written(plan.select("source", F.col("words").alias("source_size"), "target", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(1.0)).alias("ratio"), F.ceil(F.col("docs") / block).cast("int").alias("blocks")), "plan")
    about = plan.agg(F.count("*").alias("n"), F.coalesce(F.max("blocks"), F.lit(1)).alias("blocks")).first()
    names = rows.columns
    rows = rows.alias("d").join(F.broadcast(plan.alias("p")) if about.n < 100_000 else plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select(*(F.col(f"d.{c}") for c in names), "source_size", "target", F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("__p"), F.xxhash64("d.__k1", "d.__i").alias("__tie"), "blocks")
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("__tie"), F.col("blocks"))).drop("blocks")
    schema = T.StructType([f for f in rows.schema])

    def in_order(t: pd.DataFrame) -> pd.DataFrame:
        return t.sort_values(["size", "__tie"], ascending=[False, True], kind="stable").reset_index(drop=True)

    def fly(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = in_order(t)
        t["__p"] = flight(t["__p"].tolist(), t["size"].tolist(), repr(key))
        return t

    def land(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = in_order(t)
        goal = float((t["size"] * (t["copies"] + t["__p"])).sum())
        t = fly(key, t)
        t["__p"] = landing(t["__p"].tolist(), t["size"].tolist())
        t["copies"] = settled((t["copies"] + t["__p"].astype(int)).tolist(), t["size"].tolist(), goal, most)
        t["__p"] = 0.0
        return t

    blocks = max(1, about.blocks)
    decided = []
    while blocks > 1:
        level = written(rows.groupBy("source", "__block").applyInPandas(fly, schema), "flight")
        decided.append(level.where("__p in (0, 1)"))
        blocks = math.ceil(2 * blocks / block)
        rows = level.where("__p > 0 and __p < 1").withColumn("__block", F.pmod(F.xxhash64("__tie", F.lit(blocks)), F.lit(blocks)))
    decided.append(rows.groupBy("source").applyInPandas(land, schema))
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return out.select(*names, "source_size", "target", (F.col("copies") + F.col("__p").cast("long")).cast("long").alias("copies"))
