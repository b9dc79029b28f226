"""Text metrics as aggregations: BLEU, CIDEr, METEOR on exact matches.

Predictions come as (id, prediction, references). What concerns one sample is counted where its row
is, in Arrow batches; of BLEU only sums leave a batch, of CIDEr one row an n-gram, which is shuffled
for the document frequencies alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .batches import parts

ORDER = 4
#: N-grams whose frequencies are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
#: N-grams after which a task passes a batch on.
AT_ONCE = 1 << 16


def tokens(c: Column) -> Column:
    """Words and single other signs, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def tokens_13a(c: Column) -> Column:
    """The published metric's default tokens, with their case: signs apart, but not points and commas
    between digits, nor hyphens that don't follow a digit."""
    c = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, out in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        c = F.regexp_replace(c, pattern, out)
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _counts(t: list[str]) -> list[Counter]:
    return [Counter(" ".join(t[i : i + n]) for i in range(len(t) - n + 1)) for n in range(1, ORDER + 1)]


def _sides(df: DataFrame, tokenizer) -> tuple[DataFrame, DataFrame]:
    hyp = df.select("id", tokenizer(F.col("prediction")).alias("t"))
    ref = df.select("id", F.posexplode("references").alias("ref", "r")).select("id", "ref", tokenizer(F.col("r")).alias("t"))
    return hyp, ref


#: What BLEU is made of: matches and totals by order, and both lengths; sums of these over any rows give their BLEU.
BLEU_SUMS = [*(f"match{n}" for n in range(1, ORDER + 1)), *(f"total{n}" for n in range(1, ORDER + 1)), "prediction_length", "reference_length"]


def bleu_sums(df: DataFrame, tokenizer=tokens) -> DataFrame:
    """Rows of BLEU_SUMS, one an Arrow batch; a batch or a stream of (prediction, references). Rows without a
    prediction or references are left out."""
    rows = df.select(tokenizer(F.col("prediction")).alias("h"), F.transform("references", tokenizer).alias("r")).where("h is not null and r is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [0] * len(BLEU_SUMS)
            for h, refs in ((h, refs) for p in parts([b]) for h, refs in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)):
                refs = [r for r in refs if r is not None]
                counted = [_counts(r) for r in refs]
                for n, own in enumerate(_counts(h)):
                    sums[n] += sum(min(c, max((r[n][g] for r in counted), default=0)) for g, c in own.items())
                    sums[ORDER + n] += own.total()
                if refs:
                    sums[-2] += len(h)
                    sums[-1] += min((len(r) for r in refs), key=lambda x: (abs(len(h) - x), x))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], BLEU_SUMS)

    return rows.mapInArrow(count, ", ".join(f"{x} long" for x in BLEU_SUMS))


def bleu(df: DataFrame, tokenizer=tokens) -> DataFrame:
    """One row: bleu (percent), p1 to p4, brevity, prediction_length, reference_length.

    Clipped by the greatest count in any reference; the reference length is the nearest one's
    (the shorter of two as near). A precision without matches is smoothed by halving.
    """
    return bleu_of(bleu_sums(df, tokenizer).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in BLEU_SUMS)))


def bleu_of(sums: DataFrame) -> DataFrame:
    """The figures of rows of BLEU_SUMS, each by itself."""
    out = sums
    zero = F.lit(0)
    for n in range(1, ORDER + 1):
        zero = zero + F.when(F.col(f"match{n}") == 0, 1).otherwise(0)
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), zero) * F.col(f"total{n}"))
        out = out.withColumn(f"p{n}", F.when(F.col(f"total{n}") == 0, 0.0).when(F.col(f"match{n}") == 0, smoothed).otherwise(100.0 * F.col(f"match{n}") / F.greatest(f"total{n}", F.lit(1))))
    ratio = F.try_divide(F.col("reference_length").cast("double"), F.col("prediction_length"))
    brevity = F.when(F.col("prediction_length") >= F.col("reference_length"), 1.0).otherwise(F.coalesce(F.exp(1 - ratio), F.lit(0.0)))
    mean = F.when(F.least(*(f"p{n}" for n in range(1, ORDER + 1))) <= 0, 0.0).otherwise(F.exp(sum((F.ln(f"p{n}") for n in range(1, ORDER + 1)), F.lit(0.0)) / ORDER))
    return out.select((brevity * mean).alias("bleu"), *(f"p{n}" for n in range(1, ORDER + 1)), brevity.alias("brevity"), F.col("prediction_length").cast("long"), F.col("reference_length").cast("long"))


def cider(df: DataFrame, tokenizer=tokens, clipped: bool = True, sigma: float = 6.0) -> DataFrame:
    """id, cider: consensus of TF-IDF n-gram vectors, mean over references and orders, times 10.

    clipped: counts are cut to the reference's and lengths that differ are discounted (the variant
    called D). Document frequencies count samples whose references hold the n-gram.
    """
    kind = df.schema["id"].dataType
    rows = df.select("id", tokenizer(F.col("prediction")).alias("h"), F.transform("references", tokenizer).alias("r"))
    schema = f"id {kind.simpleString()}, ref int, n int, gram string, c long, d long, first int"

    def passed(b: pa.RecordBatch, ids, places, orders, grams, own_n, ref_n, new) -> pa.RecordBatch:
        out = [b.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int32()), pa.array(orders, pa.int32()), pa.array(grams, pa.string()), pa.array(own_n, pa.int64()), pa.array(ref_n, pa.int64()), pa.array(new, pa.int32())]
        return pa.RecordBatch.from_arrays(out, ["id", "ref", "n", "gram", "c", "d", "first"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            held = ids, places, orders, grams, own_n, ref_n, new = tuple([] for _ in range(7))
            for k, (h, refs) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                known = [set() for _ in range(ORDER)]
                own = _counts(h or [])
                for ref, r in enumerate(refs or []):
                    for n, (c, d) in enumerate(zip(own, _counts(r or []), strict=True)):
                        both = c.keys() | d.keys()
                        ids += [k] * len(both)
                        places += [ref] * len(both)
                        orders += [n + 1] * len(both)
                        grams += both
                        own_n += [c[g] for g in both]
                        ref_n += [d[g] for g in both]
                        # a sample counts once for a gram, whichever of its references hold it
                        new += [int(g in d and g not in known[n]) for g in both]
                        known[n].update(d)
                        if len(ids) >= AT_ONCE:
                            yield passed(b, *held)
                            for x in held:
                                x.clear()
            if ids:
                yield passed(b, *held)

    grams = rows.mapInArrow(count, schema)
    # what only one sample holds needs no lookup; the rest is broadcast where it is small, so that common words' many
    # rows don't meet in one task
    often = written(grams.groupBy("n", "gram").agg(F.sum("first").alias("df")).where("df > 1"), "grams")
    often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often
    idf = F.ln("samples") - F.ln(F.coalesce("df", F.lit(1)))
    both = grams.join(often, ["n", "gram"], "left").crossJoin(df.agg(F.count("*").alias("samples"))).select("id", "ref", "n", (F.col("c") * idf).alias("w"), (F.col("d") * idf).alias("v"))
    product = F.least("w", "v") * F.col("v") if clipped else F.col("w") * F.col("v")
    sims = both.groupBy("id", "ref", "n").agg(F.sum(product).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_a"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_b"))
    sims = sims.withColumn("sim", F.coalesce(F.try_divide("dot", F.col("norm_a") * F.col("norm_b")), F.lit(0.0)))
    hyp, ref = _sides(df, tokenizer)
    size = hyp.select("id", F.size("t").alias("h")).join(ref.select("id", "ref", F.size("t").alias("r")), "id")
    near = F.exp(-F.pow((F.col("h") - F.col("r")).cast("double"), 2) / (2 * sigma * sigma)) if clipped else F.lit(1.0)
    per_ref = size.join(sims.groupBy("id", "ref").agg((F.sum("sim") / ORDER).alias("s")), ["id", "ref"], "left")
    return per_ref.groupBy("id").agg((F.avg(F.coalesce("s", F.lit(0.0)) * near) * 10).alias("cider"))


def meteor_exact(df: DataFrame, tokenizer=tokens) -> DataFrame:
    """id, meteor: harmonic mean of precision and recall of exact matches, nine to one for recall,
    less a penalty for scattered matches; the best reference counts.

    The k-th occurrence of a word matches the k-th in the reference. Stems and synonyms need tables
    that aren't here.
    """
    hyp, ref = _sides(df, tokenizer)

    def placed(t: DataFrame, keys: list[str], at: str) -> DataFrame:
        rows = t.select(*keys, F.posexplode("t").alias(at, "word"))
        return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys, "word").orderBy(at)))

    met = placed(hyp, ["id"], "i").join(placed(ref, ["id", "ref"], "j"), ["id", "word", "k"])
    w = W.partitionBy("id", "ref").orderBy("i")
    step = (F.col("i") == F.lag("i").over(w) + 1) & (F.col("j") == F.lag("j").over(w) + 1)
    chunks = met.withColumn("new", F.when(F.coalesce(step, F.lit(False)), 0).otherwise(1)).groupBy("id", "ref").agg(F.count("*").alias("m"), F.sum("new").alias("chunks"))
    size = hyp.select("id", F.size("t").alias("h")).join(ref.select("id", "ref", F.size("t").alias("r")), "id")
    rows = size.join(chunks, ["id", "ref"], "left").fillna(0, ["m", "chunks"])
    p, r = F.try_divide("m", "h"), F.try_divide("m", "r")
    f = F.coalesce(F.try_divide(10 * p * r, r + 9 * p), F.lit(0.0))
    penalty = F.coalesce(0.5 * F.pow(F.try_divide("chunks", "m"), 3), F.lit(0.0))
    return rows.groupBy("id").agg(F.max(f * (1 - penalty)).alias("meteor"))
