"""Losses, their weighted means, and the size of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Datasets that each summary figure covers.
GROUPS = {
    "mean": ["en_caption", "de_caption", "es_caption", "zh_caption", "es_translation", "zh_translation"],
    "unseen": ["es_caption", "zh_caption"],
    "ood": ["es_translation", "zh_translation"],
    "id": ["en_caption", "de_caption"],
}


def dataset_losses(df: DataFrame, dataset: str = "dataset", loss: str = "loss") -> DataFrame:
    return df.groupBy(F.col(dataset).alias("dataset")).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))


def summarised(losses: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """name, loss: means of groups weighted by n, and each dataset's own; losses has dataset, loss, n."""
    spark = losses.sparkSession
    bridge = spark.createDataFrame([(g, d) for g, ds in groups.items() for d in ds], "name string, dataset string")
    means = losses.join(F.broadcast(bridge), "dataset").groupBy("name").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return means.union(losses.select("dataset", "loss"))


def accuracy(correct: Column, incorrect: Column) -> Column:
    """Percentage of lower perplexities of the right candidate; ties are wrong."""
    return F.avg((correct < incorrect).cast("int")) * 100


def name_matches(name: Column, parts: list[str]) -> Column:
    """Whether the name holds any of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(name, F.lit(p))
    return out


def parameter_counts(df: DataFrame, name: str, size: str, trainable: list[str]) -> DataFrame:
    """total and trainable parameters, and megabytes at four bytes each."""
    t = F.sum(F.when(name_matches(F.col(name), trainable), F.col(size)).otherwise(0)).cast("long")
    return df.agg(F.sum(size).cast("long").alias("total"), t.alias("trainable")).withColumn("size_mb", F.col("total") * 4e-6)


def compute_estimate(counts: DataFrame, macs: Column, steps: int, batch: int) -> DataFrame:
    """Samples seen, factor of forward and backward pass, and operations of a training run."""
    factor = 1 + F.col("trainable") / F.col("total")
    seen = F.lit(steps * batch).cast("long")
    return counts.select("total", "trainable", seen.alias("seen"), factor.alias("factor"), (seen * macs * factor).alias("training_macs"))


def decoder_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Names of a language model's parameters in a fused one; a post-attention norm gives two rows."""
    n = F.col(name)
    renamed = F.when(F.contains(n, F.lit("lm_head.")), F.replace(n, F.lit("lm_head."), F.lit("language_model.lm_head."))).otherwise(F.replace(n, F.lit("model."), F.lit("language_model.model.decoder.")))
    norm = F.when(F.contains(renamed, F.lit("post_attention_layernorm.")), F.replace(renamed, F.lit("post_attention_layernorm."), F.lit("post_encoder_attention_layernorm.")))
    return df.withColumn(name, F.explode(F.array_compact(F.array(norm, renamed))))


#: Parts of names that the vision model doesn't lend.
DROPPED = ("language_model.model.decoder.", "language_model.lm_head.", "language_model.final_logits_bias", "language_model.model.shared.weight")


def encoder_names(df: DataFrame, name: str = "name") -> DataFrame:
    n = F.col(name)
    return df.where(~name_matches(n, list(DROPPED))).withColumn(name, F.replace(n, F.lit("lm_head."), F.lit("language_model.lm_head.")))


def merged_parameters(first: DataFrame, second: DataFrame, name: str = "name") -> DataFrame:
    """Union of two tables by name; the second's rows overwrite the first's."""
    values = [c for c in first.columns if c != name]
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)))
    return both.groupBy(name).agg(F.max_by(F.struct(*values), "__o").alias("__v")).select(name, "__v.*")


def changed(before: DataFrame, after: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Names whose value differs after training."""
    a = after.select(name, F.col(value).alias("__after"))
    return before.join(a, name).where(~F.col(value).eqNullSafe(F.col("__after"))).select(name)


def remapped(mapping: DataFrame, vectors: DataFrame, new: str, old: str, vector: str) -> DataFrame:
    """new, n_old, values: mean of the vectors of the old ids that a new id stands for.

    mapping has one row per new and old id; its lists are as long as a token's pieces.
    """
    got = mapping.join(vectors.select(F.col(old), F.col(vector).cast("array<double>").alias("__v")), old)
    summed = got.groupBy(new).agg(F.count("*").alias("n_old"), F.array_sort(F.collect_list(F.struct(old, "__v"))).alias("__all"))
    total = F.aggregate(F.slice("__all", 2, 1 << 30), F.get("__all", F.lit(0))["__v"], lambda s, x: F.zip_with(s, x["__v"], lambda a, b: a + b))
    return summed.select(new, "n_old", F.transform(total, lambda x: x / F.col("n_old")).alias("values"))
