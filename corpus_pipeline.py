"""From documents to packed training sequences: language ID, toxicity, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import languages, toxicity
from corpusloom.llm.common import drop, written
from corpusloom.llm.minhash import BROADCAST_IDS, near_duplicates
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.packing import pack_documents
from corpusloom.operators.order import numbered

#: Text whose trigrams fit its best language less (1: as that language's own text, 0: none ever seen) is
#: of none that was learned. Clean documents of the test tables are over 0.5, typing at random and
#: other scripts under 0.2.
LEAST_FIT = 0.3


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows that judge passes on, with the columns they came with, whatever names it uses itself."""
    rest = [c for c in docs.columns if c not in keep]
    out = judge(docs.select(*keep, F.struct(*rest).alias("__rest")))
    return out.select(*(F.col(c) if c in keep else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that fit no language learned."""
    model = languages.train(docs)
    clear = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("fit") >= LEAST_FIT)
    return _judged(docs, lambda d: languages.identify_language(d, model).where(clear))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by a model of the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda d: toxicity.score_toxicity(d, model).where("predicted = 0"))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __id, and the __ids that more than one row has. __id is the doc_id; where rows of
    different texts share one, it is theirs for the smallest text hash and a number beyond all doc_ids
    for each other. Rows with null doc_id have none."""
    of = docs.select("doc_id", F.xxhash64("text").alias("__h")).where("doc_id is not null").groupBy("doc_id", "__h").agg(F.count("*").alias("n"))
    several = of.groupBy("doc_id").agg(F.min("__h").alias("first"), F.count("*").alias("texts"), F.max("n").alias("rows")).where("texts > 1 or rows > 1")
    several = written(several, "repeated-ids")
    if several.isEmpty():
        return docs.withColumn("__id", F.col("doc_id").cast("long")), several.select("doc_id")
    more = of.join(several.where("texts > 1"), "doc_id").where("__h <> first").select("doc_id", "__h")
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    room = high < (1 << 62)
    other = numbered(more, "doc_id", "__h").select("doc_id", "__h", ((high + 1 + F.col("row_no")) if room else (low - 1 - F.col("row_no"))).alias("__other"))
    out = docs.withColumn("__h", F.xxhash64("text")).join(other, ["doc_id", "__h"], "left").withColumn("__id", F.coalesce("__other", F.col("doc_id").cast("long")))
    return out.select(*docs.columns, "__id"), several.where("rows > 1").select("doc_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Rows that share a doc_id but not their text are documents of their own, grouped by their texts
    alone (the one with the smallest text hash counts as the smallest of them). Of rows equal in
    doc_id and text one is kept. Rows with null doc_id are kept.
    """
    inner = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    rows, twice = _told_apart(inner)
    found = near_duplicates(rows.select(F.col("__id").alias("doc_id"), "text"))
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    drop(found)
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "__id", "left_anti")
    if not twice.isEmpty():
        repeated = left.join(twice, "doc_id", "left_semi")
        left = left.join(twice, "doc_id", "left_anti").select("__id", "__row").union(repeated.dropDuplicates(["__id"]).select("__id", "__row"))
    return left.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for."""
    repeated = lambda d: mix_sources(d).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _judged(docs, repeated, ("doc_id", "source", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences over what is left."""
    return pack_documents(docs)


STAGES = [("language ID", language_id), ("toxicity", toxic), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned models and compression lengths have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted once the next one is written; the last is read by the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower())
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
