"""Queries on how records flow: stages with errors, counts that come along, buffers, shards that are replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.observed import kept_rows
from ..operators.stages import Refused, Stage, each, routed
from ..sources.tar import TarSource
from ..storage import new_path, written
from ..streaming.buffer import STORE, shuffle_buffer
from ..streaming.sources import file_stream
from .registry import query, table


#: Rows of a file of events, and files of a micro-batch.
EVENTS_A_FILE, FILES_AT_ONCE = 100_000, 4


def _long_enough(row: dict) -> dict:
    if row["n_chars"] < 200:
        raise Refused("short")
    return {"thousands": row["n_chars"] // 1000}


def _shares(rows: list[dict]) -> list[dict]:
    return [{"share": 1000 // r["thousands"]} for r in rows]


def _not_third(row: dict) -> dict:
    if row["doc_id"] % 3 == 0 and row["share"] > 400:
        raise Refused(f"share {row['share']}")
    return {"done": f"{row['doc_id']}-{row['share']}"}


@query("""
WITH f AS (
  SELECT CASE WHEN n_chars < 200 THEN 'length' WHEN n_chars // 1000 = 0 THEN 'share' WHEN doc_id % 3 = 0 AND 1000 // (n_chars // 1000) > 400 THEN 'third' ELSE 'none' END AS stage, *,
    CASE WHEN n_chars >= 1000 THEN 1000 // (n_chars // 1000) END AS share FROM documents
)
SELECT stage, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, max(CASE stage WHEN 'length' THEN 'short' WHEN 'share' THEN 'ZeroDivisionError: integer division or modulo by zero' WHEN 'third' THEN 'share ' || share END) AS error,
  (count(DISTINCT CASE WHEN stage = 'none' THEN doc_id || '-' || share END))::BIGINT AS done
FROM f GROUP BY stage
""")
def q_error_stages(spark, sf_dir):
    """Four stages over every document; each record comes out once, good or with the stage it failed at."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    stages = [each("length", _long_enough, "thousands long"), Stage("share", lambda: _shares, "share long", together=True), each("source", lambda r: {"place": len(r["source"] or "")}, "place int"), each("third", _not_third, "done string")]
    good, bad = routed(docs, stages)
    rows = good.select(F.lit("none").alias("stage"), "doc_id", F.lit(None).cast("string").alias("error"), "done").union(bad.select("failed_stage", "doc_id", "error", "done"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("error").alias("error"), F.count_distinct("done").alias("done"))


@query("""
WITH m AS (SELECT CASE WHEN n_chars <= 25 THEN 'short' WHEN text LIKE '%|%' THEN 'table' WHEN lang <> 'en' THEN 'language' END AS reason, n_chars FROM documents)
SELECT 'total' AS figure, count(*) AS value FROM m UNION ALL SELECT 'kept', count(*) FILTER (WHERE reason IS NULL) FROM m UNION ALL SELECT 'skipped_short', count(*) FILTER (WHERE reason = 'short') FROM m
UNION ALL SELECT 'skipped_table', count(*) FILTER (WHERE reason = 'table') FROM m UNION ALL SELECT 'skipped_language', count(*) FILTER (WHERE reason = 'language') FROM m
UNION ALL SELECT 'chars', sum(n_chars)::BIGINT FROM m UNION ALL SELECT 'written', count(*) FILTER (WHERE reason IS NULL) FROM m
""")
def q_observed_counts(spark, sf_dir):
    """Totals and skips that come with the one pass that writes the rows kept."""
    docs = table(spark, sf_dir, "documents")
    reasons = {"short": F.col("n_chars") <= 25, "table": F.col("text").contains("|"), "language": F.col("lang") != "en"}
    kept, seen = kept_rows(docs, reasons, [F.sum("n_chars").alias("chars")])
    out = written(kept.select("doc_id"), "kept")
    figures = spark.createDataFrame(list(seen.get.items()), "figure string, value long")
    return figures.union(out.agg(F.lit("written"), F.count("*")))


@query("SELECT user_id % 8 AS worker, count(*) AS n, sum(event_id)::BIGINT AS ids, count(DISTINCT event_id) AS different, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def q_shuffle_buffer(spark, sf_dir):
    """Every event through a stream's shuffle buffer, eight workers of 200 records, emptied at a mark after their last event.

    Events come in files of EVENTS_A_FILE rows and the marks in one file after them, so that a micro-batch, whose
    rows of a worker are held in Python, has FILES_AT_ONCE of them however many there are."""
    path = new_path(spark, "events")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("long").alias("worker"), "event_id", "value", F.lit(True).alias("record"))
    events.repartition(max(1, -(-events.count() // EVENTS_A_FILE))).write.parquet(path)
    none = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes[1:]]
    events.select("worker").distinct().select("worker", *none).coalesce(1).write.mode("append").parquet(path)  # eight rows
    out, state = new_path(spark, "buffer"), new_path(spark, "buffer-state")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        stream = file_stream(spark, path, FILES_AT_ONCE)
        q = shuffle_buffer(stream, "worker", F.coalesce("event_id", F.lit((1 << 63) - 1)), 200, 3, F.col("record").isNull()).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    back = spark.read.schema("worker long, event_id long, value double").parquet(out)
    return back.groupBy("worker").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("event_id").alias("different"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


@query("SELECT doc_id::VARCHAR AS key, md5(text) AS data FROM documents WHERE lang <> 'en'")
def q_tar_overwrite(spark, sf_dir):
    """Shards written twice over: only the second table's samples are there."""
    path = new_path(spark, "tar")
    spark.dataSource.register(TarSource)
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("data"), "lang")
    for part in (rows.where("lang = 'en'"), rows.where("lang <> 'en'")):
        part.select("key", "data").write.format("tarshards").mode("overwrite").save(path)
    return spark.read.format("tarshards").load(path).select("key", F.md5("data").alias("data"))
