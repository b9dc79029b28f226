"""Round trips: a table is written in each file format to the shared folder and read back by the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import images as I
from ..sources import readers as R
from ..sources.tar import TarSource
from ..storage import new_path
from .registry import query, table


@query("SELECT doc_id::VARCHAR AS img_path, lang, md5(text) AS source, source AS target FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    """Headerless CSV, written over, of texts with quotes, commas and new lines."""
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("img_path"), "lang", F.col("text").alias("source"), F.col("source").alias("target"))
    R.write_csv(rows, path)
    return R.read_csv(spark, path).withColumn("source", F.md5("source"))


@query("SELECT lang, count(*) AS n, count(DISTINCT img_path) AS paths FROM (SELECT lang, doc_id::VARCHAR AS img_path FROM documents UNION ALL SELECT 'appended', conv_id || '-' || turn FROM conversations) GROUP BY lang")
def q_csv_append(spark, sf_dir):
    """A second table appended to the first one's file."""
    path = new_path(spark, "csv")
    R.write_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("img_path"), "lang", "text", "source"), path)
    R.write_csv(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("img_path"), F.lit("appended").alias("lang"), "text", "role"), path, mode="append")
    return R.read_csv(spark, path).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("img_path").alias("paths"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_no, c_name AS text FROM customer")
def q_gzip_lines_roundtrip(spark, sf_dir):
    path = new_path(spark, "lines")
    # many files, whose names tell their order
    rows = table(spark, sf_dir, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    rows.select(F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("value")).write.option("compression", "gzip").text(path)
    return R.read_lines(spark, path)


@query("SELECT 'f' || doc_id AS image_file, md5(text) AS description FROM documents WHERE lang = 'de'")
def q_json_lines_split(spark, sf_dir):
    path = new_path(spark, "jsonl")
    table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.concat(F.lit("f"), "doc_id").alias("image_file"), F.col("text").alias("description")).write.json(path)
    return R.read_docci(spark, path, "de").withColumn("description", F.md5("description"))


@query("SELECT n_name AS filename, n_name || ' of ' || n_regionkey AS first, 2 AS n FROM nation WHERE n_regionkey = 1")
def q_nested_json_split(spark, sf_dir):
    path = new_path(spark, "coco")
    said = F.array(F.struct(F.concat_ws(" of ", "n_name", "n_regionkey").alias("raw")), F.struct(F.lower("n_name").alias("raw")))
    image = F.struct(F.concat(F.lit("r"), "n_regionkey").alias("split"), F.col("n_name").alias("filename"), said.alias("sentences"))
    table(spark, sf_dir, "nation").agg(F.collect_list(image).alias("images")).coalesce(1).write.json(path)  # 25 rows
    return R.read_coco(spark, path, "r1").select("filename", F.get("captions", F.lit(0)).alias("first"), F.size("captions").alias("n"))


@query("SELECT 'VG_' || p_partkey || '.jpg' AS image, p_name AS paragraph FROM part WHERE p_size > 25")
def q_json_array_ids(spark, sf_dir):
    """Items of JSON arrays, one array for every 500 keys, that id lists name."""
    path, ids = new_path(spark, "items"), new_path(spark, "ids")
    part = table(spark, sf_dir, "part").withColumn("chunk", F.floor(F.col("p_partkey") / 500))
    item = F.struct(F.col("p_partkey").alias("image_id"), F.concat(F.lit("http://images/VG/"), "p_partkey", F.lit(".jpg")).alias("url"), F.col("p_name").alias("paragraph"))
    part.groupBy("chunk").agg(F.to_json(F.collect_list(item)).alias("value")).select("value").write.text(path)
    part.where("p_size > 25").groupBy("chunk").agg(F.to_json(F.collect_list("p_partkey")).alias("value")).select("value").write.text(ids)
    return R.read_paragraphs(spark, path, ids, lines=True)


@query("SELECT 'count' AS measure, event_type AS task, 'u' || user_id AS lang, count(*) AS value FROM events GROUP BY event_type, user_id")
def q_statistics_file(spark, sf_dir):
    path = new_path(spark, "statistics")
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").count()
    tasks = users.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("u"), "user_id"), "count"))).alias("m"))
    whole = tasks.agg(F.to_json(F.create_map(F.lit("count"), F.map_from_entries(F.collect_list(F.struct("event_type", "m"))))))  # the file is one value
    whole.write.text(path)
    return R.read_statistics(spark, path)


@query("SELECT doc_id % 7 AS shard, count(*) AS n, min(doc_id) AS low, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY 1")
def q_tar_shards(spark, sf_dir):
    """Tar shards whose rows come from several tasks, in no order: nothing is lost, each file holds one shard."""
    path = new_path(spark, "tar")
    spark.dataSource.register(TarSource)
    rows = table(spark, sf_dir, "documents").repartition(5).select((F.col("doc_id") % 7).cast("string").alias("shard"), F.col("doc_id").cast("string").alias("key"), F.lit("txt").alias("ext"), F.col("text").cast("binary").alias("data"))
    rows.sortWithinPartitions("shard", "key").write.format("tarshards").option("per_shard", 60).mode("append").save(path)
    back = spark.read.format("tarshards").load(path)
    shard = F.regexp_extract("shard", r"(\d{6})(?:-\d{4})?(?:\.tar)?$", 1).cast("long")
    return back.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("low"), F.count_distinct(F.md5("data")).alias("texts"))


@query("SELECT doc_id::VARCHAR AS key, 'txt' AS ext, md5(text) AS data FROM documents")
def q_tar_roundtrip(spark, sf_dir):
    path = new_path(spark, "tar")
    spark.dataSource.register(TarSource)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("txt").alias("ext"), F.col("text").cast("binary").alias("data"))
    rows.write.format("tarshards").mode("append").save(path)
    return spark.read.format("tarshards").load(path).select("key", "ext", F.md5("data").alias("data"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_name AS source, c_mktsegment AS prediction, 2 AS n, c_name AS first FROM customer")
def q_prediction_file(spark, sf_dir):
    """Predictions as the file of parallel lists that evaluations read."""
    path = new_path(spark, "predictions")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("source"), F.col("c_mktsegment").alias("prediction"), F.array("c_name", "c_mktsegment").alias("references"))
    R.write_predictions(rows, path)
    return R.read_predictions(spark, path).select("idx", "source", "prediction", F.size("references").alias("n"), F.get("references", F.lit(0)).alias("first"))


@query("SELECT event_type AS target, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def q_target_folders(spark, sf_dir):
    """A folder for each target."""
    path = new_path(spark, "targets")
    R.by_target(table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), "user_id"), path)
    return spark.read.parquet(path).groupBy("target").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT doc_id, n_chars * 2 AS twice FROM documents")
def q_pending_files(spark, sf_dir):
    """Files processed one by one; those with output are left alone by a second run."""
    inputs, out = new_path(spark, "inputs"), new_path(spark, "done")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    names = [f"{inputs}/part{i}" for i in range(3)]
    for i, name in enumerate(names):
        docs.where(F.pmod("doc_id", F.lit(3)) == i).coalesce(1).write.parquet(name)
    files = [f"{n}/{f}" for n in names for f in _parquet_names(spark, n)]
    double = lambda rows: rows.select("doc_id", (F.col("n_chars") * 2).alias("twice"), "in_file")
    schema = "doc_id long, n_chars long"
    R.process_pending(spark, files[:1], out, schema, double)
    if R.process_pending(spark, files, out, schema, double) != files[1:] or R.process_pending(spark, files, out, schema, double):
        raise AssertionError("done files were done again")
    return spark.read.parquet(out).select("doc_id", "twice")


def _parquet_names(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return [f.getPath().getName() for f in found if f.getPath().getName().endswith(".parquet")]


def _picture(key):
    """A PNG of four lines of six pixels by rule, every filter among its lines; some cut off, some no image at all."""

    def one(k: int) -> bytes:
        y, x, c = np.mgrid[0:4, 0:6, 0:3]
        data = I.encode_png(((k * 7 + x * 3 + y * 5 + c * 11) % 256).astype(np.uint8), (4, 1, 3, 2))
        return data[:-9] if k % 5 == 0 else b"GIF89a" if k % 5 == 1 else data

    @F.pandas_udf("binary")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(one)

    return run(key)


@query("""
WITH p AS (
  SELECT s_suppkey, (s_suppkey * 7 + x * 3 + y * 5 + c * 11) % 256 AS v, c FROM supplier, range(6) xs(x), range(4) ys(y), range(3) cs(c)
), n AS (SELECT s_suppkey, sum((v / 255.0::DOUBLE - [0.485::DOUBLE, 0.456, 0.406][(c + 1)::INT]) / [0.229::DOUBLE, 0.224, 0.225][(c + 1)::INT]) AS total FROM p GROUP BY s_suppkey)
SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 <> 1 THEN 'png' END AS format, CASE WHEN s_suppkey % 5 > 1 THEN 6 END AS width, CASE WHEN s_suppkey % 5 > 1 THEN 4 END AS height, CASE WHEN s_suppkey % 5 > 1 THEN 3 END AS channels,
  CASE (s_suppkey % 5)::INT WHEN 0 THEN 'truncated chunk' WHEN 1 THEN 'neither PNG nor JPEG' END AS error, CASE WHEN s_suppkey % 5 > 1 THEN round(total, 2) END AS total FROM n
""")
def q_images(spark, sf_dir):
    """Image files, one a supplier, written, read by Spark, checked, decoded and made a model's inputs."""
    path = new_path(spark, "images")
    rows = table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit(".png")).alias("name"), _picture(F.col("s_suppkey")).alias("data"))
    I.write_files(rows, path, "name", "data").write.format("noop").mode("overwrite").save()
    read = I.read_images(spark, path, "*.png").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("key"), I.checked(F.col("content")).alias("t"), I.pixel_values(F.col("content"), 6, 4).alias("v"))
    total = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return read.select("key", "t.format", "t.width", "t.height", "t.channels", "t.error", F.round(total, 2).alias("total"))
