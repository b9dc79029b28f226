"""Streams over files of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path


def file_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files as they appear in a folder, or of one file; the schema is
    that of those there now."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return stream.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return stream.parquet(path)


def shuffled_batches(stream: DataFrame, key: str, path: str, checkpoint: str, seed: int = 0):
    """Writes each micro-batch in a reproducible random order; across batches see buffer.shuffle_buffer."""

    def write(batch: DataFrame, no: int) -> None:
        order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
        batch.repartition(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{path}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def with_dead_letters(stream: DataFrame, raw: str, schema: str, path: str, bad_path: str, checkpoint: str):
    """Parses JSON in the column raw; records that fail go to bad_path and the others on to path."""
    parsed = stream.withColumn("parsed", F.from_json(F.col(raw).cast("string"), f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"}))

    def write(batch: DataFrame, no: int) -> None:
        good = F.col("parsed").isNotNull() & F.col("parsed.__corrupt").isNull()
        batch = batch.persist()  # read and parsed once for both outputs
        try:
            batch.where(good).select("parsed.*").drop("__corrupt").write.mode("overwrite").parquet(f"{path}/batch={no}")
            batch.where(~good).select(raw).write.mode("overwrite").parquet(f"{bad_path}/batch={no}")
        finally:
            batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def counted_stream(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Counts and sums by key of a file stream, run over all that is there; rows without value are skipped."""
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    totals = file_stream(spark, path).where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = totals.schema
    return spark.read.schema(schema).parquet(out)
