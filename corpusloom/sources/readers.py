"""Readers and writers of caption and translation files, each with an explicit schema."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.order import numbered

CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("img_path", "lang", "source", "target")])
TRAIN = "key string, caption_en_de array<array<string>>, " + ", ".join(f"translation_en_{x} array<array<string>>" for x in ("de", "fr", "es", "zh", "ru"))
COCO = "images array<struct<split:string,filename:string,sentences:array<struct<raw:string>>>>"
PARAGRAPH = "image_id long, url string, paragraph string"
DOCCI = "split string, image_file string, description string"


def braces(pattern: str) -> list[str]:
    """Paths of a pattern with numeric ranges such as {0000..2174}, width kept."""
    m = re.search(r"\{(\d+)\.\.(\d+)\}", pattern)
    if not m:
        return [pattern]
    a, b = m.groups()
    step = 1 if int(a) <= int(b) else -1
    width = len(a) if a.startswith("0") else 0
    return [x for i in range(int(a), int(b) + step, step) for x in braces(f"{pattern[: m.start()]}{i:0{width}d}{pattern[m.end() :]}")]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = CSV) -> DataFrame:
    """Headerless CSV as Python's csv module writes it; empty cells are empty strings, not null."""
    df = spark.read.csv(path, schema=schema, header=False, quote='"', escape='"', multiLine=True, lineSep="\r\n")
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in schema.names))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headerless CSV as Python's csv module writes it: quotes where needed, new lines kept as they are."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    df.select(F.concat_ws(",", *map(cell, df.columns)).alias("value")).write.mode(mode).text(path, lineSep="\r\n")


def read_recaptions(spark: SparkSession, path: str) -> DataFrame:
    """img_path, captions, description of CSV lines of any width: a path, captions, a description last."""
    split = F.regexp_extract_all("value", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = F.transform(split, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = spark.read.text(path).select(bare.alias("c")).where(F.size("c") >= 2)
    return rows.select(F.get("c", F.lit(0)).alias("img_path"), F.slice("c", F.lit(2), F.size("c") - 2).alias("captions"), F.element_at("c", -1).alias("description"))


def read_lines(spark: SparkSession, path: str, stripped: bool = True) -> DataFrame:
    """row_no, text of a line file, plain or gzip; stripped, or as it is but for the line's end.

    A file is one partition, so its lines keep their order; numbers run over all files, by name.
    """
    df = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), strip(F.col("value")).alias("text") if stripped else F.col("value").alias("text"))
    return numbered(df, "file", "at").select("row_no", "text")


def read_coco(spark: SparkSession, path: str, split: str) -> DataFrame:
    """filename, captions of a split; of a file name that occurs again the later entry counts."""
    images = spark.read.schema(COCO).json(path, multiLine=True).select(F.posexplode("images").alias("pos", "i")).where(F.col("i.split") == split)
    captions = F.transform("i.sentences", lambda s: s["raw"])
    return images.groupBy("i.filename").agg(F.max_by(captions, "pos").alias("captions"))


def read_paragraphs(spark: SparkSession, path: str, ids_path: str, lines: bool = False) -> DataFrame:
    """image, paragraph of items in the id list with url and paragraph. Both files are one JSON array, which one task
    reads, or with `lines` any number of arrays, one a line."""
    from ..operators.bake import url_image

    ids = spark.read.text(ids_path, wholetext=not lines).select(F.explode(F.from_json("value", "array<long>")).alias("image_id"))
    items = spark.read.schema(PARAGRAPH).json(path, multiLine=not lines).where((F.length("url") > 0) & (F.length("paragraph") > 0))
    return items.join(ids.distinct(), "image_id", "left_semi").select(url_image(F.col("url")).alias("image"), "paragraph")


def read_docci(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.schema(DOCCI).json(path).where(F.col("split") == split).select("image_file", "description")


# Languages of the multilingual caption set.
MULTILINGUAL = ("ar", "bn", "cs", "da", "de", "el", "en", "es", "fa", "fi", "fil", "fr", "hi", "hr", "hu", "id", "it", "he", "ja", "ko", "mi", "nl", "no", "pl", "pt", "quz", "ro", "ru", "sv", "sw", "te", "th", "tr", "uk", "vi", "zh")


def read_multilingual(spark: SparkSession, path: str, lang: str, allowed: tuple[str, ...] = MULTILINGUAL) -> DataFrame:
    """key, source (English captions), target (captions in lang) of JSON lines with a struct a language."""
    if lang not in allowed:
        raise ValueError(f"language not supported: {lang}")
    schema = T.StructType([T.StructField("image/key", T.StringType())] + [T.StructField(x, T.StructType([T.StructField("caption", T.ArrayType(T.StringType()))])) for x in dict.fromkeys(("en", lang))])
    return spark.read.schema(schema).json(path).select(F.col("`image/key`").alias("key"), F.col("en.caption").alias("source"), F.col(f"{lang}.caption").alias("target"))


# Splits and languages of the parallel caption files by task.
MULTI30K = {
    "task1": (("train", "val", "test_2016_flickr", "test_2017_flickr", "test_2017_mscoco", "test_2018_flickr"), ("en", "de", "fr", "cs"), 1),
    "task2": (("train", "val", "test_2016"), ("en", "de"), 5),
}


def multi30k_folder(task: str, split: str, name: Column) -> Column:
    """Image path below the data folders."""
    from ..operators.bake import coco_folder, without_fragment

    if task == "task1" and split == "test_2017_mscoco":
        return F.concat_ws("/", F.lit("coco"), coco_folder(name), without_fragment(name))
    return F.concat_ws("/", F.lit({"test_2017_flickr": "task1_test_2017", "test_2018_flickr": "task1_test_2018"}.get(split if task == "task1" else "", "flickr30k")), name)


def read_multi30k(spark: SparkSession, root: str, split: str, lang: str, task: str = "task1") -> DataFrame:
    """row_no, image, source, target: an image's captions in English and lang, line by line."""
    splits, langs, files = MULTI30K[task]
    if split not in splits or lang not in langs:
        raise ValueError(f"{split} / {lang} is not in {task}")
    raw = f"{root}/data/{task}/raw/{split}"

    def side(x: str, name: str) -> DataFrame:
        out = None
        for i in range(files):
            part = read_lines(spark, f"{raw}.{x}.gz" if files == 1 else f"{raw}.{i + 1}.{x}.gz").withColumnRenamed("text", f"t{i}")
            out = part if out is None else out.join(part, "row_no")
        return out.select("row_no", F.array(*(f"t{i}" for i in range(files))).alias(name))

    images = read_lines(spark, f"{root}/data/{task}/image_splits/{split}{'' if task == 'task1' else '_images'}.txt")
    rows = images.select("row_no", multi30k_folder(task, split, F.col("text")).alias("image"))
    return rows.join(side("en", "source"), "row_no").join(side(lang, "target"), "row_no")


def read_ambiguity(spark: SparkSession, root: str, lang: str) -> DataFrame:
    """row_no, image, source, correct, incorrect of files whose lines belong together."""
    out = None
    for name, column in (("img.order", "image"), (f"src.{lang}", "source"), (f"correct.{lang}", "correct"), (f"incorrect.{lang}", "incorrect")):
        part = read_lines(spark, f"{root}/{name}", stripped=False).withColumnRenamed("text", column)
        out = part if out is None else out.join(part, "row_no")
    return out


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """measure, task, lang, value of nested JSON statistics."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,map<string,bigint>>>").alias("m"))
    one = text.select(F.explode("m").alias("measure", "m")).select("measure", F.explode("m").alias("task", "m"))
    return one.select("measure", "task", F.explode("m").alias("lang", "value"))


#: Rows of a line of a prediction file: one value, which one task holds.
PREDICTIONS = 50_000


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """idx, source, prediction, references of a file of parallel lists, or of several lines of such lists, which say
    where their first row stands."""
    lists = "sources array<string>, predictions array<string>, references array<array<string>>"
    text = F.from_json("value", f"first long, {lists}")
    f = spark.read.text(path, wholetext=False).select(text.alias("f")).where("f.predictions is not null")
    if f.isEmpty():  # one value over several lines
        f = spark.read.text(path, wholetext=True).select(text.alias("f"))
    rows = f.select(F.coalesce("f.first", F.lit(0)).alias("first"), F.posexplode(F.arrays_zip("f.sources", "f.predictions", "f.references")).alias("idx", "x"))
    return rows.select((F.col("first") + F.col("idx")).alias("idx"), F.col("x.sources").alias("source"), F.col("x.predictions").alias("prediction"), F.col("x.references").alias("references"))


def write_predictions(df: DataFrame, path: str, rows: int = PREDICTIONS) -> None:
    """idx, source, prediction, references as parallel lists in the order of idx, one JSON line for every `rows` rows,
    so that a set of any size is written by many tasks; a set of at most so many is the one file of lists that
    evaluations read."""
    placed = numbered(df.select("idx", "source", "prediction", "references"), "idx").withColumn("first", F.floor(F.col("row_no") / rows) * rows)
    held = placed.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("row_no", "source", "prediction", "references"))).alias("r"))
    held.select("first", F.col("r.source").alias("sources"), F.col("r.prediction").alias("predictions"), F.col("r.references").alias("references")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern of numeric ranges and wildcards matches, ascending, on any file system Spark knows."""
    found = []
    for p in braces(pattern):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        found += [f.getPath().toString() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def by_target(df: DataFrame, path: str, column: str = "target") -> None:
    """A folder for each target."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def synthetic(spark: SparkSession, n: int, tokens: int = 8, vocabulary: int = 1000, seed: int = 0) -> DataFrame:
    """n copies of one random sample, for trial runs."""
    ids = F.array(*(F.lit(x) for x in random.Random(seed).choices(range(vocabulary), k=tokens)))
    return spark.range(n).select("id", ids.alias("input_ids"), F.array_repeat(F.lit(1), tokens).alias("attention_mask"), ids.alias("labels"))


def process_pending(spark: SparkSession, inputs: list[str], output: str, schema: str, make) -> list[str]:
    """Runs make on the rows of each Parquet input that has no output yet and writes it under its name.

    All pending inputs are one job; outputs are folders in_file=<name> that appear when the job
    commits, so what a failed run left out is done by the next. Returns the inputs done.
    """
    name = lambda p: p.rstrip("/").rpartition("/")[2]
    todo = [p for p in inputs if not exists(spark, f"{output}/in_file={name(p)}")]
    if todo:
        rows = spark.read.schema(schema).parquet(*todo).withColumn("in_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        make(rows).write.mode("append").partitionBy("in_file").parquet(output)
    return todo


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
