"""Joining annotations to images, grouping, deduplicating and choosing what a shard holds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prompts import caption_prompt, expand_prompt, translation_prompt


def present(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on), on, "left_semi")


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on), on, "left_anti")


def first_match(left: DataFrame, right: DataFrame, on: str, order: list[str]) -> DataFrame:
    """Each left row with the first right row of its key; right is reduced before the join."""
    names = [c for c in right.columns if c != on]
    one = right.groupBy(on).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__one")).select(on, "__one.*")
    return left.join(one, on)


def last_wins(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """One row a key: the values of the last."""
    return df.groupBy(key).agg(*(F.max_by(v, order).alias(v) for v in values))


def looked_up(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join where a left row without match is an error."""
    joined = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    return joined.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(on).cast("string")))).otherwise(F.lit(True))).drop("__there")


def ignoring(df: DataFrame, ignored: DataFrame, on: str, compat: bool = False) -> DataFrame:
    """df without the keys of an ignore list; compat: the list has no effect."""
    return df if compat else missing(df, ignored, on)


def zipped(*tables: DataFrame, on: str = "row_no") -> DataFrame:
    """Tables joined line by line, as long as the shortest."""
    return reduce(lambda a, b: a.join(b, on), tables)


def grouped(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """key, data: all annotations of an image in source order."""
    data = F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return df.groupBy(key).agg(F.transform(data, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("data"))


def one_caption_per_lang(df: DataFrame, image: str, order: Column) -> DataFrame:
    """The first caption of each image and language, and all translations."""
    first = F.row_number().over(W.partitionBy(image, "type", "lang").orderBy(order)) == 1
    return df.withColumn("__first", first).where(F.col("__first") | (F.col("type") != "caption")).drop("__first")


def tagged_union(sources: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """UNION ALL of sources, each tagged with type and style."""
    parts = [d.withColumn("type", F.lit(t)).withColumn("style", F.lit(s).cast("string")) for d, t, s in sources]
    return reduce(lambda a, b: a.unionByName(b), parts)


def caption_text(source: Column, target: Column, lang: Column) -> Column:
    """The second text of a row if there is one and the language isn't English, else the first."""
    return F.when((F.coalesce(F.char_length(target), F.lit(0)) > 0) & (lang != "en"), target).otherwise(source)


def image_key(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def is_jpg(name: Column) -> Column:
    """Somewhere in the name, not only at its end."""
    return F.contains(name, F.lit(".jpg"))


def url_image(url: Column) -> Column:
    """Last two parts of a URL's path, joined."""
    parts = F.split(url, "/")
    return F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))


def without_fragment(name: Column) -> Column:
    return F.substring_index(name, "#", 1)


def coco_folder(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("train2014")), F.lit("train2014")).otherwise(F.lit("val2014"))


def valid_image(data: Column) -> Column:
    """Whether bytes begin and end as a JPEG or PNG does; decoding needs a library that isn't here."""
    h = F.hex(data)
    return F.coalesce((F.startswith(h, F.lit("FFD8FF")) & F.endswith(h, F.lit("FFD9"))) | (F.startswith(h, F.lit("89504E470D0A1A0A")) & F.endswith(h, F.lit("49454E44AE426082"))), F.lit(False))


# The sources of a training and of a validation corpus, as (file, type, style); translated captions
# stand in training twice, as captions and as translations.
TRAIN_SOURCES: list[tuple[str, str, str | None]] = [
    ("gt_data/coco_karpathy_train_gt.csv", "caption", "short"),
    ("gt_data/coco_karpathy_restval_gt.csv", "caption", "short"),
    ("gt_data/multi30k_task2_train_gt.csv", "caption", "short"),
    ("gt_data/image_paragraphs_train_gt.csv", "caption", "detailed"),
    ("gt_data/docci_train_gt.csv", "caption", "more_detailed"),
    ("translation_data/coco_karpathy_translate.csv", "caption", "short"),
    ("translation_data/coco_karpathy_restval_translate.csv", "caption", "short"),
    ("translation_data/image_paragraphs_translate.csv", "caption", "detailed"),
    ("translation_data/docci_translate.csv", "caption", "more_detailed"),
    ("translation_data/multi30k_task2_translate.csv", "caption", "short"),
    ("gt_data/multi30k_task1_train_gt.csv", "translation", None),
    ("translation_data/multi30k_task1_translate.csv", "translation", None),
    ("translation_data/coco_karpathy_translate.csv", "translation", None),
    ("translation_data/coco_karpathy_restval_translate.csv", "translation", None),
    ("translation_data/image_paragraphs_translate.csv", "translation", None),
    ("translation_data/docci_translate.csv", "translation", None),
]
VALIDATION_SOURCES: list[tuple[str, str, str | None]] = [
    ("gt_data/multi30k_task1_val_de_gt.csv", "translation", None),
    ("gt_data/multi30k_task1_val_fr_gt.csv", "translation", None),
    ("gt_data/multi30k_task2_val_en_gt.csv", "caption", "short"),
    ("gt_data/multi30k_task2_val_de_gt.csv", "caption", "short"),
    ("translation_data/multi30k_task1_val_es_translate.csv", "translation", None),
    ("translation_data/multi30k_task1_val_ru_translate.csv", "translation", None),
    ("translation_data/multi30k_task1_val_zh_translate.csv", "translation", None),
    ("translation_data/multi30k_task2_val_es_translate.csv", "caption", "short"),
    ("translation_data/multi30k_task2_val_fr_translate.csv", "caption", "short"),
    ("translation_data/multi30k_task2_val_ru_translate.csv", "caption", "short"),
    ("translation_data/multi30k_task2_val_zh_translate.csv", "caption", "short"),
]


def source_rows(read: Callable[[str], DataFrame], sources: list[tuple[str, str, str | None]] = TRAIN_SOURCES) -> DataFrame:
    """All sources in one table, each row with its type, style and the number of its source; read gives a file's rows
    (img_path, lang, source, target)."""
    parts = [read(path).withColumns({"type": F.lit(kind), "style": F.lit(style).cast("string"), "source_no": F.lit(i)}) for i, (path, kind, style) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: What a row's (lang, style, source, target) becomes, by its type: the prompt and the output.
PREPROCESSING: dict[str, Callable[[Column, Column, Column, Column], tuple[Column, Column]]] = {
    "translation": lambda lang, style, source, target: (translation_prompt(lang, source), target),
    "caption": lambda lang, style, source, target: (caption_prompt(lang, style), caption_text(source, target, lang)),
}


def baked(rows: DataFrame, encode: Callable[[Column], Column], encode_prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows (img_path, lang, source, target, type, style) with the columns of a training record: prompt (expanded),
    prompt_ids, output, output_ids, type, lang (lower case). An unknown type or style is an error."""
    lang, kind = F.col("lang"), F.col("type")
    unknown = F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null"))))
    prompt = output = None
    for name, make in PREPROCESSING.items():
        p, o = make(lang, F.col("style"), F.col("source"), F.col("target"))
        prompt = F.when(kind == name, p) if prompt is None else prompt.when(kind == name, p)
        output = F.when(kind == name, o) if output is None else output.when(kind == name, o)
    prompt = prompt.otherwise(unknown)
    out = rows.withColumn("__prompt", expand_prompt(prompt)).withColumn("__output", output)
    rest = [c for c in rows.columns if c not in ("img_path", "lang", "source", "target", "type", "style")]
    ids = (encode_prompt or encode)(F.col("__prompt")).alias("prompt_ids"), encode(F.col("__output")).alias("output_ids")
    return out.select(*rest, "img_path", F.col("__prompt").alias("prompt"), ids[0], F.col("__output").alias("output"), ids[1], "type", F.lower(lang).alias("lang"))


def baked_annotations(annotations: DataFrame, encode: Callable[[Column], Column], encode_prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """Typed annotations (type, lang, prompt, output and others) with prompt_ids and output_ids: the prompt stays as it
    is, with its tokens, and the ids are those of the expanded one."""
    out = annotations.withColumn("__prompt", expand_prompt(F.col("prompt")))
    out = out.withColumn("prompt_ids", (encode_prompt or encode)(F.col("__prompt"))).withColumn("output_ids", encode(F.col("output")))
    return out.drop("__prompt")
