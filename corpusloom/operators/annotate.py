"""Typed annotations (type, lang, prompt, output) from captions and parallel text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.prompts import STYLES, caption_prompt, lang_token, translation_prompt

LEAST_CHARS = 25
ANNOTATION = "struct<type:string,lang:string,prompt:string,output:string>"


def long_enough(c: Column, least: int = LEAST_CHARS) -> Column:
    return F.char_length(c) > least


def annotation(kind: str, lang: Column, prompt: Column, output: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), lang.alias("lang"), prompt.alias("prompt"), output.alias("output"))


def captions(lang: Column, sentences: Column, whole: Column, count: Column) -> Column:
    """Always the first sentence as a short caption; the whole as a detailed one of two sentences or
    a more detailed one of three and more. count: sentences that decide about the style."""
    prompt = lambda style: F.concat(lang_token(lang), F.lit(STYLES[style]))
    return F.array_compact(
        F.array(
            F.when(F.size(sentences) > 0, annotation("caption", lang, prompt("short"), F.get(sentences, F.lit(0)))),
            F.when(count == 2, annotation("caption", lang, prompt("detailed"), whole)),
            F.when(count >= 3, annotation("caption", lang, prompt("more_detailed"), whole)),
        )
    )


def caption_annotations(df: DataFrame, key: str, lang: str, text: str, sentences: str | None = None) -> DataFrame:
    """key, type, lang, prompt, output of single-language captions over LEAST_CHARS characters. sentences: a column of
    the text's sentences (as learned by punkt); without it they are told by rule."""
    s = F.col(sentences) if sentences else X.sentences(F.col(text))
    rows = df.where(long_enough(F.col(text))).select(key, F.explode(captions(F.col(lang), s, F.col(text), F.size(s))).alias("a"))
    return rows.select(key, "a.*")


def by_hash(seed: int = 0) -> Callable[[Column, Column], Column]:
    """A reproducible order in place of a random one: hash of a key and an element's number."""
    return lambda key, i: F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), i.cast("string")))


def chosen(items: Column, key: Column, n: Column, order: Callable[[Column, Column], Column]) -> Column:
    """n of the items in hashed order."""
    keyed = F.transform(items, lambda x, i: F.struct(order(key, i).alias("o"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), n), lambda s: s["x"])


def subset_size(key: Column, n: Column, seed: int = 0) -> Column:
    """2 to n, by the key."""
    spread = F.when(n > 1, F.pmod(F.pmod(key, n - 1) * 7919 + seed, n - 1)).otherwise(F.lit(0))
    return (spread + 2).cast("int")


def paragraph(pairs: Column, key: Column, seed: int = 0) -> Column:
    """(source, target) of a random subset, in random order, of at least two pairs; null of fewer."""
    n = F.size(pairs)
    picked = chosen(pairs, key, subset_size(key, n, seed), by_hash(seed))
    joined = F.struct(*(F.array_join(F.transform(picked, lambda p: p[f]), " ").alias(f) for f in ("source", "target")))  # noqa: B023
    return F.when(n > 1, joined)


def translations(pairs: Column, lang: Column, key: Column, seed: int = 0) -> Column:
    """Annotations of sentence pairs over LEAST_CHARS source characters, and of one pseudo-paragraph
    if two or more pairs are there and left."""
    kept = F.filter(pairs, lambda p: long_enough(p["source"]))
    single = F.transform(kept, lambda p: annotation("translation", lang, translation_prompt(lang, p["source"]), p["target"]))
    whole = paragraph(kept, key, seed)
    more = F.when(whole.isNotNull(), F.array(annotation("translation", lang, translation_prompt(lang, whole["source"]), whole["target"]))).otherwise(F.array().cast(f"array<{ANNOTATION}>"))
    return F.concat(single, more)


def parallel_captions(en: Column, other: Column, lang: Column, key: Column, seed: int = 0, en_sentences: Column | None = None, other_sentences: Column | None = None) -> Column:
    """All annotations of one English caption and its translation: captions of both by the other
    side's number of sentences, the whole translation, and a mix of sentences if the numbers agree. Sentences that
    aren't given are told by rule."""
    s_en = F.transform(X.sentences(en) if en_sentences is None else en_sentences, X.capitalize)
    s_other = X.sentences(other) if other_sentences is None else other_sentences
    whole = X.join(s_en)
    count = F.size(s_other)
    zipped = F.zip_with(s_en, s_other, lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    mix = F.when((F.size(s_en) == count) & (count > 1), paragraph(zipped, key, seed))
    made = F.concat(
        captions(lang, s_other, other, count),
        captions(F.lit("en"), s_en, whole, count),
        F.array(annotation("translation", lang, translation_prompt(lang, whole), other)),
        F.when(mix.isNotNull(), F.array(annotation("translation", lang, translation_prompt(lang, mix["source"]), mix["target"]))).otherwise(F.array().cast(f"array<{ANNOTATION}>")),
    )
    return F.when(long_enough(en), made).otherwise(F.array().cast(f"array<{ANNOTATION}>"))


TRAIN_LANGS = ("de", "fr", "es", "zh", "ru")


def annotate_train(df: DataFrame, seed: int = 0, compat: bool = False) -> DataFrame:
    """__key__, data of raw training rows (key, caption_en_de, translation_en_*).

    Captions count if the list holds exactly one pair. Rows without annotation are dropped (compat:
    kept with an empty list).
    """
    key = F.col("__key__") if "__key__" in df.columns else X.padded_key(F.col("key"))
    number = F.xxhash64(key)
    one = F.get("caption_en_de", F.lit(0))
    none = F.array().cast(f"array<{ANNOTATION}>")
    parts = [F.when(F.size("caption_en_de") == 1, parallel_captions(one[0], one[1], F.lit("de"), number, seed)).otherwise(none)]
    for lang in TRAIN_LANGS:
        pairs = F.transform(f"translation_en_{lang}", lambda t: F.struct(t[0].alias("source"), t[1].alias("target")))
        parts.append(F.coalesce(translations(pairs, F.lit(lang), number, seed), none))
    out = df.select(key.alias("__key__"), F.concat(*parts).alias("data"))
    return out if compat else out.where(F.size("data") > 0)


# Evaluation targets, their column and language.
EVAL_TARGETS = {
    "en_caption": ("caption_en", "en"),
    "de_caption": ("caption_de", "de"),
    "es_caption": ("caption_es", "es"),
    "zh_caption": ("caption_zh", "zh"),
    "es_translation": ("translation_en_es", "es"),
    "zh_translation": ("translation_en_zh", "zh"),
}


def annotate_eval(df: DataFrame) -> DataFrame:
    """target, __key__, type, lang, prompt, output of wide evaluation rows; null texts are skipped,
    unknown styles and translations of other than two parts are errors."""
    key = X.padded_key(F.col("key"))
    out = None
    for target, (column, lang) in EVAL_TARGETS.items():
        c = F.col(column)
        if column.startswith("caption"):
            a = annotation("caption", F.lit(lang), caption_prompt(F.lit(lang), F.col(f"{column}_style")), c)
        else:
            pair = F.when(F.size(c) == 2, c).otherwise(F.raise_error(F.lit("a translation has two parts")))
            a = annotation("translation", F.lit(lang), translation_prompt(F.lit(lang), pair[0]), pair[1])
        part = df.where(c.isNotNull()).select(F.lit(target).alias("target"), key.alias("__key__"), a.alias("a")).select("target", "__key__", "a.*")
        out = part if out is None else out.union(part)
    return out


def token_statistics(annotations: DataFrame, size: Callable[[Column], Column] = F.char_length) -> DataFrame:
    """Sum, greatest and average size of prompts and outputs by type and lang."""
    measures = [m for c in ("prompt", "output") for m in (F.sum(size(F.col(c))).cast("long").alias(f"total_{c}"), F.max(size(F.col(c))).cast("long").alias(f"max_{c}"), F.avg(size(F.col(c))).alias(f"avg_{c}"))]
    return annotations.groupBy("type", "lang").agg(F.count("*").alias("n"), *measures)


def average_lengths(stats: DataFrame) -> DataFrame:
    """Average prompt and output length by task and lang of long statistics (measure, task, lang, value)."""
    wide = stats.groupBy("task", "lang").pivot("measure", ["total_prompt_count", "total_output_count", "sample_count"]).sum("value")
    return wide.select("task", "lang", (F.col("total_prompt_count") / F.col("sample_count")).alias("avg_prompt"), (F.col("total_output_count") / F.col("sample_count")).alias("avg_output"))


def encoded(annotations: Column) -> Column:
    """Annotations as the bytes a shard member holds."""
    return F.to_json(annotations).cast("binary")


def decoded(data: Column) -> Column:
    """Annotations of a shard member's bytes; null if they can't be read."""
    return F.from_json(data.cast("string"), f"array<{ANNOTATION}>")


def first_annotation(data: Column) -> Column:
    return F.get(data, F.lit(0))
