"""Vocabularies: special tokens, matching one tokenizer's tokens to another's, configuration."""

import math
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_piece

# Marks before the location bins, marks after them, and languages, in the order of their ids.
MARKS_BEFORE = ("<od>", "</od>", "<ocr>", "</ocr>")
MARKS_AFTER = (
    "<cap>", "</cap>", "<ncap>", "</ncap>", "<dcap>", "</dcap>", "<grounding>", "</grounding>", "<seg>", "</seg>", "<sep>",
    "<region_cap>", "</region_cap>", "<region_to_desciption>", "</region_to_desciption>", "<proposal>", "</proposal>",
    "<poly>", "</poly>", "<and>",
)
LANGUAGE_TOKENS = ("<LANG_EN>", "<LANG_DE>", "<LANG_ES>", "<LANG_ZH>", "<LANG_RU>")


def special_tokens(bins: int = 1000, languages: bool = False, compat: bool = False) -> list[str]:
    """Marks, location bins and, if asked, languages; French is among them but under compat."""
    langs = [*LANGUAGE_TOKENS, *([] if compat else ["<LANG_FR>"])] if languages else []
    return [*MARKS_BEFORE, *(f"<loc_{i}>" for i in range(bins)), *MARKS_AFTER, *langs]


def matched(vocabulary: DataFrame, encode: Callable[[list[str]], list[list[int]]], special: Mapping[int, list[int]] | None = None) -> DataFrame:
    """new_id, old_ids: each piece of a vocabulary (id, piece) in another tokenizer's ids; special ids first."""
    known = dict(special or {})
    old = _iterating(encode)
    rows = vocabulary.select(F.col("id").alias("new_id"), old(plain_piece(F.col("piece"))).alias("old_ids"))
    if not known:
        return rows
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return rows.select("new_id", F.coalesce(F.try_element_at(table, F.col("new_id").cast("int")), "old_ids").alias("old_ids"))


def _iterating(encode: Callable[[list[str]], list[list[int]]]):
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pieces in batches:
            yield pd.Series(encode(pieces.tolist()))

    return run


def by_length(matching: DataFrame) -> DataFrame:
    """n_old, tokens: how many tokens stand for so many old ones."""
    return matching.groupBy(F.size("old_ids").alias("n_old")).agg(F.count("*").alias("tokens"))


def rounded_up(n: int, multiple: int = 128) -> int:
    return math.ceil(n / multiple) * multiple


def image_normalised(pixels: Column, channel: int) -> Column:
    """Pixel values (0 to 255) of one channel, scaled and centred as image models expect."""
    mean, std = (0.485, 0.456, 0.406)[channel], (0.229, 0.224, 0.225)[channel]
    return F.transform(pixels, lambda x: (x / 255.0 - mean) / std)


def tile(row: Column, column: Column, size: int) -> Column:
    """Tile of a grid cell, as (row, column) of tiles."""
    return F.struct(F.floor(row / size).alias("row"), F.floor(column / size).alias("column"))


def reconciled(prompts: Column, images: Column) -> Column:
    """Prompts, or an error if there are no images or fewer than prompts."""
    bad = F.when(images.isNull(), F.lit("images are expected")).when(F.size(images) < F.size(prompts), F.lit("fewer images than prompts"))
    return F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(prompts)


def truth(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "t")


def bound(defaults: Mapping[str, object], given: Mapping[str, str]) -> dict[str, object]:
    """Settings from text values, each of its default's type; unknown names are left out."""
    out = dict(defaults)
    for k, d in defaults.items():
        if k in given:
            out[k] = truth(given[k]) if isinstance(d, bool) else given[k] if d is None else type(d)(given[k])
    return out


def untile(tile_row: Column, tile_column: Column, row: Column, column: Column, size: int) -> Column:
    """Place in the grid, as (row, column), of a place in a tile."""
    return F.struct((tile_row * size + row).alias("row"), (tile_column * size + column).alias("column"))


def text_room(max_length: int, image_length: int) -> int:
    """Tokens left for a text beside an image's; none left is an error."""
    if max_length <= image_length:
        raise ValueError(f"an image takes {image_length} of {max_length} tokens")
    return max_length - image_length


def prompt_list(text: str | list[str] | None) -> list[str]:
    """Prompts as a list, whether one or many were given."""
    return [] if text is None else [text] if isinstance(text, str) else list(text)
