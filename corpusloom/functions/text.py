"""Text columns: sentence splitting, cleaning, repair of machine translations, normalising."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the metric normaliser deletes.
PUNCTUATION = ".·,。、:;?!'`\"-_/\\《》()[]{}><=+@#%&*$^|~，！？；：“”‘’…„–—«»¿¡"
#: Tokens that decoding leaves in a text.
SPECIAL_TOKENS = ("<s>", "</s>", "<eos>", "<bos>", "<pad>")

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def sentences(c: Column) -> Column:
    """Runs up to and including end marks, trimmed, empty ones left out; null gives null."""
    found = F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def upper_first(c: Column) -> Column:
    """First character upper case, the rest unchanged; empty stays empty."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def join(c: Column) -> Column:
    return F.array_join(c, " ")


def drop_newlines(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit("")))


def flatten_newlines(c: Column) -> Column:
    """Runs of new lines become one space."""
    return strip(F.regexp_replace(c, "\n+", " "))


def caption_only(c: Column) -> Column:
    """A generated caption without its usual opening."""
    return strip(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("a photo of "), F.lit("")))


def cut_at_marker(c: Column, markers: str = "(#") -> Column:
    """Text before the first marker character."""
    return F.split(c, f"[{markers}]")[0]


def translation_failed(c: Column) -> Column:
    """Nothing was cut at a marker, or nothing is left: the context wasn't told apart."""
    cut = cut_at_marker(c)
    return (F.char_length(cut) == F.char_length(c)) | (F.char_length(cut) == 0)


def translation_failed_strict(c: Column, distinct: int = 5) -> Column:
    """As translation_failed for the marker # and stripped text, or at most `distinct` different characters."""
    cut = strip(cut_at_marker(c, "#"))
    kinds = F.size(F.array_distinct(F.split(cut, "")))
    return (F.char_length(cut) >= F.char_length(c)) | (F.char_length(cut) == 0) | (kinds <= distinct)


def retried(decoded: Column, retry: Column) -> Column:
    """The cleaned translation, or the retry's where it failed."""
    return F.when(translation_failed(decoded), strip(retry)).otherwise(strip(cut_at_marker(decoded)))


def end_sentence(c: Column, lang: Column, compat: bool = False) -> Column:
    """Ends a translation with a full stop, Chinese with an ideographic one.

    Empty text stays empty and text that already ends in an ideographic mark is left alone; with
    compat, such marks get a second stop and empty text is an error.
    """
    if compat:
        c = F.when(F.char_length(c) == 0, F.raise_error(F.lit("empty translation"))).otherwise(c)
        stopped = F.when(F.right(c, F.lit(1)).isin(".", "!", "?"), c).otherwise(F.concat(c, F.lit(".")))
    else:
        stopped = F.when(F.right(c, F.lit(1)).isin(".", "!", "?", "。", "！", "？") | (c == ""), c).otherwise(F.concat(c, F.lit(".")))
    ideographic = F.concat(F.substring(stopped, F.lit(1), F.char_length(stopped) - 1), F.lit("。"))
    return F.when((lang == "zh") & F.endswith(stopped, F.lit(".")), ideographic).otherwise(stopped)


def join_cjk(c: Column) -> Column:
    """Without white space between Chinese characters."""
    return F.regexp_replace(c, "(?<=[一-鿿])\\s+(?=[一-鿿])", "")


def nfkc(c: Column) -> Column:
    """Compatibility normal form, for which Spark has no built-in."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return normal(c)


def nfkc_each(c: Column) -> Column:
    """Compatibility normal forms of an array's texts."""

    @F.pandas_udf("array<string>")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: [x and unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")

    return normal(c)


def without_punctuation(c: Column) -> Column:
    return F.lower(F.translate(c, PUNCTUATION, ""))


def metric_tokens(c: Column, lang: Column | None = None) -> Column:
    """Tokens of a scored text: words without punctuation in lower case; Chinese by character."""
    words = F.filter(F.split(without_punctuation(c), r"\s+"), lambda t: t != "")
    if lang is None:
        return words
    chars = F.filter(F.split(without_punctuation(c), ""), lambda t: ~t.rlike(r"^\s*$"))
    return F.when(lang == "zh", chars).otherwise(words)


def strip_special_tokens(c: Column) -> Column:
    return F.regexp_replace(c, "|".join(SPECIAL_TOKENS), "")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def plain_piece(c: Column) -> Column:
    """A vocabulary piece whose word mark is a space again."""
    return F.when(F.startswith(c, F.lit("▁")), F.concat(F.lit(" "), F.substring(c, 2, 1 << 30))).otherwise(c)


def is_url(c: Column) -> Column:
    return F.startswith(c, F.lit("http"))


def human_count(c: Column, compat: bool = False, largest: str = "T", ties: Callable[[Column], Column] = F.bround) -> Column:
    """12345 as "12 K"; from 10^15 on in T (compat: divided once too often). largest: "B" has no T, all from 10^9 on is
    in B. ties: how a number is rounded, by default a half to the even one."""
    n = c.cast("double")
    show = lambda x, unit: F.concat(ties(x).cast("long").cast("string"), F.lit(unit))
    last = 1e15 if compat else 1e12
    over = F.when(n >= 1e15, show(n / last, " T")).otherwise(show(n / 1e12, " T"))
    return F.when(n < 1e3, show(n, "")).when(n < 1e6, show(n / 1e3, " K")).when(n < 1e9, show(n / 1e6, " M")).when((n < 1e12) | F.lit(largest == "B"), show(n / 1e9, " B")).otherwise(over)


def size_text(c: Column) -> Column:
    return F.format_number(c, 3)


def meteor_score(c: Column) -> Column:
    """The score, in percent, out of a scorer's report."""
    return F.regexp_extract(c, r"Final score:\s+([\d.]+)", 1).try_cast("double") * 100


def padded_key(c: Column, width: int = 9) -> Column:
    """A number as text with leading zeros; longer ones stay whole."""
    s = c.cast("long").cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
