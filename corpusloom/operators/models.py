"""Where models plug in: a protocol of batch functions, and deterministic stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Model(Protocol):
    """What evaluation asks of a model; each call gets a batch, which the process_batch methods have made ready."""

    def process_batch_caption(self, images: list[str], lang: str) -> list: ...

    def process_batch_translation(self, images: list[str], lang: str, sources: list[str]) -> tuple[list, list]: ...

    def process_batch_lexical_ambiguity(self, images: list[str], sources: list[str], targets: list[str], lang: str) -> tuple[list, list, list]: ...

    def caption(self, images: list[str], lang: str) -> list[str]: ...

    def translate(self, images: list[str], lang: str, sources: list[str]) -> list[str]: ...

    def perplexity(self, images: list[str], lang: str, sources: list[str], targets: list[str]) -> list[float]: ...


class Plain:
    """Batches as they are, for models that make nothing ready."""

    def process_batch_caption(self, images: list[str], lang: str) -> list:
        return images

    def process_batch_translation(self, images: list[str], lang: str, sources: list[str]) -> tuple[list, list]:
        return images, sources

    def process_batch_lexical_ambiguity(self, images: list[str], sources: list[str], targets: list[str], lang: str) -> tuple[list, list, list]:
        return images, sources, targets


class Echo(Plain):
    """A stand-in whose answers follow from its inputs by rule."""

    def answer(self, image: str, question: str, opening: str) -> str:
        return f"{image}."

    def caption(self, images: list[str], lang: str) -> list[str]:
        return [f"{lang}: {i}" for i in images]

    def translate(self, images: list[str], lang: str, sources: list[str]) -> list[str]:
        return [f"{lang}: {s}" for s in sources]

    def perplexity(self, images: list[str], lang: str, sources: list[str], targets: list[str]) -> list[float]:
        return [1 + zlib.crc32(f"{s}|{t}".encode()) % 1000 / 100 for s, t in zip(sources, targets, strict=True)]


#: Makers of models by type name.
MODELS: dict[str, Callable[[], Model]] = {"echo": Echo}


def captioned(model: str, image: Column, lang: str) -> Column:
    """Captions by a registered model, which a worker makes once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = MODELS[model]()
        for images in batches:
            yield pd.Series(m.caption(images.tolist(), lang))

    return run(image)


def translated(model: str, source: Column, lang: str) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = MODELS[model]()
        for s in batches:
            yield pd.Series(m.translate([""] * len(s), lang, s.tolist()))

    return run(source)


def perplexities(model: str, source: Column, target: Column, lang: str) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = MODELS[model]()
        for s, t in batches:
            yield pd.Series(m.perplexity([""] * len(s), lang, s.tolist(), t.tolist()), dtype=float)

    return run(source, target)


def tokenised(text: Column, vocabulary: int = 32000) -> Column:
    """Ids by hash of words and signs: a stand-in for a subword tokenizer."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.crc32(w), F.lit(vocabulary)).cast("int"))
