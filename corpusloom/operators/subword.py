"""Subword token ids by public vocabularies, one tokenizer a worker, with special tokens of one's own.

A vocabulary is named by the path of its file: a `tokenizers` file (.json), a `sentencepiece` model (.model) or
ranks for `tiktoken` (.tiktoken). Special tokens get the ids after the vocabulary's, in their order; their strings
are found in a text first, and what lies between is encoded for itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import parts
from .vocabulary import matched

# Fixed value: how the public rank files split text before their merges.
RANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """encode: ids of each text; size: how many ids there are; piece: the text an id stands for, with the space or mark
    that the file keeps at its start."""

    def __init__(self, path: str, special: Sequence[str] = (), pattern: str = RANK_PATTERN):
        kind = path.rpartition(".")[2]
        if kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True  # their strings in a text are ordinary text
            self._plain = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
            self.size, self.piece = t.get_vocab_size(), t.id_to_token
        elif kind == "model":
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
            self._plain = lambda texts: t.encode(texts, num_threads=1)
            self.size, self.piece = t.vocab_size(), t.id_to_piece
        elif kind == "tiktoken":
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            t = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._plain = lambda texts: [t.encode_ordinary(x) for x in texts]
            self.size = max(ranks.values()) + 1
            self.piece = lambda i: t.decode_single_token_bytes(i).decode("utf-8", "replace")
        else:
            raise ValueError(f"no vocabulary file: {path}")
        self.special = {s: self.size + i for i, s in enumerate(dict.fromkeys(special))}
        # of several that begin at a place the longest is taken
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._cut is None:
            return self._plain(texts)
        parts = [[p for p in self._cut.split(t) if p] for t in texts]
        flat = iter(self._plain([p for ps in parts for p in ps if p not in self.special]))
        return [[i for p in ps for i in ([self.special[p]] if p in self.special else next(flat))] for ps in parts]


#: Characters of the texts that are encoded at once: what a tokenizer returns takes some hundred bytes a token.
AT_ONCE = 1 << 18

_open: dict[tuple, Vocabulary] = {}


def opened(path: str, special: Sequence[str] = (), pattern: str = RANK_PATTERN) -> Vocabulary:
    """One a process, as loading takes longer than many texts."""
    key = (path, tuple(special), pattern)
    if key not in _open:
        _open[key] = Vocabulary(path, special, pattern)
    return _open[key]


def token_ids(text: Column, path: str, special: Sequence[str] = (), before: Sequence[int] = (), after: Sequence[int] = (), pattern: str = RANK_PATTERN) -> Column:
    """Ids of a text, between the ids `before` and `after` (as begin and end marks); null of null. The file must be
    where the executors run."""
    special, before, after = tuple(special), list(before), list(after)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = opened(path, special, pattern)
        for texts in batches:
            yield from (pd.Series(ids, dtype=object) for ids in encoded(vocabulary, texts, before, after))

    return run(text)


def encoded(vocabulary: Vocabulary, texts: pd.Series, before: Sequence[int] = (), after: Sequence[int] = ()) -> Iterator[list[np.ndarray | None]]:
    """Ids of the texts in their order, null of null; in lists of texts of about AT_ONCE characters."""
    ends = texts.str.len().fillna(0).cumsum().to_numpy() // AT_ONCE if len(texts) else []
    for _, some in texts.groupby(ends, sort=False):
        ids = iter(vocabulary.encode(some[some.notna()].tolist()))
        yield [np.array([*before, *next(ids), *after], np.int32) if known else None for known in some.notna()]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of a vocabulary: as many rows as it has, some ten thousands."""
    v = opened(path)
    return spark.createDataFrame([(i, v.piece(i)) for i in range(v.size)], "id int, piece string")


def vocabulary_match(spark: SparkSession, new: str, old: str, special: dict[int, list[int]] | None = None) -> DataFrame:
    """new_id, old_ids: each piece of one vocabulary in another's ids, with the mark of a word's start as a space."""
    return matched(pieces(spark, new), lambda texts: opened(old).encode(texts), special)


def used_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """id, n: how often each id stands in the texts; ids that don't aren't among the results."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = opened(path)
        n = np.zeros(vocabulary.size, np.int64)
        for b in parts(batches):
            for some in encoded(vocabulary, b.column(0).to_pandas()):
                ids = [x for x in some if x is not None]
                n += np.bincount(np.concatenate(ids), minlength=len(n)) if ids else 0
        found = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found])], ["id", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
