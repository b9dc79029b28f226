"""Token arrays: truncating, padding, masking and shifting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def padded(ids: Column, size: Column, fill: int) -> Column:
    """ids filled up at the right to size."""
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("int"), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def within_vocabulary(ids: Column, size: int) -> Column:
    """Ids that the vocabulary lacks are ignored."""
    return F.transform(ids, lambda x: F.when(x >= size, F.lit(IGNORED)).otherwise(x))


def without_first(ids: Column) -> Column:
    return F.slice(ids, 2, 1 << 30)


def inserted(ids: Column, token: int, at: int = 1) -> Column:
    """token at index `at`, counted from 0."""
    return F.array_insert(ids, at + 1, F.lit(token))


def shifted_right(labels: Column, start: int, pad: int) -> Column:
    """Decoder inputs of labels: the start id, then all but the last, ignored ones padded."""
    moved = F.concat(F.array(F.lit(start)), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.transform(moved, lambda x: F.when(x == IGNORED, F.lit(pad)).otherwise(x))


def spans(pieces: Column) -> Column:
    """start and end, in characters, of each piece of a concatenation, in one pass that carries the offset."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(empty.alias("found"), F.lit(0).alias("at"))

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece)
        return F.struct(F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), end.alias("end")))).alias("found"), end.alias("at"))

    return F.aggregate(pieces, start, add, lambda s: s["found"])
