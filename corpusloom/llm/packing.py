"""Order-preserving packing of documents into sequences by dynamic programming.

The ids of all documents, in ascending doc_id order, are one stream; a sequence is a stretch of
it. Cuts may fall at document ends (free), after sentence ends (a penalty) and, where no such place lies
within a window of the one before, at filler places (a larger penalty). With f(j) the least cost of the stream up to
cut j, at position p(j), and L the window,

    f(j) = penalty(j) + min over i with p(j) - p(i) <= L of  f(i) + L - (p(j) - p(i))

f(i) + p(i) doesn't depend on j, so the minimum over the sliding window is the head of a monotone
queue: each cut enters and leaves once, and a stream takes linear time. A sequence of exactly a
power of two isn't padded, which adds one look-up per admitted power to each j.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import END_ID, default_vocab, pieces, sentence_ends

WINDOW = 2048
SENTENCE_COST = 8.0
FILLER_COST = 64.0
#: Filler cuts stand this far apart, in stretches longer than a window without another place.
FILLER_GAP = 64
#: Unpadded short sequences: the powers of two admitted, and what each such sequence costs instead.
POWERS = (256, 512, 1024)
POWER_COST = 128.0
#: Ids a dynamic program covers at once; its last sequence starts the next one.
STRETCH = 1 << 19


def cut_places(ends: np.ndarray, sentences: np.ndarray, total: int, window: int = WINDOW) -> tuple[list[int], list[float]]:
    """Ascending places and penalties: every document's and every sentence's end, and filler places where two of
    these are more than a window apart. ends: positions after each document; sentences: after sentence ends."""
    places = np.concatenate([ends, sentences])
    cost = np.concatenate([np.zeros(len(ends)), np.full(len(sentences), SENTENCE_COST)])
    order = np.lexsort((cost, places))
    places, cost = places[order], cost[order]
    keep = (places > 0) & (places <= total) & np.concatenate([[True], places[1:] != places[:-1]])[: len(places)]
    places, cost = places[keep], cost[keep]
    gaps = np.diff(np.concatenate([[0], places]))
    wide = np.flatnonzero(gaps > window)
    if len(wide):
        step = min(FILLER_GAP, window)
        fill = np.concatenate([np.arange(places[i] - gaps[i] + step, places[i], step) for i in wide])
        places, cost = np.concatenate([places, fill]), np.concatenate([cost, np.full(len(fill), FILLER_COST)])
        order = np.argsort(places, kind="stable")
        places, cost = places[order], cost[order]
    return places.tolist(), cost.tolist()


def best_cuts(places: list[int], cost: list[float], window: int = WINDOW, powers: tuple[int, ...] = POWERS, power_cost: float = POWER_COST) -> list[int]:
    """The cuts of the cheapest division of [0, places[-1]]; gaps between places are at most the window."""
    n = len(places)
    p = [0, *places]
    f = [0.0] * (n + 1)
    came = [0] * (n + 1)
    index = {0: 0}
    queue: deque[int] = deque([0])
    keys: deque[float] = deque([0.0])
    powers = tuple(w for w in powers if w < window)
    get = index.get
    for j in range(1, n + 1):
        at = p[j]
        while p[queue[0]] < at - window:
            queue.popleft()
            keys.popleft()
        low, i = keys[0] + window - at, queue[0]
        for w in powers:
            k = get(at - w)
            if k is not None and f[k] + power_cost < low:
                low, i = f[k] + power_cost, k
        low += cost[j - 1]
        f[j] = low
        came[j] = i
        index[at] = j
        key = low + at
        while keys and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    cuts, j = [], n
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order, gives pieces (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, ends_sentence: np.ndarray, window: int = WINDOW, base: int = 0, stretch: int = STRETCH):
        self.is_end = np.zeros(1 << 20, bool)
        self.is_end[ends_sentence] = True
        self.window, self.sequence, self.stretch = window, base, stretch
        self.docs: list[tuple] = []  # doc_id, ids not yet cut off, start of these in the document, document's ids
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.n += len(ids)
        if self.n >= self.stretch:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Packs what is there; unless it's the last time, the final sequence stays open."""
        if not self.n:
            return
        ends = np.cumsum([len(x[1]) for x in self.docs])
        stream = np.concatenate([x[1] for x in self.docs])
        sentences = np.flatnonzero(self.is_end[np.minimum(stream, len(self.is_end) - 1)]) + 1
        cuts = best_cuts(*cut_places(ends, sentences, self.n, self.window), self.window)
        if not last and len(cuts) > 1:
            cuts.pop()
        k, done = 0, 0  # document, ids of it that are cut off here
        at = 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, start, total = self.docs[k]
                take = min(cut - at, len(ids) - done)
                piece = ids[done : done + take]
                yield doc_id, start + done, take, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset
                at, offset, done = at + take, offset + take, done + take
                if done == len(ids):
                    k, done = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if rest and done:
            doc_id, ids, start, total = rest[0]
            rest[0] = (doc_id, ids[done:], start + done, total)
        self.docs, self.n = rest, self.n - at


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, window: int = WINDOW, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of sequences over docs (doc_id, text), each with end_id after its last id.

    Documents are range-partitioned and sorted by (doc_id, hash of the text), nulls first; each
    partition is one stream, and sequences are numbered from partition number * 2^33. Null and
    empty texts are the end id alone; repeated rows are packed once each; other columns are
    ignored; an empty table gives no rows. Texts of any length are cut as often as needed.
    """
    vocab = vocab or default_vocab()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = pieces(vocab)
        packer = Packer(sentence_ends(vocab), window, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for b in lean(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(packer.add(doc_id, np.frombuffer(cache.ids(text.as_py()) + end, "<u4")))
            yield from _batch(rows)
            rows = []
        yield from _batch(list(packer.flush()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return rows.mapInArrow(pack, PIECE)


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECE.split(", ")])
