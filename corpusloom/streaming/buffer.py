"""A shuffle buffer in Spark's state store: bounded, and exact over restarts.

Each worker (a key of the stream) holds up to `bound` records. Until it is full it takes records in; then each
record that comes takes the place of one drawn at random, which goes out. What is left goes out, in random
order, when the worker's end comes: a record marked as its last, or a time without any.

A record is a row of a map in the state store, by the number of its place, so that a batch reads and writes only
the places drawn. A micro-batch's rows of a worker are held in Python while they are put in order, so its size must be
bounded by the source (files_at_once of `file_stream`). State and output are committed together by the query's checkpoint. Places are drawn by a
hash of seed, worker and the number of draws so far, so that a batch which is run again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sampling import hashed_uniform

BOUND = 1000
#: The state store that this kind of state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = "__last"
ORDER = "__order"


class _Buffer(StatefulProcessor):
    def __init__(self, schema: T.StructType, worker: str, bound: int, seed: int, idle_ms: int | None):
        self.schema, self.worker, self.bound, self.seed, self.idle_ms = schema, worker, bound, seed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", "place int", self.schema)
        self.counts = handle.getValueState("counts", "held int, draws long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        came = sorted(rows, key=lambda r: (r[ORDER] is not None, r[ORDER]))  # a micro-batch's rows of this worker
        held, draws = self.counts.get() if self.counts.exists() else (0, 0)
        known: dict[int, tuple] = {}  # places read or changed in this batch
        changed: set[int] = set()
        out, over = [], False
        for r in came:
            over = over or bool(r[LAST])
            if r[LAST] and all(r[n] is None for n in names if n != self.worker):
                continue  # a mark alone, without a record
            record = tuple(r[n] for n in names)
            if held < self.bound:
                at, held = held, held + 1
            else:
                at = self._drawn(key, draws, held)
                draws += 1
                out.append(known[at] if at in known else tuple(self.places.getValue((at,))))
            known[at] = record
            changed.add(at)
        for at in changed:
            self.places.updateValue((at,), known[at])
        self.counts.update((held, draws))
        if over:
            out += self._emptied(key)
        elif self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        for record in out:
            yield Row(**dict(zip(names, record, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for record in self._emptied(key):
            yield Row(**dict(zip(self.schema.names, record, strict=True)))

    def _drawn(self, key, draws: int, n: int) -> int:
        return min(n - 1, int(hashed_uniform(self.seed, key[0], draws) * n))

    def _emptied(self, key) -> list[tuple]:
        """All that is held, in random order; the state is cleared but for the number of draws."""
        held, draws = self.counts.get() if self.counts.exists() else (0, 0)
        left = [tuple(self.places.getValue((i,))) for i in range(held)]
        out = []
        while left:
            at = self._drawn(key, draws, len(left))
            draws += 1
            left[at], left[-1] = left[-1], left[at]
            out.append(left.pop())
        self.places.clear()
        self.counts.update((0, draws))
        return out


def shuffle_buffer(stream: DataFrame, worker: str, order: Column, bound: int = BOUND, seed: int = 0, last: Column | None = None, idle_ms: int | None = None) -> DataFrame:
    """The stream's records, each worker's in a random order that a buffer of `bound` allows.

    order: in which a worker's records of one micro-batch come. last: true for a record after which the worker is
    emptied; a row with nothing else but its worker is only a mark. idle_ms: empties a worker for which no record has
    come for so long. Rows may hold nulls; equal records stay as many as they are. The session's state store must
    be STORE.
    """
    if bound < 1:
        raise ValueError("a buffer holds at least one record")
    columns = stream.columns
    rows = stream.withColumns({LAST: F.coalesce(last, F.lit(False)) if last is not None else F.lit(False), ORDER: order})
    mode = "none" if idle_ms is None else "processingTime"
    return rows.groupBy(worker).transformWithState(_Buffer(stream.schema, worker, bound, seed, idle_ms), stream.schema, "append", mode).select(*columns)
