"""Counts and scores that come along with a pass over the data, without a second scan.

In a batch, totals and skips are observed where rows are filtered and read once the action is done. In a stream,
a listener gets what each micro-batch observed and hands it to callbacks, as after an evaluation.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .metrics import BLEU_SUMS, bleu_of, bleu_sums, tokens


def skips(reasons: Mapping[str, Column]) -> Column:
    """The first reason that holds for a row, null for rows to keep; a reason that is null doesn't hold."""
    whens = [F.when(F.coalesce(c, F.lit(False)), name) for name, c in reasons.items()]
    return F.coalesce(*whens) if whens else F.lit(None).cast("string")


def skip_counts(reason: Column, names: list[str]) -> list[Column]:
    """Aggregates: total, kept, skipped_<name> of each reason."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("total"), one(reason.isNull()).alias("kept"), *(one(reason == n).alias(f"skipped_{n}") for n in names)]


def kept_rows(df: DataFrame, reasons: Mapping[str, Column], more: list[Column] = ()) -> tuple[DataFrame, Observation]:
    """The rows that no reason skips, and what an action on them observes: total, kept, a count for each reason (a row
    counts under the first that holds) and further aggregates over all rows. Readable after the first action; `get`
    waits for it."""
    seen = Observation()
    marked = df.withColumn("__skip", skips(reasons))
    marked = marked.observe(seen, *skip_counts(F.col("__skip"), list(reasons)), *more)
    return marked.where("__skip is null").drop("__skip"), seen


class Progress(StreamingQueryListener):
    """Keeps what named observations of streams say, batch by batch, and calls back after each.

    callbacks: by observation name, called with (batch number, figures as a dict). A callback's error is kept and
    doesn't stop the stream.
    """

    def __init__(self, callbacks: Mapping[str, Callable[[int, dict], None]] | None = None):
        self.callbacks = dict(callbacks or {})
        self.figures: dict[str, dict[int, dict]] = {}
        self.errors: list[tuple[str, int, Exception]] = []
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in (p.observedMetrics or {}).items():
            found = row.asDict()
            with self._changed:
                self.figures.setdefault(name, {})[p.batchId] = found
                self._changed.notify_all()
            if name in self.callbacks:
                try:
                    self.callbacks[name](p.batchId, found)
                except Exception as e:  # a report's fault is no reason to stop the stream
                    self.errors.append((name, p.batchId, e))

    def wait(self, name: str, batches: int, seconds: float = 30) -> dict[int, dict]:
        """Figures by batch, once there are so many; events come a little after their batch."""
        with self._changed:
            self._changed.wait_for(lambda: len(self.figures.get(name, {})) >= batches, seconds)
            return dict(self.figures.get(name, {}))

    def totals(self, name: str) -> dict:
        """Sums over the batches so far."""
        rows = list(self.figures.get(name, {}).values())
        return {k: sum(r[k] or 0 for r in rows) for k in (rows[0] if rows else {})}


def listening(spark: SparkSession, listener: Progress) -> Progress:
    spark.streams.addListener(listener)
    return listener


def scored_stream(predictions: DataFrame, name: str, tokenizer=tokens) -> DataFrame:
    """A stream of BLEU_SUMS over a stream of (prediction, references), observed under `name`: each batch's figures
    reach a listener, whose callback turns them into a score with bleu_value."""
    sums = bleu_sums(predictions, tokenizer)
    return sums.observe(name, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BLEU_SUMS))


def bleu_value(spark: SparkSession, sums: dict) -> float:
    """Corpus BLEU of one set of sums, or of several added up."""
    row = [tuple(int(sums[c] or 0) for c in BLEU_SUMS)]
    return bleu_of(spark.createDataFrame(row, ", ".join(f"{c} long" for c in BLEU_SUMS))).first().bleu


def added(rows: list[dict]) -> dict:
    return reduce(lambda a, b: {k: a[k] + (b[k] or 0) for k in a}, rows, dict.fromkeys(BLEU_SUMS, 0))
