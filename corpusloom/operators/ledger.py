"""Model calls that can be resumed: what was asked is kept by a hash of the request, so that a rerun asks only for what
is missing.

The ledger is an append-only folder of Parquet tables (hash, output, error). Requests that are equal are asked once. They go out
in waves, each written before the next begins, and within a task in batches of bounded token sums; a batch that
fails is tried again row by row, and rows that fail even so are written with their error and asked again by the next
run. So a run that breaks off loses at most the calls of the wave it was in, and a lost executor those of its tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, new_path, written

SCHEMA = "hash string, output string, error string"
#: Tokens and rows of a batch, and requests of a wave.
TOKENS, ROWS, WAVE = 4096, 64, 1_000_000


@dataclass
class Call:
    """make: called once a task, gives a function from a list of requests (dicts of the fields) to a list of answers.
    name and settings are part of a request's hash: another model, or the same otherwise set, is asked anew."""

    name: str
    make: Callable[[], Callable[[list[dict]], list[str]]]
    fields: list[str]
    settings: dict = field(default_factory=dict)

    def hash(self) -> Column:
        told = [F.lit(self.name), F.lit(repr(sorted(self.settings.items())))]
        return F.sha2(F.to_json(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(told)), *self.fields), {"ignoreNullFields": "false"}), 256)


def batches(rows: list[dict], sizes: list[int], tokens: int = TOKENS, most: int = ROWS) -> Iterator[list[int]]:
    """Places of rows in batches: of like sizes, at most `most` rows, and a sum of sizes of at most `tokens`, but for a
    row that has more by itself. Padded to its longest row, a batch has few empty places."""
    held: list[int] = []
    for i in sorted(range(len(rows)), key=lambda i: (sizes[i], i)):
        if held and (len(held) == most or sizes[i] * (len(held) + 1) > tokens):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def _answers(run: Callable, rows: list[dict]) -> list[tuple[str | None, str | None]]:
    try:
        out = run(rows)
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} answers to {len(rows)} requests")
        return [(None if x is None else str(x), "no answer" if x is None else None) for x in out]
    except Exception as e:
        if len(rows) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        return [a for r in rows for a in _answers(run, [r])]


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "ledger")).rstrip("/")

    def rows(self) -> DataFrame:
        """All that was written; empty before the first call. Each wave has a folder of its own, and those that are
        finished are read by name: tables of one folder read at different times would pass for the same to Spark."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = [f for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
        return self.spark.read.schema(SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], SCHEMA)

    def answers(self) -> DataFrame:
        """hash, output of what was answered; of several answers the smallest."""
        return self.rows().where("error is null").groupBy("hash").agg(F.min("output").alias("output"))

    def missing(self, df: DataFrame, call: Call) -> DataFrame:
        """The distinct requests of df that have no answer yet, with their hash."""
        asked = df.select(call.hash().alias("hash"), *call.fields).dropDuplicates(["hash"])
        return asked.join(self.rows().where("error is null").select("hash"), "hash", "left_anti")

    def ask(self, df: DataFrame, call: Call, size: Column | None = None, tokens: int = TOKENS, most: int = ROWS, wave: int = WAVE) -> int:
        """Asks for what is missing and writes it; how many requests were made. size: a request's tokens (the
        characters of its fields unless given)."""
        size = size if size is not None else sum((F.coalesce(F.char_length(F.col(f).cast("string")), F.lit(0)) for f in call.fields), F.lit(0))
        asked = written(self.missing(df, call).withColumn("__size", size.cast("long")), "requests")
        n = asked.count()
        waves = max(1, math.ceil(n / wave))
        fields = call.fields

        def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for b in table:
                if not b.num_rows:
                    continue
                model = model or call.make()
                rows = b.select(fields).to_pylist()
                hashes, sizes = b.column("hash").to_pylist(), b.column("__size").to_pylist()
                for places in batches(rows, sizes, tokens, most):
                    got = _answers(model, [rows[i] for i in places])
                    yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in places]), pa.array([o for o, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["hash", "output", "error"])

        for k in range(waves if n else 0):
            part = asked if waves == 1 else asked.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == k)
            part.mapInArrow(run, SCHEMA).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        drop(asked)
        return n

    def answered(self, df: DataFrame, call: Call, out: str = "output") -> DataFrame:
        """df with the answers known so far, null where there is none; no call is made."""
        known = self.answers().select(F.col("hash").alias("__hash"), F.col("output").alias(out))
        return df.drop(out).withColumn("__h", call.hash()).join(known, F.col("__h") == F.col("__hash"), "left").drop("__h", "__hash")

    def called(self, df: DataFrame, call: Call, out: str = "output", **how) -> DataFrame:
        """df with an answer for each row: asks for what is missing, then reads the ledger."""
        self.ask(df, call, **how)
        return self.answered(df, call, out)
