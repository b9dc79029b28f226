"""Chains of stages with one error policy: a record that fails at any stage goes, with the stage's name and what it
said, to one place, in the same pass; all others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import new_path

#: What a message keeps of an error.
MESSAGE = 500


@dataclass
class Stage:
    """make: called once a task, gives the function of a record (a dict) that returns the fields it adds or
    replaces; whatever it raises is the record's error. fields: DDL of what it returns. together: whether it takes a
    list of records and returns a list; where such a call fails, its records are tried one by one."""

    name: str
    make: Callable[[], Callable]
    fields: str
    together: bool = False


def each(name: str, function: Callable[[dict], dict], fields: str) -> Stage:
    """A stage of a plain function of one record."""
    return Stage(name, lambda: function, fields)


class Refused(Exception):
    """Raised by a stage for a record that it refuses, so that the message is its text alone."""


def _message(e: Exception) -> str:
    return (str(e) if isinstance(e, Refused) else f"{type(e).__name__}: {e}")[:MESSAGE]


def _fits(stage: Stage, got, names) -> dict:
    if not isinstance(got, dict) or set(got) - set(names):
        raise TypeError(f"stage {stage.name} gives {list(names)}")
    return {n: got.get(n) for n in names}


def _batch(stage: Stage, run: Callable, rows: list[dict], kinds: dict[str, pa.DataType]) -> list[dict | Exception]:
    def one(row: dict, got=None) -> dict | Exception:
        try:
            out = _fits(stage, (run([dict(row)])[0] if stage.together else run(dict(row))) if got is None else got, kinds)
            for n, v in out.items():
                pa.scalar(v, kinds[n])  # a value of the wrong kind is the record's fault, not the task's
            return out
        except Exception as e:
            return e

    if stage.together:
        try:
            many = run([dict(r) for r in rows])
            if len(many) != len(rows):
                raise ValueError(f"{len(many)} results of {len(rows)} records")
            return [one(r, g) for r, g in zip(rows, many, strict=True)]
        except Exception:  # noqa: S110, then one by one
            pass
    return [one(r) for r in rows]


def staged(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """df's columns and those of all stages (later ones replace earlier ones of their name), and failed_stage and
    error: null, or where and why the record stopped; fields of stages that it didn't reach are null.

    One pass over df, stage by stage over each Arrow batch; every row comes out exactly once. Nulls are handed to
    stages as None. Columns called failed_stage or error are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.drop("failed_stage", "error")
    kinds: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    given = [T.StructType.fromDDL(s.fields) for s in stages]
    for g in given:
        kinds |= {f.name: f.dataType for f in g.fields}
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds.items()), T.StructField("failed_stage", T.StringType()), T.StructField("error", T.StringType())])
    arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    inputs = df.columns
    returned = [{n: arrow[n] for n in g.names} for g in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [s.make() for s in stages]
        for b in batches:
            rows = b.to_pylist()
            done = [{n: r[n] if n in inputs else None for n in arrow} for r in rows]
            live = list(range(len(rows)))
            current = [dict(r) for r in rows]
            for s, call, back in zip(stages, made, returned, strict=True):
                if not live:
                    break
                left = []
                for i, got in zip(live, _batch(s, call, [current[i] for i in live], back), strict=True):
                    if isinstance(got, Exception):
                        done[i]["failed_stage"], done[i]["error"] = s.name, _message(got)
                    else:
                        current[i] |= got
                        done[i] |= got
                        left.append(i)
                live = left
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], k) for n, k in arrow.items()], list(arrow))

    return df.mapInArrow(run, schema)


def routed(df: DataFrame, stages: list[Stage], path: str | None = None, mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """(good, bad): records that passed all stages, and the others with failed_stage and error. They are written once,
    in two folders of one table, so that the stages run a single time whatever is read of it afterwards. For a
    stream: call it on each micro-batch, with a path that holds the batch's number and mode "overwrite"."""
    spark = df.sparkSession
    path = path or new_path(spark, "staged")
    out = staged(df, stages)
    out.withColumn("ok", F.col("failed_stage").isNull()).write.mode(mode).partitionBy("ok").parquet(path)
    back = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("ok", T.BooleanType())])).parquet(path)
    return back.where("ok").drop("ok", "failed_stage", "error"), back.where("not ok").drop("ok")
