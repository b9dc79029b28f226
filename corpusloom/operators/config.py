"""Settings as VARIANT columns: overrides merged into defaults, kinds checked, every conflict told with its path."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows merged at once.
ROWS = 1024
MERGED = "struct<merged:string,conflicts:array<string>>"


def kind(value) -> str:
    """Kinds that settings are told apart by; whole numbers may stand for others, but not the other way round."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return {int: "whole number", float: "number", str: "text"}[type(value)]


def fits(value, default) -> bool:
    """Whether a value may stand where the default does: anything for null and null for anything."""
    a, b = kind(value), kind(default)
    return a == b or "null" in (a, b) or (a, b) == ("whole number", "number")


def merge(default, override, known: bool = False, path: str = "$") -> tuple[object, list[str]]:
    """The default with what the override says, object by object; arrays and plain values are replaced as a whole. A value
    of another kind leaves the default and is a conflict, and so is, if names must be known, a name that the default
    object lacks; an empty default object takes any names."""
    if isinstance(default, dict) and isinstance(override, dict):
        out, conflicts = dict(default), []
        for name in override:
            here = f"{path}.{name}"
            if name not in default:
                if known and default:
                    conflicts.append(f"{here}: unknown")
                else:
                    out[name] = override[name]
                continue
            out[name], more = merge(default[name], override[name], known, here)
            conflicts += more
        return out, conflicts
    if not fits(override, default):
        return default, [f"{path}: {kind(override)} for {kind(default)}"]
    return override, []


def merged(default: Column, override: Column, known: bool = False) -> Column:
    """MERGED of two VARIANT columns; a null override changes nothing, a null default takes the override."""
    return merged_all(default, [override], known)


def merged_all(default: Column, overrides: list[Column], known: bool = False) -> Column:
    """MERGED of a default and each of the overrides in turn, all VARIANT columns: one pass through one Python worker,
    in parts of ROWS rows. Conflicts stand in the order of the overrides, of each sorted."""

    @F.pandas_udf(MERGED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            for at in range(0, len(columns[0]), ROWS):
                rows = zip(*(c.iloc[at : at + ROWS] for c in columns), strict=True)
                yield pd.DataFrame([_merged_row(d, o, known) for d, *o in rows], columns=["merged", "conflicts"])

    return run(F.to_json(default), *map(F.to_json, overrides))


def _merged_row(default: str | None, overrides: list[str | None], known: bool) -> tuple[str | None, list[str]]:
    """Text of what the overrides make of a default, and the conflicts."""
    value, told = None if default is None else json.loads(default), []
    there = default is not None
    for o in overrides:
        if o is None:
            continue
        if not there:
            value, there = json.loads(o), True
            continue
        value, more = merge(value, json.loads(o), known)
        told += sorted(more)
    return json.dumps(value, sort_keys=True, ensure_ascii=False) if there else None, told


def with_overrides(df: DataFrame, default: str, overrides: list[str], out: str = "config", strict: bool = True, known: bool = False) -> DataFrame:
    """df with the VARIANT column `out`: the default with each of the overrides in turn, all VARIANT columns. strict: a
    conflict is an error that names all paths; otherwise they are told in <out>_conflicts."""
    told = F.array().cast("array<string>")
    rows = df.drop(out, f"{out}_conflicts")
    columns = rows.columns
    if overrides:
        rows = rows.withColumn("__m", merged_all(F.col(default), [F.col(o) for o in overrides], known))
        rows = rows.withColumn("__now", F.parse_json("__m.merged")).withColumn("__told", F.coalesce("__m.conflicts", told)).drop("__m")
    else:
        rows = rows.withColumns({"__now": F.col(default), "__told": told})
    if strict:
        rows = rows.withColumn("__now", F.when(F.size("__told") > 0, F.raise_error(F.concat(F.lit("settings: "), F.array_join("__told", "; ")))).otherwise(F.col("__now")))
        return rows.select(*columns, F.col("__now").alias(out))
    return rows.select(*columns, F.col("__now").alias(out), F.col("__told").alias(f"{out}_conflicts"))


def setting(config: Column, path: str, kind: str) -> Column:
    """A setting by its path, null where it is missing or null; one of another kind is an error."""
    return F.variant_get(config, path, kind)
