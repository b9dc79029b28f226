import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import config as C


def plain(a, b):
    """Merge without checks."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: plain(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


def tree(rng, depth):
    if depth and rng.random() < 0.7:
        return {rng.choice("abcdef"): tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([1, 2.5, "x", True, None, [1, 2]])


def like(rng, value):
    """An override of the same kinds, with some names of its own."""
    if isinstance(value, dict):
        return {**{k: like(rng, v) for k, v in value.items() if rng.random() < 0.6}, **({"new": 1} if rng.random() < 0.3 else {})}
    return {int: 7, float: rng.choice([0.5, 3]), str: "y", bool: False, list: [], type(None): "z"}[type(value)]


def frame(spark, rows):
    df = spark.createDataFrame([(i, json.dumps(a) if a != "null" else None, json.dumps(b) if b != "null" else None) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return df.select("i", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))


def test_nested_overrides_equal_a_plain_merge(spark):
    rng = random.Random(2)
    rows = [(d := {"top": tree(rng, 3), "rest": tree(rng, 2)}, like(rng, d)) for _ in range(60)]
    got = C.with_overrides(frame(spark, rows), "a", ["b"]).select("i", F.to_json("config").alias("c")).collect()
    assert {r.i: json.loads(r.c) for r in got} == {i: plain(a, b) for i, (a, b) in enumerate(rows)}


def test_conflicts_have_paths(spark):
    base = {"model": {"dim": 64, "rate": 0.1, "name": "m", "deep": {"on": True, "list": [1], "any": None}}, "free": {}}
    odd = {"model": {"dim": "64", "rate": 1, "name": None, "deep": {"on": 0, "list": {}, "any": {"x": 1}}, "other": 5}, "free": {"k": [1]}}
    df = frame(spark, [(base, odd), (base, {}), (base, "null"), ("null", odd)])
    got = {r.i: (json.loads(r.c), r.config_conflicts) for r in C.with_overrides(df, "a", ["b"], strict=False, known=True).select("i", F.to_json("config").alias("c"), "config_conflicts").collect()}
    assert got[0][1] == ["$.model.deep.list: object for array", "$.model.deep.on: whole number for boolean", "$.model.dim: text for whole number", "$.model.other: unknown"]
    assert got[0][0] == {"model": {"dim": 64, "rate": 1, "name": None, "deep": {"on": True, "list": [1], "any": {"x": 1}}}, "free": {"k": [1]}}
    assert got[1] == (base, []) and got[2] == (base, []) and got[3] == (odd, [])
    with pytest.raises(Exception, match=r"settings: .*\$\.model\.deep\.on: whole number for boolean"):
        C.with_overrides(df, "a", ["b"]).collect()


def test_settings_by_path(spark):
    df = C.with_overrides(frame(spark, [({"a": {"b": 1}}, {"a": {"c": "x"}})]), "a", ["b", "b"])
    r = df.select(C.setting(F.col("config"), "$.a.b", "int").alias("b"), C.setting(F.col("config"), "$.a.c", "string").alias("c"), C.setting(F.col("config"), "$.a.d", "int").alias("d")).first()
    assert tuple(r) == (1, "x", None)
    with pytest.raises(Exception):  # noqa: B017
        df.select(C.setting(F.col("config"), "$.a.c", "int")).collect()
