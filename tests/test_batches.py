"""What Python makes of a batch is passed on in bounded parts, whatever the size of the batch."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import config as C
from corpusloom.operators import metrics as M
from corpusloom.operators import subword as U
from corpusloom.operators.batches import parts


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_parts():
    b = pa.RecordBatch.from_pydict({"x": ["a" * 1000] * 5000})
    got = list(parts([b, b.slice(0, 0)], size=100_000))
    assert pa.Table.from_batches(got).to_pydict() == b.to_pydict() and 1 < max(p.num_rows for p in got) <= 100


def test_cider_passes_few_grams_at_once(spark, monkeypatch):
    made = []
    kind = type(spark.range(1))
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: made.append(f) or whole(self, f, schema))
    rows = [(str(i), " ".join(f"w{j}" for j in range(i, i + 300)), [" ".join(f"v{j}" for j in range(i, i + 300))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, prediction string, references array<string>")
    assert M.cider(df).count() == 400
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "h": [r[1].split() for r in rows], "r": [[r[2][0].split()] for r in rows]})
    got = list(made[0](iter([batch])))
    assert sum(b.num_rows for b in got) == 400 * sum(2 * (301 - n) for n in (1, 2, 3, 4)) and max(b.num_rows for b in got) < M.AT_ONCE + 1000


def test_ids_are_made_of_few_texts_at_once(spark, monkeypatch):
    v = U.opened(path("byte_bpe_50k.json"))
    texts = pd.Series(["some words " * 3000, None, "", "more " * 9000] * 20)
    got = list(U.encoded(v, texts, [1], [2]))
    assert len(got) > 4 and [None if x is None else list(x) for ids in got for x in ids] == [None if t is None else [1, *v.encode([t])[0], 2] for t in texts]
    assert list(U.encoded(v, texts.iloc[:0])) == []
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counted = U.used_pieces(docs, path("byte_bpe_50k.json"))
    plain = docs.select(F.explode(U.token_ids(F.col("text"), path("byte_bpe_50k.json"))).alias("id")).groupBy("id").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect())) and dict(counted.dtypes) == {"id": "int", "n": "bigint"}
    # one row a token doesn't leave Python
    assert "Generate" not in counted._jdf.queryExecution().toString()


def test_settings_go_through_python_once(spark):
    rows = spark.createDataFrame([('{"a": 1}', '{"a": "x"}', None, '{"b": [1]}'), (None, None, '{"a": 2}', '{"a": 3}'), ("null", '{"a": 1}', None, None)], "d string, x string, y string, z string")
    rows = rows.select(*(F.parse_json(c).alias(c) for c in rows.columns))
    got = C.with_overrides(rows, "d", ["x", "y", "z"], strict=False)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.c, r.config_conflicts) for r in got.select(F.to_json("config").alias("c"), "config_conflicts").collect()] == [('{"a":1,"b":[1]}', ["$.a: text for whole number"]), ('{"a":3}', []), ('{"a":1}', [])]


def test_tar_members_are_passed_on_by_bytes():
    from corpusloom.sources import tar as T

    rows = [("s", f"k{i}", f"k{i}.txt", "txt", bytes(1 << 20)) for i in range(10)] + [("s", "e", "e.txt", "txt", b""), ("s", "t", "t.txt", "txt", None)]
    got = list(T.in_batches(iter(rows), T.columns("skip")))
    assert [b.num_rows for b in got] == [4, 4, 4] and [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert got[0].schema.names == ["shard", "key", "name", "ext", "data"] and T.columns("rows")[-1] == "error" and list(T.in_batches([], T.columns("rows"))) == []
    assert sum(b.num_rows for b in T.in_batches([("s", "k", "n", "e", b"")] * 25_000, T.columns("skip"))) == 25_000
    # tasks read and write batches, not rows
    assert isinstance(next(T.TarReader("/nowhere/{1..0}", "skip", 1).read(T.Shard([])), None), type(None)) and issubclass(T.TarWriter, T.DataSourceArrowWriter)
