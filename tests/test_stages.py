import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import stages as G
from corpusloom.sources.tar import TarSource


def parse(r):
    return {"value": json.loads(r["raw"])}


def positive(r):
    if r["value"] < 0:
        raise G.Refused("negative")
    return {}


def inverse(rows):
    return [{"inverse": 1.0 / r["value"]} for r in rows]


def labelled(r):
    return {"label": {4: "four", 5: 5}.get(r["value"], "other")}  # 5 is no string


CHAIN = [G.each("parse", parse, "value int"), G.each("positive", positive, "value int"), G.Stage("inverse", lambda: inverse, "inverse double", together=True), G.each("label", labelled, "label string")]
CHAIN[1] = G.each("positive", lambda r: {"value": positive(r) or r["value"]}, "value int")


def test_every_row_in_one_output(spark, tmp_path):
    raws = ["1", "2", "x", None, "-3", "0", "4", "5", "[1]", "7"]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(raws)], "id int, raw string, error string").repartition(3)
    good, bad = G.routed(df, CHAIN, f"file://{tmp_path}/out")
    g = {r.id: (r.value, r.inverse, r.label) for r in good.collect()}
    b = {r.id: (r.failed_stage, r.error, r.value) for r in bad.collect()}
    assert set(g) | set(b) == set(range(10)) and not set(g) & set(b) and good.count() + bad.count() == 10
    assert g == {0: (1, 1.0, "other"), 1: (2, 0.5, "other"), 6: (4, 0.25, "four"), 9: (7, 1 / 7, "other")}
    assert {i: s for i, (s, _, _) in b.items()} == {2: "parse", 3: "parse", 4: "positive", 5: "inverse", 7: "label", 8: "parse"}
    assert b[4][1] == "negative" and b[5][1].startswith("ZeroDivisionError") and b[5][2] == 0 and b[8][2] is None
    assert good.columns == ["id", "raw", "value", "inverse", "label"]


def test_stages_run_once_and_are_made_once_a_task(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(r):
        ran.add(1)
        return {"n": r["id"]}

    good, bad = G.routed(spark.range(50).withColumn("x", F.lit(None).cast("int")), [G.each("count", count, "n long")], f"file://{tmp_path}/o")
    assert good.count() == 50 and bad.count() == 0 and good.agg(F.sum("n")).first()[0] == 1225 and ran.value == 50


def test_no_rows_and_no_stages(spark, tmp_path):
    assert G.staged(spark.range(0), CHAIN).count() == 0
    assert G.staged(spark.range(3), []).where("error is null").count() == 3


def tar_bytes(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def shards(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    whole = tar_bytes([(f"k{i}.data", b"%d" % i * 700) for i in range(40)])
    (place / "0.tar").write_bytes(whole)
    (place / "1.tar").write_bytes(whole[: len(whole) // 2])  # within a member
    (place / "2.tar").write_bytes(b"no tar file at all" * 100)
    (place / "3.tar").write_bytes(b"")
    (place / "4.tar").write_bytes(whole[: 40 * 1536 if len(whole) > 40 * 1536 else -1].rstrip(b"\0"))
    return str(place)


def test_faulty_shards_are_reported(spark, shards):
    spark.dataSource.register(TarSource)
    rows = spark.read.format("tarshards").option("errors", "rows").load(shards).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard.rpartition("/")[2], []).append(r)
    assert len(by["0.tar"]) == 40 and all(r.error is None for r in by["0.tar"])
    assert 0 < len(by["1.tar"]) < 40 and [r.error is None for r in by["1.tar"]].count(False) == 1 and by["1.tar"][-1].key is None
    assert [r.error for r in by["2.tar"]][0] and [r.error for r in by["3.tar"]][0]
    assert sum(r.error is not None for r in by["4.tar"]) == 1
    assert spark.read.format("tarshards").load(shards).count() == sum(r.error is None for r in rows)
    with pytest.raises(Exception, match="ReadError"):
        spark.read.format("tarshards").option("errors", "fail").load(shards).count()


def test_members_through_stages(spark, shards, tmp_path):
    """Unreadable shards are records that fail at the first stage, like members that fail later."""
    spark.dataSource.register(TarSource)

    def readable(r):
        if r["error"]:
            raise G.Refused(r["error"])
        return {"size": len(r["data"])}

    def short(r):
        if r["size"] > 700:
            raise G.Refused("long")
        return {"size": r["size"]}

    rows = spark.read.format("tarshards").option("errors", "rows").load(shards)
    good, bad = G.routed(rows.withColumnRenamed("error", "fault"), [G.each("read", lambda r: readable({**r, "error": r["fault"]}), "size int"), G.each("short", short, "size int")], f"file://{tmp_path}/o")
    assert good.count() + bad.count() == rows.count()
    assert bad.where("failed_stage = 'read'").count() == 4 and bad.where("failed_stage = 'short'").count() == rows.where("length(data) > 700").count() > 0


def test_overwriting_replaces_the_shards(spark, tmp_path):
    spark.dataSource.register(TarSource)
    path = str(tmp_path / "t")
    made = lambda n, text: spark.range(n).selectExpr("cast(id as string) as key", f"'{text}' as data").repartition(3)
    for n, text in ((40, "a"), (7, "b"), (12, "c")):
        made(n, text).write.format("tarshards").option("per_shard", 3).mode("overwrite").save(path)
        back = spark.read.format("tarshards").load(path).collect()
        assert len(back) == n and {bytes(r.data) for r in back} == {text.encode()}
    made(5, "d").write.format("tarshards").mode("append").save(path)
    assert spark.read.format("tarshards").load(path).count() == 17


def test_small_shards_share_a_task(spark, tmp_path):
    spark.dataSource.register(TarSource)
    path = str(tmp_path / "t")
    spark.range(300).selectExpr("cast(id as string) as key", "'x' as data").coalesce(1).write.format("tarshards").option("per_shard", 2).mode("append").save(path)
    back = spark.read.format("tarshards").load(path)
    assert back.count() == 300 and back.rdd.getNumPartitions() < 20
