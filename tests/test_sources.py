import csv
import gzip
import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources.tar import TarSource, split_name
from corpusloom.streaming.sampler import sampled_stream
from corpusloom.streaming.sources import file_stream, shuffled_batches, with_dead_letters


def test_braces():
    assert R.braces("a/{08..11}.tar") == ["a/08.tar", "a/09.tar", "a/10.tar", "a/11.tar"]
    assert R.braces("x{1..2}y{0..1}") == ["x1y0", "x1y1", "x2y0", "x2y1"]
    assert R.braces("plain.tar") == ["plain.tar"]


def test_csv_like_pythons(spark, tmp_path):
    rows = [("a.jpg", "de", 'say "hi", you', ""), ("b.jpg", "en", "two\nlines", "x")]
    with open(tmp_path / "x.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)
    assert sorted(tuple(r) for r in R.read_csv(spark, str(tmp_path / "x.csv")).collect()) == rows
    R.write_csv(spark.createDataFrame(rows, R.CSV), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(csv.reader(io.StringIO(text, newline=""))) == [list(r) for r in rows]


def test_recaptions(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a.jpg,c1,"c ""2"", x",desc\nb.jpg,only\n')
    got = sorted(tuple(r) for r in R.read_recaptions(spark, str(tmp_path / "r.csv")).collect())
    assert got == [("a.jpg", ["c1", 'c "2", x'], "desc"), ("b.jpg", [], "only")]


def test_lines(spark, tmp_path):
    with gzip.open(tmp_path / "l.gz", "wt") as f:
        f.write(" b \na\nç\n")
    assert [r.text for r in R.read_lines(spark, str(tmp_path / "l.gz")).orderBy("row_no").collect()] == ["b", "a", "ç"]
    (tmp_path / "p.txt").write_text(" b \na\n")
    assert [r.text for r in R.read_lines(spark, str(tmp_path / "p.txt"), stripped=False).orderBy("row_no").collect()] == [" b ", "a"]


def test_coco(spark, tmp_path):
    images = [{"split": "train", "filename": f, "sentences": [{"raw": r}]} for f, r in (("a", "1"), ("b", "2"), ("a", "3"))] + [{"split": "val", "filename": "c", "sentences": []}]
    (tmp_path / "c.json").write_text(json.dumps({"images": images}))
    assert sorted(tuple(r) for r in R.read_coco(spark, str(tmp_path / "c.json"), "train").collect()) == [("a", ["3"]), ("b", ["2"])]


def test_paragraphs_and_jsonl(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"image_id": i, "url": u, "paragraph": p} for i, u, p in ((1, "h/VG/1.jpg", "x"), (2, "h/VG/2.jpg", ""), (3, "h/VG/3.jpg", "y"))]))
    (tmp_path / "ids.json").write_text("[1, 2]")
    assert [tuple(r) for r in R.read_paragraphs(spark, str(tmp_path / "p.json"), str(tmp_path / "ids.json")).collect()] == [("VG_1.jpg", "x")]
    (tmp_path / "d.jsonl").write_text('{"split":"train","image_file":"a","description":"d"}\n{"split":"test","image_file":"b","description":"e"}\n')
    assert [tuple(r) for r in R.read_docci(spark, str(tmp_path / "d.jsonl"), "train").collect()] == [("a", "d")]
    (tmp_path / "x.jsonl").write_text('{"image/key":"k","en":{"caption":["a"]},"de":{"caption":["b","c"]}}\n')
    assert tuple(R.read_multilingual(spark, str(tmp_path / "x.jsonl"), "de", ("de", "en")).first()) == ("k", ["a"], ["b", "c"])
    with pytest.raises(ValueError, match="not supported"):
        R.read_multilingual(spark, "x", "xx", ("de",))


def test_multi30k_and_ambiguity(spark, tmp_path):
    raw, splits = tmp_path / "data/task1/raw", tmp_path / "data/task1/image_splits"
    raw.mkdir(parents=True)
    splits.mkdir(parents=True)
    for lang, lines in (("en", "one\ntwo\nthree\n"), ("de", "eins\nzwei\n")):
        with gzip.open(raw / f"test_2017_mscoco.{lang}.gz", "wt") as f:
            f.write(lines)
    (splits / "test_2017_mscoco.txt").write_text("COCO_train2014_1.jpg#1\nCOCO_val2014_2.jpg#0\nx\n")
    got = [tuple(r)[1:] for r in R.read_multi30k(spark, str(tmp_path), "test_2017_mscoco", "de").orderBy("row_no").collect()]
    assert got == [("coco/train2014/COCO_train2014_1.jpg", ["one"], ["eins"]), ("coco/val2014/COCO_val2014_2.jpg", ["two"], ["zwei"])]
    with pytest.raises(ValueError, match="is not in"):
        R.read_multi30k(spark, str(tmp_path), "test_2017_mscoco", "ru")
    for name, text in (("img.order", "i\n"), ("src.de", " s\n"), ("correct.de", "c\n"), ("incorrect.de", "w\n")):
        (tmp_path / name).write_text(text)
    assert tuple(R.read_ambiguity(spark, str(tmp_path), "de").first())[1:] == ("i", " s", "c", "w")


def test_statistics_predictions_cache(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"m": {"caption": {"de": 3}}}')
    assert tuple(R.read_statistics(spark, str(tmp_path / "s.json")).first()) == ("m", "caption", "de", 3)
    (tmp_path / "p.json").write_text(json.dumps({"sources": ["s"], "predictions": ["p"], "references": [["r", "q"]]}))
    assert tuple(R.read_predictions(spark, str(tmp_path / "p.json")).first()) == (0, "s", "p", ["r", "q"])
    made = []
    for _ in range(2):
        df = R.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3))
        assert df.count() == 3
    assert made == [1]
    assert R.synthetic(spark, 4).select("input_ids").distinct().count() == 1


def make_tar(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_tar_round_trip(spark, tmp_path):
    spark.dataSource.register(TarSource)
    make_tar(tmp_path / "0001.tar", [("a.b.jpg", b"\x00\x01"), ("a.data", b"[]")])
    (tmp_path / "0002.tar").write_bytes(b"broken")
    got = sorted((r.key, r.ext, bytes(r.data)) for r in spark.read.format("tarshards").load(str(tmp_path)).collect())
    assert got == [("a", "b.jpg", b"\x00\x01"), ("a", "data", b"[]")]
    assert split_name("d/x.y.z") == ("d/x", "y.z")
    rows = spark.range(10).select(F.format_string("%06d", "id").alias("key"), F.lit("data").alias("ext"), F.lit("[1]").cast("binary").alias("data")).coalesce(1)
    rows.write.format("tarshards").option("per_shard", 4).mode("append").save(str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 3 and all(n.endswith(".tar") for n in names)
    assert spark.read.format("tarshards").load(str(tmp_path / "out")).count() == 10


def test_tar_stream_draws_with_replacement(spark, tmp_path):
    spark.dataSource.register(TarSource)
    for i in range(3):
        make_tar(tmp_path / f"{i}.tar", [(f"k{i}.data", b"x")])
    q = spark.readStream.format("tarshards").option("resample", 3).option("shards_at_once", 2).load(str(tmp_path)).writeStream.format("memory").queryName("tars").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("tars").count() >= 6:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    n = spark.table("tars").count()
    assert n >= 6 and n % 2 == 0


def test_stream_sampler_equals_batch(spark, tmp_path):
    from corpusloom.operators.sampling import dynamic_sample, normalised

    rows = spark.range(200).select((F.col("id") % 3).alias("w"), F.col("id").alias("o"), F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b").otherwise("c")).alias("c"))
    for part in range(4):  # order within a worker follows the files
        rows.where(f"o >= {part * 50} and o < {part * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = normalised({"a": 2.0, "b": 1.0, "c": 1.0})
    want = {(r.w, r.o): r.key for r in dynamic_sample(rows, "w", "o", "c", target).collect()}
    stream = sampled_stream(file_stream(spark, str(tmp_path / "in"), files_at_once=1), "w", "o", "c", target)
    for _ in range(2):  # the second start finds nothing new
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [((r.w, r.o), r.key) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 200 and dict(got) == want


def test_dead_letters_and_shuffle(spark, tmp_path):
    spark.createDataFrame([('{"a": 1}',), ("{oops",), ('{"a": 2}',)], "raw string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"))
    with_dead_letters(stream, "raw", "a int", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2]
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["{oops"]
    shuffled_batches(stream, "raw", str(tmp_path / "mixed"), str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "mixed")).count() == 3


def test_tar_shards_from_several_tasks_lose_nothing(spark, tmp_path):
    spark.dataSource.register(TarSource)
    rows = spark.range(40).selectExpr("string(id % 3) as shard", "string(id) as key", "cast(id as string) as data").repartition(4)
    rows.write.format("tarshards").option("per_shard", 5).mode("append").save(str(tmp_path / "t"))
    back = spark.read.format("tarshards").load(str(tmp_path / "t")).collect()
    assert sorted(int(r.key) for r in back) == list(range(40)) and all(r.key == bytes(r.data).decode() for r in back)
    assert all(int(str(r.shard).rpartition("/")[2][:6]) == int(r.key) % 3 for r in back)
    names = [p.name for p in (tmp_path / "t").iterdir()]
    assert {"000000.tar", "000001.tar", "000002.tar"} <= set(names) and not [n for n in names if n.endswith(".tmp")]
