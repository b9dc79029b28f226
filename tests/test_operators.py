import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import annotate as A
from corpusloom.operators import bake as B
from corpusloom.operators import enrich as E
from corpusloom.operators import losses as L
from corpusloom.operators import metrics as M
from corpusloom.operators import models
from corpusloom.operators import parse as Z
from corpusloom.operators import report as T
from corpusloom.operators import sampling as S
from corpusloom.operators.order import numbered, sharded
from corpusloom.sources.readers import TRAIN

LONG = "A sentence of more than enough words."


def train_row(key, caption=None, **pairs):
    return (key, caption, *(pairs.get(x) for x in ("de", "fr", "es", "zh", "ru")))


def test_annotate_train(spark):
    en3, de3 = "One is here. two is there. Three is nowhere.", "Eins ist da. Zwei ist dort. Drei fehlt."
    rows = [
        train_row("1", [[en3, de3]]),
        train_row("2", [["x" * 25, "kurz"]]),
        train_row("3", [["x" * 26 + ".", "Genau ein Satz."]]),
        train_row("4", [[LONG, "a"], [LONG, "b"]]),
        train_row("5", fr=[[LONG, "un"], [LONG + " more", "deux"], ["short", "non"]]),
        train_row("1234567890", None),
    ]
    got = {r["__key__"]: r["data"] for r in A.annotate_train(spark.createDataFrame(rows, TRAIN)).collect()}
    assert set(got) == {"000000001", "000000003", "000000005"}
    prompts = [a.prompt for a in got["000000001"]]
    assert prompts[:4] == ["<LANG_DE><CAPTION>", "<LANG_DE><MORE_DETAILED_CAPTION>", "<LANG_EN><CAPTION>", "<LANG_EN><MORE_DETAILED_CAPTION>"]
    assert prompts[4] == "<LANG_DE><TRANSLATE>One is here. Two is there. Three is nowhere."
    mix = got["000000001"][5]
    assert mix.type == "translation" and 2 <= mix.output.count(".") <= 3
    assert [a.prompt for a in got["000000003"]] == ["<LANG_DE><CAPTION>", "<LANG_EN><CAPTION>", "<LANG_DE><TRANSLATE>" + "X" + "x" * 25 + "."]
    fr = got["000000005"]
    assert [a.output for a in fr[:2]] == ["un", "deux"] and len(fr) == 3 and sorted(fr[2].output.split()) == ["deux", "un"]
    kept = A.annotate_train(spark.createDataFrame(rows, TRAIN), compat=True)
    assert kept.count() == 6


def test_annotate_eval(spark):
    schema = "key long, caption_en string, caption_en_style string, caption_de string, caption_de_style string, caption_es string, caption_es_style string, caption_zh string, caption_zh_style string, translation_en_es array<string>, translation_en_zh array<string>"
    row = (5, "a", "short", None, "detailed", "b", "more_detailed", None, None, ["x", "y"], None)
    got = {(r.target, r.prompt, r.output) for r in A.annotate_eval(spark.createDataFrame([row], schema)).collect()}
    assert got == {("en_caption", "<LANG_EN><CAPTION>", "a"), ("es_caption", "<LANG_ES><MORE_DETAILED_CAPTION>", "b"), ("es_translation", "<LANG_ES><TRANSLATE>x", "y")}
    with pytest.raises(Exception, match="two parts"):
        A.annotate_eval(spark.createDataFrame([(*row[:9], ["x", "y", "z"], None)], schema)).collect()


def test_average_lengths(spark):
    rows = [("total_prompt_count", "caption", "de", 10), ("total_output_count", "caption", "de", 30), ("sample_count", "caption", "de", 4)]
    r = A.average_lengths(spark.createDataFrame(rows, "measure string, task string, lang string, value long")).first()
    assert (r.avg_prompt, r.avg_output) == (2.5, 7.5)


def test_joins(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert sorted((r.k, r.v) for r in B.first_match(left, right, "k", ["v"]).collect()) == [("a", 1), ("b", 5)]
    assert [r.k for r in B.missing(left, right, "k").collect()] == ["c"]
    assert B.ignoring(left, right, "k").count() == 1 and B.ignoring(left, right, "k", compat=True).count() == 3
    assert [r.v for r in B.last_wins(right, "k", F.col("v"), "v").orderBy("k").collect()] == [2, 5]
    with pytest.raises(Exception, match="no match for c"):
        B.looked_up(left, right, "k").collect()


def test_zip_is_as_long_as_the_shortest(spark):
    a = numbered(spark.range(5).toDF("x"), "x")
    b = numbered(spark.range(3).toDF("y"), "y")
    assert sorted((r.x, r.y) for r in B.zipped(a, b).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_numbers_and_shards(spark):
    df = sharded(numbered(spark.range(1234).select((1233 - F.col("id")).alias("x")), "x"), 500)
    rows = sorted(df.collect(), key=lambda r: r.x)
    assert [r.row_no for r in rows] == list(range(1234))
    assert Counter(r.shard for r in rows) == {0: 500, 1: 500, 2: 234} and rows[7].key == "000007"
    assert numbered(spark.range(0).toDF("x"), "x").count() == 0


def test_image_columns(spark):
    r = spark.createDataFrame([("a.b.jpg.x", "http://h/p/q.png")], "n string, u string").select(B.image_key(F.col("n")).alias("k"), B.is_jpg(F.col("n")).alias("j"), B.url_image(F.col("u")).alias("i")).first()
    assert tuple(r) == ("a", True, "p_q.png")
    ok = spark.createDataFrame([(b"\xff\xd8\xff..\xff\xd9",), (b"\xff\xd8\xff..",), (b"",), (None,)], "d binary").select(B.valid_image(F.col("d")).alias("v"))
    assert [r.v for r in ok.collect()] == [True, False, False, False]


def test_caption_text(spark):
    rows = [("a", "b", "de"), ("a", "b", "en"), ("a", "", "de"), ("a", None, "de")]
    got = spark.createDataFrame(rows, "s string, t string, l string").select(B.caption_text(F.col("s"), F.col("t"), F.col("l")).alias("c"))
    assert [r.c for r in got.collect()] == ["b", "a", "a", "a"]


def test_one_caption_per_lang(spark):
    rows = [("i", "caption", "de", k) for k in range(5)] + [("i", "translation", "de", 9), ("i", "translation", "de", 8)]
    got = B.one_caption_per_lang(spark.createDataFrame(rows, "img string, type string, lang string, k int"), "img", F.col("k")).collect()
    assert sorted(r.k for r in got) == [0, 8, 9]


def test_fan_out(spark):
    df = spark.createDataFrame([("i", [str(k) for k in range(6)])], "img string, captions array<string>")
    got = E.fan_out(df, "captions").collect()
    assert len(got) == 25 and {r.code for r in got} >= {"deu_Latn", "zho_Hans"}
    r = spark.createDataFrame([("kaputt", " neu", "de"), ("Hund (x", "nie", "de")], "d string, r string, l string")
    assert [x.m for x in r.select(E.merged(F.col("d"), F.col("r"), F.col("l")).alias("m")).collect()] == ["neu.", "Hund."]


def test_policies():
    for name in S.POLICIES:
        assert 0.99 < sum(S.policy(name).values()) < 1
    with pytest.raises(ValueError, match="no such policy"):
        S.policy("other")


def test_sampler_converges(spark):
    target = S.normalised({"a": 3.0, "b": 1.0})
    rows = spark.range(800).select((F.col("id") % 2).alias("w"), F.col("id").alias("o"), F.array(F.lit("a"), F.lit("b")).alias("c"))
    got = S.dynamic_sample(rows, "w", "o", "c", target).collect()
    assert Counter(r.w for r in got) == {0: 400, 1: 400}
    for w in (0, 1):
        share = Counter(r.key for r in got if r.w == w)["a"] / 400
        assert share == pytest.approx(0.75, abs=0.02)
    bad = spark.createDataFrame([(0, 0, ["zzz"]), (0, 1, []), (0, 2, None)], "w int, o int, c array<string>")
    assert S.dynamic_sample(bad, "w", "o", "c", target).count() == 0


def test_sampler_against_plain_loop(spark):
    target = S.normalised({"a": 2.0, "b": 1.0, "c": 1.0})
    rows = [(i % 3, i, [["a", "b"], ["b", "c"], ["a", "c"]][i * 7 % 3]) for i in range(300)]
    got = {(r.w, r.o): r.key for r in S.dynamic_sample(spark.createDataFrame(rows, "w int, o int, c array<string>"), "w", "o", "c", target, seed=5).collect()}
    counts = {w: Counter() for w in range(3)}
    for w, o, keys in rows:
        weights = [int(target[k] * sum(counts[w].values()) >= counts[w][k]) + 1e-6 for k in keys]
        u, pick = S.hashed_uniform(5, w, o) * sum(weights), 0
        while u >= weights[pick]:
            u -= weights[pick]
            pick += 1
        counts[w][keys[pick]] += 1
        assert got[(w, o)] == keys[pick]


def test_loss_summary(spark):
    rows = [("en_caption", 1.0, 1), ("de_caption", 2.0, 3), ("es_caption", 3.0, 1), ("zh_caption", 4.0, 1), ("es_translation", 5.0, 1), ("zh_translation", 6.0, 3)]
    got = {r.name: r.loss for r in L.summarised(spark.createDataFrame(rows, "dataset string, loss double, n long")).collect()}
    assert got["id"] == 7 / 4 and got["ood"] == 23 / 4 and got["unseen"] == 3.5 and got["mean"] == 37 / 10 and got["es_caption"] == 3.0


def test_parameters(spark):
    d = spark.createDataFrame([("a.cross.w", 10), ("b.w", 30)], "name string, size long")
    c = L.parameter_counts(d, "name", "size", ["cross"])
    e = L.compute_estimate(c, F.lit(2.0), 10, 4).first()
    assert (e.total, e.trainable, e.seen, e.factor, e.training_macs) == (40, 10, 40, 1.25, 100.0)
    before = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, value double")
    after = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "name string, value double")
    assert [r.name for r in L.changed(before, after).collect()] == ["y"]


def test_accuracy_counts_ties_as_wrong(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (0.5, 1.0)], "c double, i double")
    assert d.agg(L.accuracy(F.col("c"), F.col("i")).alias("a")).first().a == 50.0


def predictions(spark, *rows):
    return spark.createDataFrame([(str(i), h, r) for i, (h, r) in enumerate(rows)], "id string, prediction string, references array<string>")


def test_bleu_of_equal_texts(spark):
    assert M.bleu(predictions(spark, (LONG, [LONG]), ("the cat sat on the mat", ["the cat sat on the mat"]))).first().bleu == pytest.approx(100)


def test_bleu_by_hand(spark):
    b = M.bleu(predictions(spark, ("the the the cat", ["the cat sat here", "the the dog"]))).first()
    # clipped: two of three "the", "cat"; bigrams "the the", "the cat"; no trigram, no 4-gram
    assert (b.p1, b.p2, b.p3, b.p4) == (75.0, pytest.approx(200 / 3), 25.0, 25.0)
    assert b.brevity == 1.0 and b.bleu == pytest.approx(math.exp(sum(map(math.log, (75, 200 / 3, 25, 25))) / 4))


def test_bleu_brevity_and_empty(spark):
    b = M.bleu(predictions(spark, ("the cat sat on", ["the cat sat on the mat"]), ("", ["a b"]))).first()
    assert b.brevity == pytest.approx(math.exp(1 - 8 / 4))


def test_cider(spark):
    got = {r.id: r.cider for r in M.cider(predictions(spark, ("a black cat sat", ["a black cat sat"]), ("a dog ran off", ["two birds flew past"]), ("", ["x y"]))).collect()}
    assert got["0"] == pytest.approx(10) and got["1"] == 0 and got["2"] == 0
    plain = {r.id: r.cider for r in M.cider(predictions(spark, ("a black cat", ["a black cat", "no match here"]), ("b", ["c"])), clipped=False).collect()}
    assert plain["0"] == pytest.approx(10 * 0.75 / 2)  # three orders of four exist


def test_meteor(spark):
    got = {r.id: r.meteor for r in M.meteor_exact(predictions(spark, ("the cat sat", ["the cat sat", "x"]), ("sat the", ["the sat"]), ("q", ["z"]), ("", ["z"]))).collect()}
    assert got["0"] == pytest.approx(1 - 0.5 / 27) and got["1"] == pytest.approx(0.5) and got["2"] == 0 and got["3"] == 0





def parsed(spark, f, text, **more):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"), F.lit(1000.0), F.lit(1000.0), **more).alias("r")).first().r


def test_parse_grounding(spark):
    got = parsed(spark, Z.grounded_phrases, "<s>a cat<loc_1><loc_2><loc_3><loc_4><loc_5><loc_6><loc_7><loc_8>the image<loc_1><loc_2><loc_3><loc_4>dög<loc_9><loc_9><loc_9><loc_9>no<loc_1></s>")
    assert [(r.cat_name, r.boxes) for r in got] == [("a cat", [[1.5, 2.5, 3.5, 4.5], [5.5, 6.5, 7.5, 8.5]]), ("dg", [[9.5] * 4])]


def test_parse_boxes(spark):
    assert [(r.cat_name, r.bbox) for r in parsed(spark, Z.described_boxes, "cat<loc_1><loc_2><loc_3><loc_4><loc_5>")] == [("cat", [1.5, 2.5, 3.5, 4.5])]
    free = parsed(spark, Z.described_boxes, "<loc_1><loc_2><loc_3><loc_4><loc_5><loc_6><loc_7><loc_8>", allow_empty=True)
    assert [r.cat_name for r in free] == ["", ""]
    assert [(r.cat_name, r.bbox[3]) for r in parsed(spark, Z.objects, "Red Cat <loc_0><loc_0><loc_0><loc_999>")] == [("red cat", 999.5)]
    assert parsed(spark, Z.described_boxes, "") == []


def test_parse_ocr(spark):
    eight = "".join(f"<loc_{i}>" for i in (0, 0, 100, 0, 100, 100, 0, 100))
    tiny = "<loc_1>" * 8
    assert [r.text for r in parsed(spark, Z.ocr_lines, f"STOP 1{eight}x{tiny}")] == ["STOP 1", "x"]
    assert [r.text for r in parsed(spark, Z.ocr_lines, f"STOP{eight}x{tiny}", area_threshold=0.001)] == ["STOP"]


def test_parse_polygons(spark):
    got = parsed(spark, Z.described_polygons, "cat<poly><loc_1><loc_2><loc_3><loc_4><loc_5><sep><loc_6><loc_7></poly><poly><loc_8><loc_9></poly>")
    assert [(r.cat_name, r.bbox, r.polygons) for r in got] == [("cat", None, [[1.5, 2.5, 3.5, 4.5], [6.5, 7.5]]), ("cat", None, [[8.5, 9.5]])]
    boxed = parsed(spark, Z.described_polygons, "cat<loc_1><loc_2><loc_3><loc_4><loc_5><loc_6>", box_first=True)
    assert [(r.bbox, r.polygons) for r in boxed] == [([1.5, 2.5, 3.5, 4.5], [[5.5, 6.5]])]
    even = parsed(spark, Z.described_polygons, "<poly><loc_1><loc_2></poly>", allow_empty=True)
    assert even[0].polygons == [[1.5, 2.5]]


def test_parser_of_task(spark):
    got = spark.createDataFrame([("<OD>",), ("<ZZZ>",)], "t string").select(Z.parser_of(F.col("t")).alias("p"), Z.pure_text(F.lit("<s>a</s>")).alias("x"), Z.has_polygons(F.lit("a<poly>")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("description_with_bboxes", "a", True), ("pure_text", "a", True)]
    assert len(Z.UNGROUNDED) == 72 == len(set(Z.UNGROUNDED))


def test_report(spark):
    rows = [("t_a", "BLEU", 1.25), ("t_a", "COMET", 2.0), ("t_b", "BLEU", 3.0), ("u_c", "BLEU", 9.0)]
    results = spark.createDataFrame(rows, "task string, metric string, value double")
    t = T.selected(results, "t_", ["a", "b"], ["BLEU", "COMET"])
    assert T.lines(t, ["a", "b"], ["BLEU", "COMET"]) == ["a & a & b & b", "BLEU & COMET & BLEU & COMET", "1.2 & 2.0 & 3.0 & -100.0"]
    assert T.lines(T.means(t, ["BLEU", "COMET"]), [], ["BLEU", "COMET"])[1] == "2.1 & -49.0"
    assert T.selected(results, "t_", ["a", "zz"], ["BLEU"]).count() == 0


def test_models(spark):
    df = spark.createDataFrame([("x",)], "i string")
    assert tuple(df.select(models.captioned("echo", F.col("i"), "de").alias("a"), models.translated("echo", F.col("i"), "fr").alias("b")).first()) == ("de: x", "fr: x")
    ids = df.select(models.tokenised(F.lit("a cat, a")).alias("t")).first().t
    assert len(ids) == 4 and ids[0] == ids[3]


def test_running_total_over_many_partitions(spark):
    from corpusloom.operators.order import running_total

    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice([None, "a", "b", "c"]), i, rng.choice([None, 0, 1, 5, 7])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v int").withColumn("before", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_total(df, ["k"], ["o"], "v")
        assert got.columns == ["k", "o", "v", "before"]
        held = [(r.k, r.o, r.before) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = [], {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want.append((k, o, sums.get(k, 0)))
        sums[k] = sums.get(k, 0) + (v or 0)
    assert sorted(held, key=lambda r: r[1]) == want
    assert running_total(df.limit(0), ["k"], ["o"], "v").count() == 0
