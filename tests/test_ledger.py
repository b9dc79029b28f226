import pytest
from pyspark.sql import functions as F

from corpusloom.operators import drive as D
from corpusloom.operators import evaluate as E
from corpusloom.operators import models
from corpusloom.operators.ledger import Call, Ledger, batches


def call(folder, fails=()):
    """A model that leaves a file for each call and fails for some values until a file `mended` is there."""

    def make():
        import pathlib
        import uuid

        place = pathlib.Path(folder)

        def run(rows):
            if any(r["x"] in fails for r in rows) and not (place / "mended").exists():
                raise RuntimeError("no")
            (place / f"call-{uuid.uuid4().hex}").write_text(str(len(rows)))
            return [f"<{r['x']}>" for r in rows]

        return run

    return Call("m", make, ["x"])


def calls(folder):
    return sum(int(p.read_text()) for p in folder.glob("call-*"))


def test_a_rerun_asks_only_for_what_is_missing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    folder = tmp_path / "calls"
    folder.mkdir()
    df = spark.createDataFrame([(i, f"t{i % 20}" if i else None) for i in range(60)], "id int, x string").repartition(4)
    c = call(folder, ("t3", "t7"))
    got = {r.id: r.output for r in ledger.called(df, c).collect()}
    assert len(got) == 60 and got[0] == "<None>" and got[1] == "<t1>" and got[3] is None and got[7] is None
    assert calls(folder) == 19  # t0 to t19 and null, but for the two that failed
    assert {r.error for r in ledger.rows().where("error is not null").collect()} == {"RuntimeError: no"}
    (folder / "mended").touch()
    assert ledger.ask(df, c) == 2 and calls(folder) == 21
    assert ledger.ask(df, c) == 0 and calls(folder) == 21
    assert {r.id: r.output for r in ledger.called(df, c).collect()}[3] == "<t3>" and calls(folder) == 21
    # other settings are other requests
    assert ledger.ask(df, Call("m", c.make, ["x"], {"beams": 4}), wave=7) == 21 and calls(folder) == 42


def test_a_broken_run_keeps_its_waves(spark, tmp_path):
    """A fault that ends the run, not a model's: the waves before it are there."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    folder = tmp_path / "calls"
    folder.mkdir()
    df = spark.range(40).select(F.concat(F.lit("t"), "id").alias("x"))
    from corpusloom.operators import ledger as module

    def breaking():
        class Stop(BaseException): ...

        run = call(folder).make()

        def f(rows):
            if len(list(folder.glob("call-*"))) >= 3:
                raise Stop
            return run(rows)

        return f

    with pytest.raises(Exception):  # noqa: B017
        ledger.ask(df, Call("m", breaking, ["x"]), wave=8)
    kept = ledger.answers().count()
    assert 0 < kept < 40
    before = calls(folder)
    assert ledger.ask(df, call(folder)) == 40 - kept and calls(folder) - before == 40 - kept
    assert ledger.answers().count() == 40 and module.WAVE > 0


def test_batches_are_bounded():
    sizes = [5, 100, 1, 3000, 7, 7, 8, 0, 50]
    got = list(batches([{}] * len(sizes), sizes, tokens=60, most=4))
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    for b in got:
        assert len(b) <= 4 and (len(b) == 1 or max(sizes[i] for i in b) * len(b) <= 60)
    assert list(batches([], [])) == []


DATA = [
    ("coco_karpathy_caption", 0, "i0", "en", None, ["en: i0 and more"], None),
    ("coco_karpathy_caption", 1, "i1", "en", None, ["other words here now"], None),
    ("commute_translation_de", 0, "i0", "de", "the old house by the river", ["de: the old house by the river"], None),
    ("commute_translation_zh", 0, "i0", "zh", "a b", ["zh: a b"], None),
    *[("commute_lexical_ambiguity_de", i, f"i{i}", "de", f"s{i}", [f"right{i}"], f"wrong{i}") for i in range(8)],
]
SCHEMA = "task string, idx long, image string, lang string, source string, references array<string>, incorrect string"


def test_load_generate_cache_score(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    df = spark.createDataFrame(DATA, SCHEMA)
    comet = lambda rows: rows.select("id", (F.char_length("prediction") / F.char_length("reference")).alias("value"))
    got = {(r.task, r.metric): r.value for r in D.evaluated(df, "echo", ledger, comet).collect()}
    n = ledger.rows().count()
    assert n == 4 + 16
    assert got["commute_translation_de", "SacreBLEU"] == pytest.approx(100) == got["commute_translation_de", "HfBLEU"] and got["commute_translation_de", "COMET"] == pytest.approx(100)
    assert got["commute_translation_zh", "HfBLEU"] == 0 or got["commute_translation_zh", "HfBLEU"] == pytest.approx(100)
    m = models.Echo()
    right = [m.perplexity([""], "de", [f"s{i}"], [f"right{i}"])[0] < m.perplexity([""], "de", [f"s{i}"], [f"wrong{i}"])[0] for i in range(8)]
    assert got["commute_lexical_ambiguity_de", "accuracy"] == pytest.approx(100 * sum(right) / 8)
    again = {(r.task, r.metric): r.value for r in D.evaluated(df, "echo", ledger, comet).collect()}
    assert again == got and ledger.rows().count() == n  # no call


def test_descriptions(spark, tmp_path):
    df = spark.createDataFrame([("a\n\nb",), ("x",)], "image string")
    got = {r.image: r.description for r in D.described(df, "echo", Ledger(spark, f"file://{tmp_path}/l")).collect()}
    assert got == {"a\n\nb": "A b.", "x": "X."}


def test_all_reports_fill_from_one_table(spark):
    """Every metric a report asks for is among those that scored and accuracy_rows produce."""
    tasks = E.task_set("full")
    vectors = [1.0, 0.0]
    rows = [(t, 0, "s", "a small house by the river", ["a small house by the river"], vectors, vectors, vectors, vectors) for t in tasks if "ambiguity" not in t]
    df = spark.createDataFrame(rows, "task string, idx long, source string, prediction string, references array<string>, image_vector array<double>, text_vector array<double>, image_mvector array<double>, text_mvector array<double>")
    wanted = [(p + k, m) for _, p, keys, metrics, _ in E.REPORTS for k in keys for m in metrics]
    some = sorted({t for t, _ in wanted if "ambiguity" not in t})[::6]
    got = {(r.task, r.metric): r.value for r in E.scored(df, some, lambda x: x.select("id", F.lit(0.5).alias("value"))).collect()}
    pairs = spark.createDataFrame([(t, 1.0, 2.0) for t in tasks if "ambiguity" in t], "task string, correct double, incorrect double")
    got |= {(r.task, r.metric): r.value for r in E.accuracy_rows(pairs).collect()}
    for t, m in wanted:
        if t in some or "ambiguity" in t:
            assert (t, m) in got, (t, m)
    assert all(v == pytest.approx(250) for (t, m), v in got.items() if m in ("CLIPScore", "MCLIPScore"))
    assert all(v == 50 for (t, m), v in got.items() if m == "COMET")


def test_chinese_tokens_keep_latin_words(spark):
    got = spark.range(1).select(E.tokens_zh(F.lit("我有iPhone 15，价3.5元。OK!")).alias("t")).first().t
    assert got == ["我", "有", "iPhone", "15", "，", "价", "3.5", "元", "。", "OK", "!"]


def test_perplexities(spark):
    from corpusloom.functions.vectors import perplexity, perplexity_after

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 0.0], 1), ([1.0], [0.0], 5), ([], [], 0)], "l array<double>, m array<double>, p int")
    got = df.select(perplexity(F.col("l"), F.col("m")).alias("a"), perplexity_after(F.col("l"), F.col("p")).alias("b")).collect()
    assert got[0].a == pytest.approx(4.4816890703) and got[0].b == pytest.approx(12.1824939607) and got[1].a is None and got[1].b is None and got[2].b is None
