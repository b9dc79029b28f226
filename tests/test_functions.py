import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrays as R
from corpusloom.functions import boxes as B
from corpusloom.functions import prompts as P
from corpusloom.functions import text as X
from corpusloom.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **values):
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(0).alias("_")]).select(column.alias("r")).first().r

    return value


@pytest.mark.parametrize(
    ("text", "want"),
    [("One. Two!", ["One.", "Two!"]), ("no end", ["no end"]), ("  ", []), ("", []), ("A?? b...", ["A??", "b..."]), (None, None)],
)
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.sentences(F.col("t")).alias("s")).first().s == want


def test_strip_knows_all_white_space(one):
    assert one(X.strip(F.col("t")), t="\t\n a b  ") == "a b"


def test_case(one):
    assert one(X.capitalize(F.col("t")), t="a BC") == "A bc"
    assert one(X.upper_first(F.col("t")), t="a BC") == "A BC"
    assert one(X.upper_first(F.col("t")), t="") == ""


def test_cleaning(one):
    assert one(X.drop_newlines(F.col("t")), t=" a\nb\n") == "ab"
    assert one(X.flatten_newlines(F.col("t")), t="a\n\n b\n") == "a  b"
    assert one(X.caption_only(F.col("t")), t="a photo of a\ncat ") == "a cat"
    assert one(X.strip_special_tokens(F.col("t")), t="<s>a<pad></s>") == "a"
    assert one(X.ascii_only(F.col("t")), t="aéb中") == "ab"
    assert one(X.plain_piece(F.col("t")), t="▁word") == " word"
    assert one(X.is_url(F.col("t")), t="https://x") is True
    assert one(X.meteor_score(F.col("t")), t="x\nFinal score:   0.25\n") == pytest.approx(25.0)


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [("Hallo", "de", "Hallo."), ("Hallo!", "de", "Hallo!"), ("好", "zh", "好。"), ("好.", "zh", "好。"), ("好。", "zh", "好。"), ("好？", "zh", "好？"), ("", "de", "")],
)
def test_end_sentence(one, text, lang, want):
    assert one(X.end_sentence(F.col("t"), F.col("l")), t=text, l=lang) == want


def test_end_sentence_compat(one):
    assert one(X.end_sentence(F.col("t"), F.col("l"), compat=True), t="好。", l="zh") == "好。。"
    assert one(X.end_sentence(F.col("t"), F.col("l"), compat=True), t="好？", l="zh") == "好？。"
    with pytest.raises(Exception, match="empty translation"):
        one(X.end_sentence(F.col("t"), F.col("l"), compat=True), t="", l="zh")


@pytest.mark.parametrize(
    ("decoded", "failed", "strict"),
    [("ein Hund ### (x)", False, False), ("ein Hund", True, True), ("(x", True, True), ("aaa # (x)", False, True), ("#", True, True), ("ab # c (d", False, True)],
)
def test_failed_translations(one, decoded, failed, strict):
    assert one(X.translation_failed(F.col("t")), t=decoded) is failed
    assert one(X.translation_failed_strict(F.col("t")), t=decoded) is strict


def test_normaliser(one):
    assert one(X.metric_tokens(X.nfkc(F.col("t"))), t="Ｔhe «ﬁsh», twice…") == ["the", "fish", "twice"]
    assert one(X.metric_tokens(F.col("t"), F.col("l")), t="你 好。", l="zh") == ["你", "好"]


@pytest.mark.parametrize(("n", "want"), [(999, "999"), (1234, "1 K"), (5_600_000, "6 M"), (7_000_000_000, "7 B"), (3 * 10**12, "3 T"), (2 * 10**15, "2000 T")])
def test_human_count(one, n, want):
    assert one(X.human_count(F.col("n")), n=n) == want


def test_human_count_compat(one):
    assert one(X.human_count(F.col("n"), compat=True), n=2 * 10**15) == "2 T"
    assert one(X.size_text(F.col("n")), n=12345.6789) == "12,345.679"


@pytest.mark.parametrize(("key", "want"), [(7, "000000007"), (1234567890, "1234567890"), (None, None)])
def test_padded_key(spark, key, want):
    assert spark.createDataFrame([(key,)], "k long").select(X.padded_key(F.col("k")).alias("k")).first().k == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<LANG_DE><CAPTION>", "The target language is German. What does the image describe?"),
        ("<MORE_DETAILED_CAPTION>", "Describe with a paragraph what is shown in the image."),
        ("<LANG_ZH><TRANSLATE>a cat", "The target language is simplified Chinese. Translate the following text: a cat"),
        ("<REGION_TO_CATEGORY><loc_1>", "What is the region <loc_1>?"),
        ("plain", "plain"),
    ],
)
def test_expand_prompt(one, text, want):
    assert one(P.expand_prompt(F.col("t")), t=text) == want


@pytest.mark.parametrize("text", ["<LANG_DE><LANG_EN><CAPTION>", "<CAPTION> more"])
def test_expand_prompt_errors(one, text):
    with pytest.raises(Exception, match="only one language|must stand alone"):
        one(P.expand_prompt(F.col("t")), t=text)


def test_unknown_style(one):
    with pytest.raises(Exception, match="unknown style"):
        one(P.caption_prompt(F.col("l"), F.col("s")), l="de", s="long")


def test_prefix_and_context(one):
    assert one(P.without_prefix(F.col("t"), F.col("l")), t="Das Bild zeigt eine Katze", l="de") == " eine Katze"
    assert one(P.context_source(F.col("a"), F.col("b")), a="cat", b="a black cat") == "cat ### (a black cat)"
    assert one(P.instruction(F.col("l")), l="fr") == "Describe this image in one short sentence in French. Only answer with the caption."


def test_arrays(one):
    ids = F.array(*map(F.lit, [5, 6, 7]))
    assert one(R.truncated(ids, 2)) == [5, 6]
    assert one(R.padded(ids, F.lit(5), -100)) == [5, 6, 7, -100, -100]
    assert one(R.padded(ids, F.lit(2), 0)) == [5, 6, 7]
    assert one(R.within_vocabulary(ids, 6)) == [5, -100, -100]
    assert one(R.without_first(ids)) == [6, 7]
    assert one(R.inserted(ids, 9)) == [5, 9, 6, 7]
    assert one(R.shifted_right(F.array(F.lit(5), F.lit(-100), F.lit(7)), 2, 0)) == [2, 5, 0]
    assert [tuple(x) for x in one(R.spans(F.array(F.lit("ab"), F.lit(""), F.lit("c"))))] == [(0, 2), (2, 2), (2, 3)]


def test_vectors(one):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))
    assert one(V.clip_score(a, a)) == 2.5
    assert one(V.clip_score(a, b)) == 0.0
    assert one(V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(V.cross_entropy(F.array(F.lit(1.0), F.lit(1000.0)), F.lit(1))) == pytest.approx(0)
    assert one(V.masked_mean(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(V.sinusoid(F.lit(0), 4)) == [0, 0, 1, 1]


@settings(max_examples=25, deadline=None)
@given(st.floats(0, 1000, allow_nan=False), st.floats(1, 1000))
def test_bins_are_near(spark, value, size):
    row = spark.range(1).select(B.quantised(F.lit(value), F.lit(size)).alias("q")).withColumn("m", B.dequantised(F.col("q"), F.lit(size))).first()
    assert 0 <= row.q <= 999
    if value < size:
        assert math.isclose(row.m, value, abs_tol=size / 1000 * 1.001)


def test_quad_area(one):
    square = F.array(*map(F.lit, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]))
    assert one(B.quad_area(square)) == 4.0
    assert one(B.quad_area(F.array(*map(F.lit, [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0])), compat=True)) != 4.0


def test_merged_sequences_and_room(spark):
    from corpusloom.functions import vectors as V
    from corpusloom.operators import vocabulary as O

    one = spark.range(1)
    r = one.select(V.merged_sequence(F.array(F.array(F.lit(1.0))), F.array(F.lit(1)), F.array(F.array(F.lit(2.0)), F.array(F.lit(3.0))), F.array(F.lit(1), F.lit(0))).alias("s")).first().s
    assert r["values"] == [[1.0], [2.0], [3.0]] and r["mask"] == [1, 1, 0]
    assert one.select(V.mean_vector(F.array().cast("array<array<double>>")).alias("m")).first().m is None
    assert one.select(V.softmax(F.array(F.lit(1e9), F.lit(1e9), F.lit(None).cast("double"))).alias("s")).first().s == [0.5, 0.5, 0.0]
    with pytest.raises(ValueError):
        V.pooled_features(F.lit(None), ("other",))
    assert O.text_room(1024, 577) == 447 and O.prompt_list("a") == ["a"] and O.prompt_list(["a", "b"]) == ["a", "b"] and O.prompt_list(None) == []
    with pytest.raises(ValueError):
        O.text_room(10, 10)


def test_trial_runs_and_listing(spark, tmp_path):
    from corpusloom.operators.order import first_batch, length, numbered, preview
    from corpusloom.sources.readers import listed

    rows = numbered(spark.range(100).repartition(5), "id")
    assert sorted(r.id for r in first_batch(rows, 7).collect()) == list(range(7)) and [r.id for r in preview(rows, "id", n=3).collect()] == [0, 1, 2]
    assert length(rows) == 100 and length(rows, 5) == 5
    for n in ("a-00.tar", "a-01.tar", "a-02.tar", "b.txt"):
        (tmp_path / n).write_text("x")
    assert [p.rpartition("/")[2] for p in listed(spark, f"{tmp_path}/a-{{01..05}}.tar")] == ["a-01.tar", "a-02.tar"]
    assert len(listed(spark, f"{tmp_path}/*.tar")) == 3 and listed(spark, f"{tmp_path}/none*") == []
