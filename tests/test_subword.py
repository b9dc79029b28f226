import pytest
from pyspark.sql import functions as F

from corpusloom.functions import prompts as P
from corpusloom.operators import annotate as A
from corpusloom.operators import bake as B
from corpusloom.operators import subword as U
from corpusloom.operators.vocabulary import special_tokens

tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
TEXTS = ["A small house.", "", None, "Über den Fluß, 3 Äpfel!", "猫は外", "  two  spaces\n", "it's <loc_5> and <od>", "<|endoftext|> is text", "x" * 500]


def library(name, text):
    """Ids by the library itself, as the vocabularies' notes say."""
    path = tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return t.encode(text, add_special_tokens=False).ids
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(spark, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)
    got = {r.i: r.ids for r in df.select("i", U.token_ids(F.col("t"), tokenizers.path(name)).alias("ids")).collect()}
    assert got == {i: None if t is None else library(name, t) for i, t in enumerate(TEXTS)}


def test_special_tokens_come_after_the_vocabulary(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    special = special_tokens(languages=True)
    v = U.opened(path, special)
    assert v.special["<od>"] == 50257 and v.special["<LANG_FR>"] == 50257 + len(special) - 1
    assert v.encode(["it's <loc_5> and <od><LANG_DE>"]) == [[*library("byte_bpe_50k.json", "it's "), v.special["<loc_5>"], *library("byte_bpe_50k.json", " and "), v.special["<od>"], v.special["<LANG_DE>"]]]
    assert v.encode(["", "<od>", "plain"]) == [[], [v.special["<od>"]], library("byte_bpe_50k.json", "plain")]
    df = spark.createDataFrame([("a <od>",)], "t string")
    assert df.select(U.token_ids(F.col("t"), path, special, before=[0], after=[2]).alias("x")).first().x == [0, *library("byte_bpe_50k.json", "a "), 50257, 2]


def test_one_vocabulary_in_anothers_ids(spark):
    new, old = tokenizers.path("piece_bpe_32k.model"), tokenizers.path("byte_bpe_50k.json")
    match = U.vocabulary_match(spark, new, old, {1: [50256], 2: [50256]})
    got = {r.new_id: r.old_ids for r in match.collect()}
    assert len(got) == 32000 and got[1] == got[2] == [50256]
    v = U.opened(new)
    for i in range(300, 32000, 997):
        piece = v.piece(i)
        assert got[i] == library("byte_bpe_50k.json", " " + piece[1:] if piece.startswith("▁") else piece)


def test_token_statistics_of_subwords(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [("caption", "en", "<LANG_EN><CAPTION>", "A small house near the river."), ("caption", "en", "<LANG_EN><CAPTION>", "Rain."), ("translation", "de", "<LANG_DE><TRANSLATE>Rain.", "Regen.")]
    df = spark.createDataFrame(rows, "type string, lang string, prompt string, output string")
    got = {(r.type, r.lang): r for r in A.token_statistics(df, lambda c: F.size(U.token_ids(c, path))).collect()}
    n = [len(library("byte_bpe_50k.json", r[3])) for r in rows]
    assert (got["caption", "en"].total_output, got["caption", "en"].max_output, got["translation", "de"].total_output) == (n[0] + n[1], max(n[:2]), n[2])


def test_used_pieces(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("a a b",), (None,), ("",)], "text string")
    want = {}
    for i in library("byte_bpe_50k.json", "a a b"):
        want[i] = want.get(i, 0) + 1
    assert {r.id: r.n for r in U.used_pieces(df, path).collect()} == want


def test_baked_records(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [("i1", "DE", "cat", "Katze", "caption", "short"), ("i2", "en", "cat", "x", "caption", "detailed"), ("i3", "FR", "the cat", "le chat", "translation", None), ("i4", "es", "gato", None, "caption", "more_detailed")]
    df = spark.createDataFrame(rows, "img_path string, lang string, source string, target string, type string, style string")
    got = {r.img_path: r for r in B.baked(df, lambda c: U.token_ids(c, path)).collect()}
    assert [(got[i].lang, got[i].output) for i in ("i1", "i2", "i3", "i4")] == [("de", "Katze"), ("en", "x"[:0] or "cat"), ("fr", "le chat"), ("es", "gato")]
    assert got["i3"].prompt == "The target language is French. Translate the following text: the cat" and got["i1"].prompt == f"{P.MODIFIERS['<LANG_DE>']} {P.TASKS['<CAPTION>']}"
    assert all(r.prompt_ids == library("byte_bpe_50k.json", r.prompt) and r.output_ids == library("byte_bpe_50k.json", r.output) for r in got.values())
    with pytest.raises(Exception, match="unknown type"):
        B.baked(df.withColumn("type", F.lit("other")), lambda c: F.split(c, "")).collect()


def test_sources(spark):
    assert len(B.TRAIN_SOURCES) == 16 and len(B.VALIDATION_SOURCES) == 11
    files = [f for f, _, _ in B.TRAIN_SOURCES]
    assert sorted(k for k in set(files) if files.count(k) == 2) == ["translation_data/" + f for f in ("coco_karpathy_restval_translate.csv", "coco_karpathy_translate.csv", "docci_translate.csv", "image_paragraphs_translate.csv")]
    rows = B.source_rows(lambda f: spark.createDataFrame([(f, "en", "a", "b")], "img_path string, lang string, source string, target string"), B.VALIDATION_SOURCES)
    assert {(r.img_path, r.type, r.style, r.source_no) for r in rows.collect()} == {(*s, i) for i, s in enumerate(B.VALIDATION_SOURCES)}
