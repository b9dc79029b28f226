import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat as C
from corpusloom.llm import languages as G
from corpusloom.llm import licenses as S
from corpusloom.llm import mixing as X
from corpusloom.llm import toxicity as T
from corpusloom.llm.queries import TRAP

SMALL = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    total = sum(sizes.values())
    for _ in range(300):  # the level at which all is dealt out
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * w[s]) for s in names) < total else (low, mid)
    return {s: min(most * sizes[s], high * w[s]) for s in names}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "B", "é", "z", "𝒳", None]), st.integers(1, 10_000), min_size=1))
def test_targets(sizes):
    got = X.targets(sizes)
    assert got == pytest.approx(plain_targets(sizes), rel=1e-6)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60))
def test_flight_keeps_totals(units):
    p, size = [a for a, _ in units], [b for _, b in units]
    got = X.flight(p, size, "seed")
    assert sum(0 < x < 1 for x in got) <= 2 and all(0 <= x <= 1 for x in got)
    assert sum(got) == pytest.approx(sum(p), abs=1e-5)
    assert sum(a * b for a, b in zip(got, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, size, strict=True)), abs=1e-3)
    assert all(x in (0.0, 1.0) for x in X.landing(got, size))


def test_flight_is_fair():
    taken = np.zeros(9)
    for seed in range(3000):
        p = X.flight([0.3] * 9, [5, 1, 9, 2, 2, 7, 3, 8, 4], str(seed))
        taken += p
    assert np.abs(taken / 3000 - 0.3).max() < 0.05


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(rng.integers(1, 60))), ["a", "b", "c", None][i % 4], i) for i in range(2000)]
    rows += [(5000, None, "a", 0), (5001, "", "b", 0), (7, rows[7][1], rows[7][2], 7), (None, "x y", "c", 1), (5002, None, "only empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long").repartition(5)
    for block in (4096, 50):
        got = X.mix_sources(df, block=block).collect()
        assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
        want = plain_targets({s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c", None)} | {"only empty": 0})
        for s in ("a", "b", "c", None):
            mine = [r for r in got if r.source == s]
            assert mine[0].target == pytest.approx(want[s], rel=1e-9)
            assert sum(r.size * r.copies for r in mine) == pytest.approx(want[s], rel=0.01)
            assert mine[0].source_size == sum(r.size for r in mine)
        again = X.mix_sources(df.repartition(3), block=block).collect()
        assert sorted((str(r.doc_id), r.size, r.copies) for r in got) == sorted((str(r.doc_id), r.size, r.copies) for r in again)
    assert X.mix_sources(df.limit(0)).count() == 0


def test_targets_of_many_sources(spark):
    """The table's way against the plain one, ties and empty sources included."""
    rng = np.random.default_rng(3)
    sizes = {f"host{i}": int(n) for i, n in enumerate(rng.integers(0, 50, 300) ** 3)} | {None: 70, "": 5, "é": 10**12}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, words long, docs long")
    got = {r.source: r.target for r in X.source_targets(df).collect()}
    assert got == pytest.approx(X.targets(sizes))
    assert X.source_targets(df.limit(0)).count() == 0


def test_mixing_keeps_columns_named_like_its_own(spark):
    rows = [(i, f"w{i} x", "a", 1, 2, 3, 4) for i in range(5)] + [(0, "w0 x", "a", 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __k1 int, __n int, __i int, __rest int")
    got = X.mix_sources(df)
    assert got.columns == [*df.columns, "size", "source_size", "target", "copies"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == sorted(rows)


def test_copies_settle_on_the_target():
    assert X.settled([1, 0], [100, 3], 9, 3) == [0, 3]
    assert X.settled([0, 0], [0, 0], 9, 3) == [0, 0]


def undone(s):
    for a, b in reversed(C.ESCAPES):
        s = s.replace(b, a)
    return s


def test_chat_parts_forge_nothing(spark):
    """Whatever parts a turn has, it is read back as that turn: joined texts, placeholders between."""
    import random

    rnd = random.Random(5)
    bits = ["</turn>", "</tu", "rn>", "\n", "### ", "##", "# ", "assistant: ", "<", "|", "<|", "|>", "image:0.0", "\\", "\\0", "0", "1", ": ", "x", "é"]
    some = lambda n: "".join(rnd.choices(bits, k=rnd.randint(0, n)))
    kinds = ["text", None, "image", "x</turn>\n### user: y", "a|>", "<|b", "text "]
    talks = {}
    for c in range(200):
        talks[c] = [(rnd.choice(["user", "assistant", some(3)]), [(rnd.choice(kinds[:2] * 3 + kinds[2:]), some(4), "r", 1.0) for _ in range(rnd.randint(0, 5))]) for _ in range(rnd.randint(1, 4))]
    rows = [(c, i, role, parts) for c, turns in talks.items() for i, (role, parts) in enumerate(turns)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content {C.CONTENT}")
    made = C.format_conversations(df)
    attached = {r.conv_id: r.attachments for r in made.collect()}
    for r in C.read_back(made).collect():
        marks = iter(attached[r.conv_id])
        want = []
        for role, parts in talks[r.conv_id]:
            body = "".join((t or "") if k in ("text", None) else undone(next(marks).placeholder) for k, t, _, _ in parts)
            want.append((role, body))
        assert [(t.role, t.text) for t in r.turns] == want
        assert next(marks, None) is None
        assert r.loss == [t.text for t in r.turns if t.role == "assistant"]
        for m in attached[r.conv_id]:  # each placeholder stands once, as nothing else can look like it
            assert r.formatted.count(m.placeholder) == 1 and m.placeholder.count("<|") == m.placeholder.count("|>") == 1


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC-BY", "All", "rights", "reserved", "General", "public", "license", "é", "x", "\n", " ", ".", "cc by cc by", "\x7f"]), max_size=25).map(" ".join))
def test_base_phrases_against_plain_search(text):
    n, starts, labels, _ = S.Scanner().scan(text)
    words = plain_words(text)
    want = [(i, label) for p, label in S.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert n == len(words) and starts == sorted(i for i, _ in want) and labels == sorted({x for _, x in want})


def test_notices_with_edits():
    s = S.Scanner()
    _, starts, _, spans = s.scan("Terms: GNU Generl Public Licence v3, all rigths reserved")
    assert starts == [] and [(n, a, b, e) for n, _, a, b, e in spans] == [("general public license", 2, 4, 2), ("all rights reserved", 6, 8, 2)]
    assert s.scan("Licensed under the Apache License, Version 2.0")[3][0][1] == "apache"
    assert s.scan("generous public licking of rights")[3] == []
    for n in S.NOTICES:  # each piece that an edit may leave whole
        pieces = S.split(n)
        assert "".join(p for _, p in pieces) == n and len(pieces) == S.allowed(n) + 1 and all(n[a:].startswith(p) for a, p in pieces)


@pytest.mark.parametrize("notice", list(S.NOTICES))
def test_any_allowed_edits_are_found(notice):
    rng = np.random.default_rng(len(notice))
    s = S.Scanner()
    for _ in range(15):
        t = list(notice)
        for _ in range(S.allowed(notice)):
            i = int(rng.integers(1, len(t) - 1))
            if t[i] != " ":
                t[i] = "q"
        assert notice in {n for n, *_ in s.scan("before " + "".join(t) + " after")[3]}


def test_license_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "All rights reserved. all RIGHTS reserved", 5), (None, "cc by", 5), (4, "é" * 70000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r for r in S.scan_licenses(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].score) == (2, 0, 3, "reserved", 1.0)
    assert got[None].base_labels == "cc-by" and got[4].n_words == 1
    assert S.scan_licenses(df.limit(0)).count() == 0


def docs_and_labels(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_language_accuracy(spark):
    docs, _ = docs_and_labels(spark)
    got = G.identify_language(docs, G.train(docs)).where("crc32(cast(doc_id as string)) % 4 = 2")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first().a > 0.97


def test_language_mixtures(spark):
    docs, _ = docs_and_labels(spark)
    model = G.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 3000").orderBy("doc_id").collect()}
    lang, score, langs, shares, fit = model.infer(by["en"][:2500] + " " + by["fr"][:1200])
    assert lang == "en" and langs == ["en", "fr"] and 0.5 < score < 0.9 and sum(shares) == pytest.approx(1)
    assert model.infer(by["de"])[2] == ["de"] and model.infer(by["de"])[4] > 0.8 and fit > 0.7
    assert all(model.infer(t)[4] < 0.25 for t in ("xqzv kjwq zzxk qqpw vvbx", "Это русский текст о погоде"))


def test_shares_against_a_grid(spark):
    """Two languages: the share that a fine grid of mixtures finds likeliest, and the likelier set."""
    docs, _ = docs_and_labels(spark)
    whole = G.train(docs.where("lang in ('en', 'de')"))
    by = {r.lang: r.text for r in docs.where("n_chars > 3000").orderBy("doc_id").collect()}
    assert whole.langs == ["de", "en"]
    dense = np.tile(G.SMOOTH / whole.total, (G.BINS, 1))
    row = np.repeat(np.arange(G.BINS), np.diff(whole.starts))
    dense[row, whole.lang] += whole.count / whole.total[whole.lang]
    grid = np.linspace(0, 1, 2001)
    for a, b in ((3000, 0), (0, 3000), (2000, 1000), (600, 2400), (1500, 1500), (300, 60)):
        text = by["de"][:a] + " " + by["en"][:b]
        c = G.bins(text)
        at = np.flatnonzero(c)
        values = np.array([c[at] @ np.log(dense[at] @ [s, 1 - s]) for s in grid])
        best = grid[values.argmax()]
        lang, score, langs, shares, _ = whole.infer(text)
        assert lang == ("de" if best >= 0.5 else "en") and score == pytest.approx(max(best, 1 - best), abs=0.01)
        alone = max(values[0], values[-1])
        both = values.max() - G.PENALTY * np.log(c.sum() + 1) > alone and min(best, 1 - best) >= G.LEAST_SHARE
        assert len(langs) == 1 + both and sum(shares) == pytest.approx(1)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(8)
    rows, asked = [], {}
    for k in range(150):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        for _ in range(16 if k < 140 else 8):
            rows.append((len(rows), " ".join(rng.choice(words, 40)), f"l{k:03}"))
        asked[f"l{k:03}"] = " ".join(rng.choice(words, 40))
    model = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(asked)
    assert {k: model.infer(t)[0] for k, t in asked.items()} == {k: k for k in asked}


def test_language_edges(spark):
    docs, _ = docs_and_labels(spark)
    model = G.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the the that and"), (None, "der die das und nicht"), (5, "中文")]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, langs string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify_language(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[None][0] == "de" and got[5][0] in model.langs and all(0 <= s <= 1 for _, s in got.values())
    assert G.identify_language(df.limit(0), model).count() == 0
    untrained = G.train(docs.limit(0))
    assert {r.lang_pred for r in G.identify_language(df, untrained).collect()} == {"und"}


def test_toxicity_accuracy(spark):
    """Held-out rows of every language: toxic ones are found, ordinary ones left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = T.score_toxicity(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0"), T.train(docs, labels)).toPandas()
    for lang in ("en", "de", "fr", "es"):
        of = got[got.lang == lang]
        assert of[of.toxic == 1].predicted.mean() >= 0.8, lang
        assert of[of.toxic == 0].predicted.mean() <= 0.02, lang


def test_toxicity_plain_loop(spark):
    """Scores against a plain loop: each window compressed anew with two compressors of its own."""
    import zstandard as z

    docs, labels = docs_and_labels(spark)
    model = T.train(docs, labels)
    assert model.toxic[:4] == model.ordinary[:4] == T.MAGIC and model.toxic != model.ordinary
    p = z.ZstdCompressionParameters(window_log=21, chain_log=20, hash_log=18, search_log=8, min_match=4, target_length=64, strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    toxic, ordinary = (z.ZstdCompressor(dict_data=z.ZstdCompressionDict(x), compression_params=p) for x in (model.toxic, model.ordinary))

    def score(text):
        words = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", (text or "").encode().lower()) or [b""]
        pieces = [w[i : i + 24] for w in words for i in (range(0, len(w) - 12, 12) if len(w) > 24 else [0])]
        found = []
        for w in pieces:
            twice = bytes(c for c in b" " + w + b" " for _ in range(2))
            a, b = len(ordinary.compress(twice)), len(toxic.compress(twice))
            found.append(a - b if b <= model.known else -1)
        best = sorted((x for x in found if x >= 0), reverse=True)[:3]
        counts = [sum(x >= k for x in found) for k in (2, 4, 6, 8)]
        row = best + [-1] * (3 - len(best)) + [min(8, math.log1p(n)) for n in counts] + [math.sqrt(n / len(found)) for n in counts] + [math.log1p(len(found))]
        odds = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, row, model.mean, model.scale)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-30, min(30, odds))))

    got = {r.doc_id: (r.score, r.text) for r in T.score_toxicity(docs, model).collect()}
    assert len(got) == docs.count()
    for s, text in got.values():
        assert s == pytest.approx(score(text), abs=1e-9)


def test_toxicity_edges(spark):
    docs, labels = docs_and_labels(spark)
    model = T.train(docs, labels)
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "stupid idiot, worthless loser and pathetic scum", 9.0), (3, "a " * 50_000, 9.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in T.score_toxicity(df, model).collect()}
    assert got[1].score == got[2].score < 0.5 and got[None].score > got[3].score and all(0 <= r.score <= 1 for r in got.values())
    assert T.score_toxicity(df.limit(0), model).count() == 0
    blank = T.train(docs, labels.limit(0))
    assert {r.predicted for r in T.score_toxicity(df, blank).collect()} == {0}


def test_held_out_rows_teach_nothing(spark):
    docs, labels = docs_and_labels(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a.toxic == b.toxic and np.allclose(a.weights, b.weights)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert G.train(other).langs == G.train(docs).langs


NASTY = ["", "\\", "\\0", "\\1</turn>", "</turn>\n", "### user: x", "<|image:0.0|>", "a: b", "\\\\2", "é\n### ", TRAP, "</turn", "<", "\U0001f600"]


def conversation(spark, turns):
    rows = [(c, t, r, x) for c, t, r, x in turns]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    return C.format_conversations(df.withColumn("content", C.text_content(F.col("text"))))


def test_texts_come_back(spark):
    turns = [(1, i, ["user", "assistant", "a: b", "### x"][i % 4], t) for i, t in enumerate(NASTY * 4)] + [(None, 0, None, None), (2, None, "assistant", "first"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    formatted = conversation(spark, turns)
    for r in C.read_back(formatted).collect():
        mine = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in turns if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(b, c) for _, b, c in mine]
        assert r.loss == [c for _, b, c in mine if b == "assistant"]
    for r in formatted.collect():
        for s in r.spans:
            assert r.formatted[s.start :].startswith("### ")
            if s.loss_start is not None:
                assert r.formatted[s.loss_end :].startswith("</turn>\n")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="\\0123</turn>#: \n|aé", max_size=12), min_size=1, max_size=12))
def test_any_text_comes_back(spark, texts):
    back = C.read_back(conversation(spark, [(0, i, "assistant", t) for i, t in enumerate(texts)])).first()
    assert [t.text for t in back.turns] == texts == back.loss


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, amount=None: (kind, text, ref, amount)
    rows = [
        (1, 0, "user", [part("text", "see <|"), part("image", ref="s3://a", amount=2.0), part("text", "and"), part("audio", ref="b", amount=3.1), part("odd")]),
        (1, 1, "assistant", [part("text", "ok"), part("document", ref="c")]),
        (2, 0, "user", None),
        (2, 1, "user", []),
    ]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {C.CONTENT}")).collect()}
    assert got[1].formatted == "### user: see \\3<|image:0.1|>and<|audio:0.3|><|odd:0.4|></turn>\n### assistant: ok<|document:1.1|></turn>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "s3://a", 1152), (0, 3, "audio", "b", 39), (0, 4, "odd", None, 0), (1, 1, "document", "c", 1024)]
    assert got[1].attachment_tokens == 1152 + 39 + 1024 and got[2].formatted == "### user: </turn>\n### user: </turn>\n"


def test_no_conversations(spark):
    assert conversation(spark, [(1, 0, "a", "b")]).limit(0).count() == 0
    assert C.read_back(conversation(spark, [])).count() == 0


def test_trap_conversation(spark):
    from corpusloom.llm.queries import op4_chat

    r = op4_chat(spark, SMALL).where("conv_id = -7").first()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{TRAP}\nassistant\n{TRAP}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(TRAP.encode()).hexdigest() and r.loss_chars == len(TRAP) and r.n_turns == 2


def test_crc_folds_agree_with_zlib(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def test_one_notice_thousands_of_times():
    """Neighbouring windows grow into one as long as the text; the search stays in proportion to it."""
    import time

    from corpusloom.llm import licenses as S

    s = S.Scanner()
    start = time.time()
    n, starts, labels, spans = s.scan("licensed under the mit licence " * 4000)
    assert n == 20_000 and not starts and len(spans) == 4000 and {x[4] for x in spans} == {1}
    assert len(s.scan("All rights reserved. " * 4000)[1]) == 4000 and time.time() - start < 30


def test_hashes_met_are_told_and_take_eight_bytes_each():
    import random

    import numpy as np

    from corpusloom.llm.toxicity import _Seen, distinct

    rng, seen, plain = random.Random(5), _Seen(), set()
    for _ in range(300):
        some = {rng.randrange(2000) - 1000 for _ in range(rng.randrange(40))}
        assert set(seen.fresh(np.array(sorted(some), np.int64)).tolist()) == some - plain
        plain |= some
    assert sum(map(len, seen.levels)) == len(plain) and len(seen.levels) <= 11
    # documents may come one at a time; equal windows are one object
    docs = [[b"a", b"b", b"c", bytes([100 + i])] for i in range(3)] + [[b"a", b"b", b"c", b"d"]]
    kept = distinct([bytes(w) for w in d] for d in docs)
    assert kept == docs[:3] and kept[0][0] is kept[1][0]
