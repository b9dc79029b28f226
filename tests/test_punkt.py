import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import punkt as K

WS = " \t\n\x0b\f\r"
OPEN, CLOSE = "\"'([{«“‘„¿¡", "\"')]}»”’,;:"


def plain_token(piece):
    p = piece.rstrip(WS)
    core = p.lstrip(OPEN)
    core = core.rstrip(CLOSE)
    bare = core.rstrip(".!?").lower()
    kind = "#" if re.fullmatch(r"[-+]?[0-9]+([.,][0-9]+)*", bare) else bare
    tail = p[len(p.rstrip("\"')]}»”’,;:")) :]
    point = core.endswith(".") and not core.endswith("..")
    if any(c in ",;:" for c in tail):
        end = ","
    elif core[-1:] in ("!", "?") and core:
        end = "!"
    else:
        end = ".." if core.endswith("..") else "." if core.endswith(".") else ""
    case = "upper" if core[:1].isupper() else "lower" if core[:1].islower() else "none"
    return kind, point, end, case


def log_l(k, n, p):
    part = lambda c, q: 0.0 if c <= 0 else -1e9 if q <= 0 else c * math.log(q)
    return part(k, p) + part(n - k, 1 - p)


def association(c1, c2, both, n):
    p, p1 = c2 / n, both / c1
    p2 = (c2 - both) / (n - c1) if n > c1 else 0.0
    if p1 <= p:
        return 0.0
    return 2 * (log_l(both, c1, p1) + log_l(c2 - both, n - c1, p2) - log_l(both, c1, p) - log_l(c2 - both, n - c1, p))


class PlainPunkt:
    def __init__(self, texts):
        docs = [[plain_token(p) for p in re.findall(K.PIECE, t)] for t in texts if t]
        count, pointed = Counter(), Counter()
        for d in docs:
            for kind, point, _, _ in d:
                count[kind] += 1
                pointed[kind] += point
        n, points = sum(count.values()), sum(pointed.values())
        self.abbreviations = set()
        for w, k in pointed.items():
            if k and any(c.isalpha() for c in w):
                letters = len(w.replace(".", ""))
                ratio = 2 * (log_l(k, count[w], 0.99) - log_l(k, count[w], points / n))
                if ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** -(count[w] - k) >= 0.3:
                    self.abbreviations.add(w)
        initial = lambda w: len(w) == 1 and w.isalpha()
        self.low, self.low_first, self.up, self.up_inside, after_break = (Counter() for _ in range(5))
        pairs = Counter()
        for d in docs:
            before, after = "start", None
            for kind, point, end, case in d:
                if before == ".." or (before == "." and (after in self.abbreviations or initial(after) or after == "#")):
                    place = "open"
                elif before in ("start", "!") or (before == "." and after not in self.abbreviations):
                    place = "first"
                else:
                    place = "inside"
                self.low[kind] += case == "lower"
                self.low_first[kind] += case == "lower" and place == "first"
                self.up[kind] += case == "upper"
                self.up_inside[kind] += case == "upper" and place == "inside"
                after_break[kind] += place == "first" and before != "start"
                if before == "." and place == "open" and kind[:1].isalpha():
                    pairs[after, kind] += 1
                before, after = end, kind if point else None
        breaks = sum(after_break.values())
        self.starters = {w for w, k in after_break.items() if k and w[:1].isalpha() and association(breaks, count[w], k, n) >= 30}
        self.collocations = {(a, b) for (a, b), k in pairs.items() if association(count[a], count[b], k, n) >= 7.88}

    def split(self, text):
        if text is None:
            return None
        pieces = re.findall(K.PIECE, text)
        out, now = [], ""
        tokens = [plain_token(p) for p in pieces]
        for i, (piece, (kind, _, end, _)) in enumerate(zip(pieces, tokens, strict=True)):
            now += piece
            if i + 1 == len(tokens) or self.ends(kind, end, tokens[i + 1]):
                out.append(now.strip())
                now = ""
        return [s for s in out if s]

    def ends(self, kind, end, following):
        if end == "!":
            return True
        if end not in (".", ".."):
            return False
        nxt, _, _, case = following
        short = end == "." and kind in self.abbreviations
        initial = len(kind) == 1 and kind.isalpha()
        if not (short or end == ".." or initial or kind == "#"):
            return True
        if (kind, nxt) in self.collocations:
            return False
        spelled = None
        if case == "upper" and self.low[nxt] and not self.up_inside[nxt]:
            spelled = True
        elif case == "lower" and (self.up[nxt] or not self.low_first[nxt]):
            spelled = False
        if (short or end == "..") and not initial:
            return spelled if spelled is not None else case == "upper" and nxt in self.starters
        if spelled is False or (spelled and initial):
            return spelled
        if initial and case == "upper" and not self.low[nxt]:
            return False
        return not short


WORDS = {
    "en": ("the old doctor saw a small house near river and went home with his friend while rain fell on every street", ["Dr.", "Mr.", "Mrs.", "e.g.", "Inc.", "vol.", "J.", "St."], ["Smith", "Jones", "London", "Baker"], "The He They But She".split()),
    "de": ("der alte mann sah ein kleines haus am fluss und ging nach hause mit seinem freund bei regen", ["Dr.", "z.B.", "Nr.", "Str.", "bzw.", "H.", "3.", "21."], ["Müller", "Oktober", "Berlin", "Äpfel"], "Der Sie Aber Dann Er".split()),
}


def written_texts(lang, n=200):
    rng = random.Random(lang)
    words, short, names, starts = WORDS[lang]
    words = words.split()
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 7)):
            s = [rng.choice(starts)]
            for _ in range(rng.randint(2, 12)):
                s.append(rng.choice(words))
                if rng.random() < 0.3:
                    s += [rng.choice(short), rng.choice(names + words[:3])]
                if rng.random() < 0.05:
                    s[-1] += rng.choice([",", " ...", ";", "...", " (etc.)", " 'so'"])
            s[-1] += rng.choice([".", ".", ".", "!", "?", '."', "...", " 1,500."])
            text.append(" ".join(s))
        out.append(rng.choice([" ", "\n", "  "]).join(text))
    return out


@pytest.mark.parametrize("lang", ["en", "de"])
def test_sentences_equal_a_plain_version(spark, lang):
    texts = written_texts(lang) + ["", " \n ", None, "word", "A.", "... and so on.", "Yes!No? \"Quite.\" he said."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, ends string").repartition(4)
    model = K.learned(df)
    got = {r.id: r.sentences for r in K.split_sentences(df, model, "id").collect()}
    plain = PlainPunkt(texts)
    assert plain.abbreviations >= {w.lower().rstrip(".") for w in WORDS[lang][1] if w[0] not in "JH0123456789"} and len(plain.abbreviations) < 12
    assert got == {i: plain.split(t) for i, t in enumerate(texts)}
    # a boundary rule that knows no abbreviations cuts far more
    assert sum(len(s) for s in got.values() if s) < 0.8 * sum(len(re.findall(r"[^.!?]+[.!?]*", t)) for t in texts if t)
    model.drop()


def test_languages_stay_apart(spark):
    texts = [(i, t, lang) for lang in WORDS for i, t in enumerate(written_texts(lang))]
    df = spark.createDataFrame(texts + [(0, "No language. Here.", None)], "id int, text string, lang string")
    out = defaultdict(dict)
    for r in K.split_sentences(df, K.learned(df, group="lang"), "id", group="lang").collect():
        out[r.lang][r.id] = r.sentences
    for lang in WORDS:
        mine = [t for _, t, g in texts if g == lang]
        plain = PlainPunkt(mine)
        assert out[lang] == {i: plain.split(t) for i, t in enumerate(mine)}
    assert out[None][0] == ["No language.", "Here."]


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "alpha beta. Gamma delta."), (1, "alpha beta. Gamma delta."), (1, "x"), (None, "y z! Q")], "id int, text string")
    model = K.learned(df)
    got = sorted(((r.id or 0), r.sentences) for r in K.split_sentences(df, model, "id").collect())
    assert got == [(0, ["y z!", "Q"]), (1, ["alpha beta.", "Gamma delta."]), (1, ["alpha beta.", "Gamma delta."]), (1, ["x"])]
    empty = df.limit(0)
    assert K.split_sentences(empty, K.learned(empty), "id").count() == 0
    assert K.types(K.contexts(empty)).where(F.col("abbreviation")).count() == 0


def test_annotations_of_learned_sentences(spark):
    from corpusloom.operators import annotate as A

    texts = [(i, t, "en") for i, t in enumerate(written_texts("en"))] + [(900, "He saw old Dr. Smith near the river. Then he went home.", "en")]
    df = spark.createDataFrame(texts, "id int, text string, lang string")
    cut = K.split_sentences(df, K.learned(df), "id").where("id = 900")
    rows = A.caption_annotations(cut, "id", "lang", "text", "sentences").collect()
    assert [(r.prompt[-18:], r.output) for r in rows] == [("<LANG_EN><CAPTION>", "He saw old Dr. Smith near the river."), ("<DETAILED_CAPTION>", texts[-1][1])]
    # the rule cuts after the title too, and so takes it for three sentences
    assert A.caption_annotations(cut, "id", "lang", "text").collect()[0].output == "He saw old Dr."


def test_texts_are_cut_once_a_pass_and_travel_whole(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(written_texts("en"))], "id int, text string, lang string").repartition(2)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    counted = plan(K.contexts(df, group="lang"))
    assert counted.count("regexp_extract_all(") == 1  # not in a filter once more
    # words are counted before their columns are made: that of the case stands above the aggregate
    assert 0 <= counted.index("AS case#") < counted.index("Aggregate [")
    model = K.learned(df, group="lang")
    cut = K.split_sentences(df, model, "id", group="lang")
    assert plan(cut).count("regexp_extract_all(") == 2  # to look for sentences that go on, and to cut
    joined = next(line for line in plan(cut).splitlines() if "Join LeftOuter" in line and "xxhash64" in line)
    above = plan(cut)[: plan(cut).index(joined)]
    assert above.count("regexp_extract_all(") == 1  # texts meet their marks whole
    model.drop()


def test_parts_end_where_a_sentence_can(spark):
    rng = random.Random(7)
    odd = [".", "!", "?", ",", ";", '"', "'", ")", "”", "«", "(", "a", "B", "é", "7", "-", " ", " ", "\n", "\t", "\x0b", "\xa0", "\u2028", "\x1c", "😀"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 60))) for _ in range(1500)] + ["", "  ", ".", " . ", "a.b.c", 'x." y', "... ?!", "1.2." * 20_000, "a" * 50_000 + ". B", ("w " * 5_000 + "end. ") * 2, "." + ")" * 5_000 + "x. Y", "." + " " * 5_000 + "Y", "e.g. " * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    got = {r.id: (r.p, r.l) for r in df.select("id", K.parts(F.col("text")).alias("p"), F.transform(K.parts(F.col("text")), lambda c: F.regexp_extract(c, K.LAST, 1)).alias("l")).collect()}
    for i, t in enumerate(texts):
        cut, last = got[i]
        assert "".join(cut) == t
        pieces, want, now = re.findall(K.PIECE, t), [], []
        for p in pieces:
            now.append(p)
            if plain_token(p)[2] in (".", "..", "!"):
                want.append(now)
                now = []
        want += [now] if now else []
        assert [c.lstrip(WS) for c in cut if c.strip(WS)] == ["".join(w) for w in want]
        assert [w for w in last if w] == [w[-1].rstrip(WS) for w in want]
    # and so do the sentences of such texts
    model, plain = K.learned(df), PlainPunkt(texts)
    edge = re.compile(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")
    for r in K.split_sentences(df, model, "id").collect():
        assert r.sentences == [s for s in (edge.sub("", s) for s in plain.split(texts[r.id])) if s]
    model.drop()
