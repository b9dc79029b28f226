"""METEOR with exact and stem matches, aligned with the fewest chunks.

Among the alignments of two texts, one to one, those with the most exact matches and then the most stem
matches count; how many these are follows from the counts of words and stems alone. Of these alignments the
one with the fewest chunks (runs that stand in the same order in both texts) is searched by branch and bound.
That search is hard in general: it ends where no alignment can have fewer chunks, as the pairs of neighbours that both
texts have tell, and after NODES steps beyond the first alignment the best one found stands.
Synonyms and paraphrases need tables that aren't here.

Tokens and stems are made in the JVM. A row's alignment needs nothing but the row; as it takes long for a row of few
bytes, rows are dealt out to all cores first.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import tokens

#: Steps of a search after its first alignment.
NODES = 20_000
#: Words that are looked at for the longest run, to try the most promising place first.
AHEAD = 8
#: Words of texts whose search remembers what it has reached: a bit each for every step.
SHORT = 4096
#: Tasks a core that rows are dealt out to.
TASKS = 2

#: Endings by language, the longest that leaves three letters is cut off; other languages have none.
ENDINGS = {
    "en": "ational|ization|iveness|fulness|ousness|ations?|ments?|ness|ingly|edly|ings?|ions?|ers?|ed|ly|es|s|e",
    "de": "ungen|heiten|keiten|ung|heit|keit|ische[nrsm]?|isch|liche[nrsm]?|lich|ern|em|en|er|es|e|s|n",
    "fr": "issements?|ements?|ations?|atrices?|euses?|eurs?|ives?|ifs?|ités?|ées?|és?|er|ez|ent|es|e|s|x",
    "es": "amientos?|imientos?|aciones|ación|adoras?|adores?|mente|idades|idad|ando|iendo|ados?|adas?|idos?|idas?|ar|er|ir|os|as|es|o|a|e|s",
}


def stem(word: Column, lang: str) -> Column:
    """A lower-case word without its ending."""
    return F.regexp_replace(word, f"^(.{{3,}}?)(?:{ENDINGS[lang]})$", "$1") if lang in ENDINGS else word


def aligned(h: list[str], r: list[str], h_stems: list[str], r_stems: list[str], nodes: int = NODES) -> tuple[int, int, int]:
    """Exact matches, stem matches and chunks of the best alignment of two token lists."""
    words_h, words_r = Counter(h), Counter(r)
    need = {w: min(n, words_r[w]) for w, n in words_h.items() if w in words_r}  # exact matches of a word still to come
    stems_h, stems_r = Counter(h_stems), Counter(r_stems)
    more = {s: min(n, stems_r[s]) for s, n in stems_h.items() if s in stems_r}  # stem matches likewise
    of = dict(zip(h, h_stems, strict=True)) | dict(zip(r, r_stems, strict=True))
    for w, n in need.items():
        more[of[w]] -= n
    exact, by_stem = sum(need.values()), sum(more.values())
    at = [i for i, s in enumerate(h_stems) if s in more and (h[i] in need or more[s])]
    if not exact + by_stem:
        return 0, 0, 0
    places = defaultdict(list)
    for j, s in enumerate(r_stems):
        if s in more:
            places[s].append(j)
    left_h, left_r = Counter(h[i] for i in at), Counter(w for w, s in zip(r, r_stems, strict=True) if s in more)
    # of a stem: words left on this side, and what they have still to match
    class_h, class_need = Counter(h_stems[i] for i in at), defaultdict(int)
    for w, n in need.items():
        class_need[of[w]] += n
    used: set[int] = set()
    taken_bits, short = 0, len(r) <= SHORT  # the same as bits
    n, matches = len(at), exact + by_stem

    # A chunk is saved where neighbours of one text stand on neighbours of the other. From the k-th matchable word on
    # a pair of stems can do so as often as it stands there, and in r, at most.
    pairs_r = Counter((a, b) for a, b in zip(r_stems, r_stems[1:], strict=False) if a in more and b in more)
    saved = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        saved[k] = saved[k + 1]
        if k and at[k] == at[k - 1] + 1:
            pair = h_stems[at[k - 1]], h_stems[at[k]]
            if pairs_r[pair] > 0:
                pairs_r[pair] -= 1
                saved[k] += 1

    def run(i: int, j: int) -> int:
        k = 0
        while k < AHEAD and i + k < len(h) and j + k < len(r) and h[i + k] == r[j + k] and j + k not in used:
            k += 1
        return k

    def options(k: int, before: int) -> list[int]:
        """Where the k-th matchable word may go, -1: nowhere; most promising first."""
        i = at[k]
        w, s = h[i], h_stems[i]
        needed, other = need.get(w, 0), more[s]
        rest = left_h[w] - 1
        loose = other > 0 and rest >= needed
        out = []
        for j in places[s]:
            if j in used:
                continue
            v = r[j]
            if needed > 0 if v == w else loose and left_r[v] > need.get(v, 0):
                out.append(j)
        follows = before + 1 if k and at[k - 1] == i - 1 and before >= 0 else None
        if follows in out:
            out.remove(follows)
            out.insert(0, follows)
        elif len(out) > 1:
            out.sort(key=lambda j: -run(i, j))
        if rest >= needed and class_h[s] - 1 >= class_need[s] + other:
            out.append(-1)
        return out

    def take(k: int, j: int, sign: int) -> None:
        nonlocal taken_bits
        w, s = h[at[k]], h_stems[at[k]]
        left_h[w] -= sign
        class_h[s] -= sign
        if j < 0:
            return
        left_r[r[j]] -= sign
        if r[j] == w:
            need[w] -= sign
            class_need[s] -= sign
        else:
            more[s] -= sign
        (used.add if sign > 0 else used.discard)(j)
        if short:
            taken_bits ^= 1 << j

    best, spent, least = n + 1, 0, matches - saved[0]
    opened = [options(0, -1)]  # choices left at each depth, the next one last
    opened[0].reverse()
    taken: list[int] = []
    chunks = [0]
    reached: dict[tuple, int] = {}
    while opened and best > least:
        k = len(opened) - 1
        if len(taken) > k:  # back from below
            take(k, taken.pop(), -1)
            chunks.pop()
        if not opened[k] or (best <= n and spent > n + nodes):
            opened.pop()
            continue
        j = opened[k].pop()
        spent += 1
        before = taken[k - 1] if k else -1
        goes_on = j >= 0 and k > 0 and before >= 0 and j == before + 1 and at[k - 1] == at[k] - 1
        c = chunks[k] + (j >= 0 and not goes_on)
        # all that are still to match begin chunks, but for those that can be saved
        if c + max(0, matches - len(used) - (j >= 0) - saved[k + 1]) >= best:
            continue
        if k + 1 == n:
            best = c
            continue
        take(k, j, 1)
        state = (k, j, taken_bits)
        if short and reached.get(state, best) <= c:
            take(k, j, -1)
            continue
        if short:
            reached[state] = c
        taken.append(j)
        chunks.append(c)
        opened.append(options(k + 1, j)[::-1])
    return exact, by_stem, best


def score(exact: int, stems: int, chunks: int, h: int, r: int, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, stem_weight: float = 1.0) -> float:
    """Weighted harmonic mean of precision and recall, less the penalty for chunks."""
    m = exact + stem_weight * stems
    if not m:
        return 0.0
    p, q = m / h, m / r
    return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks / (exact + stems)) ** beta)


FOUND = "meteor double, exact long, stems long, chunks long, prediction_length long, reference_length long"


def meteor(df: DataFrame, lang: str = "en", tokenizer: Callable[[Column], Column] = tokens, nodes: int = NODES, **weights: float) -> DataFrame:
    """id and FOUND of the best reference for each row (id, prediction, references); the first of several as good.

    Null predictions and references are empty; rows without references score 0. weights are those of score.
    """
    hyp = F.coalesce(tokenizer(F.col("prediction")), F.array().cast("array<string>"))
    refs = F.transform(F.filter(F.coalesce("references", F.array().cast("array<string>")), lambda x: x.isNotNull()), tokenizer)
    rows = df.select("id", hyp.alias("h"), refs.alias("r"))
    rows = rows.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)
    stems = lambda t: F.transform(t, lambda w: stem(w, lang))
    rows = rows.select("id", "h", stems(F.col("h")).alias("hs"), "r", F.transform("r", stems).alias("rs"))
    names = ["id", *(c.split()[0] for c in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, hs, rs, rss in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                best = (0.0, 0, 0, 0, len(h), len(rs[0]) if rs else 0)
                for r, s in zip(rs, rss, strict=True):
                    found = aligned(h, r, hs, s, nodes)
                    now = (score(*found, len(h), len(r), **weights), *found, len(h), len(r))
                    if now[0] > best[0]:
                        best = now
                out.append(best)
            kinds = [pa.float64(), *[pa.int64()] * 5]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return rows.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {FOUND}")
