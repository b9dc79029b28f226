import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import meteor as M


def exhaustive(h, r, hs, rs):
    """The most exact, then the most stem matches, then the fewest chunks, over all one-to-one alignments."""
    best = None

    def go(i, used, pairs):
        nonlocal best
        if i == len(h):
            exact = sum(h[a] == r[b] for a, b in pairs)
            chunks = sum(1 for k, (a, b) in enumerate(pairs) if not k or pairs[k - 1] != (a - 1, b - 1))
            key = (-exact, -(len(pairs) - exact), chunks)
            best = key if best is None else min(best, key)
            return
        go(i + 1, used, pairs)
        for j in range(len(r)):
            if j not in used and hs[i] == rs[j]:
                go(i + 1, used | {j}, [*pairs, (i, j)])

    go(0, frozenset(), [])
    return -best[0], -best[1], best[2]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    words = ["run", "runs", "running", "cat", "cats", "the", "a"][: 3 + seed % 5]
    stems = {"runs": "run", "running": "run", "cats": "cat"}
    for _ in range(60):
        h, r = ([rng.choice(words) for _ in range(rng.randint(0, 7))] for _ in range(2))
        hs, rs = ([stems.get(w, w) for w in x] for x in (h, r))
        assert M.aligned(h, r, hs, rs) == exhaustive(h, r, hs, rs), (h, r)


def plain_kth(h, r):
    """Chunks if the k-th occurrence of a word goes to the k-th."""
    seen, at = {}, {}
    for j, w in enumerate(r):
        at.setdefault(w, []).append(j)
    pairs = []
    for i, w in enumerate(h):
        k = seen.get(w, 0)
        seen[w] = k + 1
        if k < len(at.get(w, [])):
            pairs.append((i, at[w][k]))
    return sum(1 for k, (a, b) in enumerate(pairs) if not k or pairs[k - 1] != (a - 1, b - 1))


def test_long_texts_end_and_are_no_worse_than_in_order():
    rng = random.Random(9)
    better = 0
    for _ in range(10):
        h = [rng.choice("abcdefghijkl") for _ in range(120)]
        r = h[60:] + h[:60]
        exact, stems, chunks = M.aligned(h, r, h, r, nodes=2000)
        assert (exact, stems) == (120, 0) and chunks <= plain_kth(h, r)
        better += chunks < plain_kth(h, r)
    assert better == 10
    text = ["the"] * 3000
    assert M.aligned(text, text, text, text, nodes=100) == (3000, 0, 1)


def test_stems(spark):
    got = lambda w, lang: spark.range(1).select(M.stem(F.lit(w), lang)).first()[0]
    assert [got(w, "en") for w in ("running", "cats", "is", "nationalization", "movements")] == ["runn", "cat", "is", "national", "move"]
    assert got("häuser", "de") == "häus" and got("rapidement", "fr") == "rapid" and got("corriendo", "es") == "corr" and got("kočky", "cz") == "kočky"


def test_scores(spark):
    rows = [("a", "the cat sat", ["x", "the cat sat"]), ("b", "cats sat", ["the cat sat"]), ("c", "q", ["z"]), ("d", "", ["z"]), ("e", None, ["z"]), ("f", "x", []), ("g", "x", None), ("h", "x", [None, "x"])]
    got = {r.id: r for r in M.meteor(spark.createDataFrame(rows, "id string, prediction string, references array<string>")).collect()}
    assert got["a"].meteor == pytest.approx(1 - 0.5 / 27) and got["a"].chunks == 1
    p, r = 2 / 2, 2 / 3
    assert got["b"].meteor == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 / 8)) and (got["b"].exact, got["b"].stems) == (1, 1)
    assert all(got[k].meteor == 0 for k in "cdefg") and got["h"].exact == 1
    assert M.meteor(spark.createDataFrame(rows, "id string, prediction string, references array<string>").limit(0)).count() == 0


def test_the_search_ends_where_no_alignment_can_be_better():
    # twenty words, each at five places, whose neighbours never meet in the other's order: without the bound
    # the search would go through all ways to place them
    h = [f"w{i}" for i in range(20)]
    r = h[::-1] * 5
    assert M.aligned(h, r, h, r, nodes=1 << 60) == (20, 0, 20)
    # one pair can meet, and does
    r = [*r, "w3", "w4"]
    assert M.aligned(h, r, h, r, nodes=1 << 60) == (20, 0, 19)
