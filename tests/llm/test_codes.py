import math

import numpy as np
import pytest

from corpusloom.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string"


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, label, code, error, label_error) and the codebooks, by loops over whole numbers."""
    good = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sized = [g for g in good if g[0] is not None and g[1] and len(g[1]) % parts == 0]
    if not sized:
        return [(i, lab, None, None, None) for i, _, lab in good], [[] for _ in range(parts)]
    length = len(min(sized, key=lambda g: (g[0], len(g[1])))[1])
    size = length // parts
    first = {}
    for i, v, _ in sorted((g for g in sized if len(g[1]) == length), key=lambda g: (g[0], g[1])):
        first.setdefault(i, v)
    books = [[first[i][p * size : (p + 1) * size] for i in sorted(first)[:entries]] for p in range(parts)]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] if len(v) == length else None for _, v, _ in good]

    def assign():
        best = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), k) for k, e in enumerate(b))
        return [None if c is None else [best(c[p], books[p]) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g and g[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, lab, None if g is None else "".join(f"{k:02x}" for _, k in g), None if g is None else sum(d for d, _ in g)) for (i, _, lab), g in zip(good, assign(), strict=True)]
    total = {lab: [o[3] for o in out if o[1] == lab and o[3] is not None] for lab in {o[1] for o in out}}
    return [(*o, sum(total[o[1]]) if total[o[1]] else None) for o in out], books


@pytest.mark.parametrize("n, d, spread", [(256, 16, 500), (256, 16, 3), (7, 2, 4), (1, 5, 9), (40, 0, 1)])
def test_va_file_finds_the_first_nearest(n, d, spread):
    rng = np.random.default_rng(n + d)
    entries, x = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (300, d))
    f = C.VaFile(entries)
    entry, distance, seen = f.nearest(x)
    plain = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    lower, upper = f.bounds(x)
    assert (lower.T <= plain).all() and (plain <= upper.T).all()
    assert seen <= plain.size


def test_va_file_keeps_most_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-500, 500, (256, 16))
    _, _, seen = C.VaFile(entries).nearest(entries[rng.integers(0, 256, 2000)] + rng.integers(-60, 60, (2000, 16)))
    assert seen < 0.05 * 256 * 2000


def compared(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = C.compress_vectors(df, **how).collect()
    want, books = plain_codes(rows, **how)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    return got, books


def test_codes_against_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(0, 1, 8) / 3).tolist(), [None, 0, 1][i % 3]) for i in rng.permutation(600)]
    got, books = compared(spark, rows, entries=32)
    assert {r.codebooks_sha256 for r in got} == {C.digest([np.array(b) for b in books])}


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda: rng.normal(0, 1, 8).tolist()
    same = v()
    rows = [(i, same, 1) for i in range(5, 40)] + [(5, v(), None), (5, v(), 2), (None, v(), 1), (1, None, 1), (2, [float("nan")] * 8, 1), (3, [float("inf")] * 8, 1), (4, [None] * 8, 1), (0, [1.0] * 6, 9), (99, [], 9), (50, [0.0] * 8, None), (51, [-1e-9] * 8, 3)]
    compared(spark, rows, entries=16)


def test_codes_without_usable_rows(spark):
    compared(spark, [])
    compared(spark, [(1, None, 1), (2, [0.5] * 3, 1), (None, [0.5] * 4, 1)])


def test_components_beyond_the_bound(spark):
    rows = [(i, [1e300 * (-1) ** i] * 4 + [float(i)] * 4, 1) for i in range(6)]
    got = C.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 6 and all(r.error == 0 for r in got)
