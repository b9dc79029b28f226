from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import embedding_dedup as E
from corpusloom.llm import minhash as M
from corpusloom.llm import nearest as N
from corpusloom.llm.common import components
from corpusloom.llm.hnsw import Hnsw, unit


def plain_components(nodes, links):
    low = {n: n for n in nodes}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    links = {"chain": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 60)] + [(100, 101)], "random": [tuple(map(int, rng.integers(0, 150, 2))) for _ in range(90)], "none": []}[shape]
    nodes = {x for ab in links if ab[0] != ab[1] for x in ab}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components(nodes, [x for x in links if x[0] != x[1]])
    assert {n: got.get(n, n) for n in nodes} == want


def plain_set(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_duplicates(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    links = [(a, b) for (a, p), (b, q) in combinations([s for s in sets if s[0] is not None], 2) if p and q and a != b and 100 * len(p & q) >= 75 * len(p | q)]
    low = plain_components([d for d, _ in sets if d is not None], links)
    return sorted((str(d), len(s), str(low.get(d)), d is None or low[d] == d) for d, s in sets)


def near(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, s0 int")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.near_duplicates(df, **how).collect())


def copies(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(words)] = f"e{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A B\u00a0x"), (6, "a  b\nC"), (7, "one two three four five"), (8, "One two three four five"), (None, "a b c"), (9, "a b c d"), (10, "É a"), (11, "é a"), (12, "w " * 30_000)]
    assert near(spark, rows) == plain_duplicates(rows)


def test_near_duplicates_against_all_pairs(spark):
    texts = [t for k in range(6) for t in copies(k, 12, 40 + 30 * k, 1 + 2 * k)]
    texts += texts[:10] + [" ".join(t.split()[:25]) + " " + " ".join(u.split()[:25]) for t, u in zip(texts[:20], texts[30:50], strict=True)]
    rows = [(i * 3 % len(texts) if len(texts) % 3 else i, t) for i, t in enumerate(texts)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert near(spark, rows) == plain_duplicates(rows)


def underestimated(n):
    """Pairs of short texts of similarity 0.75 exactly whose estimates fall under the margin."""
    rng, out = np.random.default_rng(12), []
    while len(out) < n:
        words = [f"w{rng.integers(1 << 30)}" for _ in range(8)]
        p, q = " ".join(words[:7]), " ".join(words)
        x, y = (M.packed(M.minima(M.shingle_set(t))).view(np.uint64) for t in (p, q))
        z = x ^ y
        differ = np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
        if (1 - differ / M.PERMUTATIONS - 0.25) / 0.75 < M.SIMILARITY - M.MARGIN:
            out.append((p, q))
    return out


def test_small_sets_are_confirmed_whatever_the_estimate(spark):
    pairs = underestimated(12)
    rows = list(enumerate(t for pair in pairs for t in pair))
    got = near(spark, rows)
    assert got == plain_duplicates(rows)
    assert len({r[2] for r in got}) == len(pairs)


def test_small_sets_of_a_bucket_are_joined_whatever_the_estimate(spark):
    rows = []
    for i, pair in enumerate(underestimated(3)):
        for j, t in enumerate(pair):
            s = M.shingle_set(t)
            rows.append((i, 2 * i + j, 2 * i + j, len(s), *M.packed(M.minima(s)).tolist()))
    df = spark.createDataFrame(rows, "key long, component long, rep long, n_shingles long, " + ", ".join(f"s{i} long" for i in range(M.WORDS)))
    assert {frozenset((r.a, r.b)) for r in M._bucket_edges(df, M.SIMILARITY).collect()} == {frozenset((2 * i, 2 * i + 1)) for i in range(3)}


def test_bands_use_all_whole_rows_of_minima():
    low = M.minima(M.shingle_set("a b c d e f g h"))
    keys = M.band_keys(low)
    assert len(keys) == M.PERMUTATIONS // M.ROWS
    for i in range(len(keys) * M.ROWS):
        other = low.copy()
        other[i] += np.uint32(1)
        assert np.flatnonzero(M.band_keys(other) != keys).tolist() == [i // M.ROWS]
    assert (1 - M.SIMILARITY**M.ROWS) ** len(keys) < 2e-6


def test_chain_of_edits_is_one_component(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(14):
        words[i * 8] = f"x{i}"
        rows.append((100 - i, " ".join(words)))
    got = near(spark, rows)
    assert got == plain_duplicates(rows)
    assert len({r[2] for r in got}) == 1


@pytest.mark.parametrize("meeting", [2, 3, 7])
def test_meetings_of_many_blocks(spark, meeting):
    """Buckets and clusters of several blocks give what one block does: chains and stars of edits
    around common text, and others that share a passage only."""
    rng = np.random.default_rng(meeting)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(4):
        base = [f"g{g}{w}" for w in words]
        for i in range(12):
            t = list(base)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(0, 60))] = f"e{i}"
            rows.append((len(rows), " ".join(t)))
        rows.append((len(rows), " ".join(base[:40] + [f"z{g}{i}" for i in range(25)])))
    assert near(spark, rows, meeting=meeting) == plain_duplicates(rows)


def test_blocks_of_a_bucket_meet(spark):
    """A bucket over the bound, members of many components: the same components are joined."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        t = list(base) if i < 60 else [f"v{k}" for k in range(300)]
        for _ in range(3):
            t[int(rng.integers(0, 300))] = f"e{i}"
        s = M.shingle_set(" ".join(t))
        rows.append((1, i // 10 if i < 30 else i, i, len(s), *M.packed(M.minima(s)).tolist()))
    df = spark.createDataFrame(rows, "key long, component long, rep long, n_shingles long, " + ", ".join(f"s{i} long" for i in range(M.WORDS))).repartition(4)
    whole, split = ([(r.a, r.b) for r in M._bucket_edges(df, M.SIMILARITY, m).collect()] for m in (1000, 8))
    names = {r[1] for r in rows}
    assert plain_components(names, whole) == plain_components(names, split)
    assert len(set(plain_components(names, split).values())) == 2


def test_no_documents(spark):
    assert near(spark, []) == []


def test_matrix_of_similar_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = M.similar_pairs(sets, sets, 75)
    for i, p in enumerate(sets):
        for j, q in enumerate(sets):
            k = len(np.intersect1d(p, q))
            assert got[i, j] == (100 * k >= 75 * (len(p) + len(q) - k))


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    p, q = np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    a, b = M.packed(M.minima(np.unique(p))), M.packed(M.minima(np.unique(q)))
    lit = lambda v: [F.lit(int(x)) for x in v]
    assert spark.range(1).select(M.estimate(lit(a), lit(b)).alias("e")).first().e == pytest.approx(0.75, abs=M.MARGIN)
    assert spark.range(1).select(M.estimate(lit(a), lit(a)).alias("e")).first().e == 1


def clustered(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for g in range(groups):
        at = rng.choice(n, 12, replace=False)
        x[at] = x[at[0]] + spread * rng.standard_normal((12, dim))
    return x.astype(np.float32)


def test_hnsw_finds_near_vectors():
    x = unit(clustered(1, 3000, 24, 40, 0.05).astype(float))
    g = Hnsw.build(x)
    g = Hnsw.load(g.dump(), x)
    found = g.search(x, 32)
    true = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(true.tolist(), found.tolist(), strict=True)]) > 0.7
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in found)


BAD = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]


@pytest.mark.parametrize("shard", [10_000, 60])
def test_embedding_dedup_against_all_pairs(spark, shard):
    x = clustered(2, 300, 8, 10, 0.12)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies
    rows += [(2000 + i, v, 0) for i, v in enumerate(BAD)] + [(3000, rows[0][1], None), (None, rows[0][1], 0), (3001, [1.0, 2.0], 0), (3002, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(df, shard=shard).collect()}
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if i is not None and k is not None and i < 2000 or i in (3001, 3002)]
    links = [(a, b) for (a, p, k), (b, q, m) in combinations(good, 2) if k == m and len(p) == len(q) and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93]
    low = plain_components([r[0] for r in rows if r[0] is not None], links)
    for i, *_ in rows:
        n = sum(i in ab for ab in links)
        assert got[i] == (n, low.get(i), i is None or low[i] == i), i
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [40, 100, 3000])
def test_graph_is_asked_first(n):
    """Whatever a shard's size, links come from a beam; a scan follows a failed audit only."""
    x = unit(clustered(3, n, 16, max(2, n // 60), 0.08).astype(float))
    g = Hnsw.build(x)
    group, links, audit = E.within(g, x, np.ones(n, np.int64), 0.93)
    assert audit.beam > 0 and audit.recall >= 0.99
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert (links == near.sum(1)).all() and links.sum() > 0
    half = n // 2
    one, two = ({"x": y, "copies": np.ones(len(y), np.int64), "group": E.within(Hnsw.build(y), y, np.ones(len(y), np.int64), 0.93)[0]} for y in (x[:half], x[half:]))
    pairs, a, b, audit = E.between(Hnsw.build(two["x"]), one, two, 0.93)
    assert audit.beam > 0 and audit.recall >= 0.99
    assert (a == near[:half, half:].sum(1)).all() and (b == near[half:, :half].sum(1)).all() and len(pairs)


def test_beams_widen_until_the_audit_passes():
    """A first beam that finds nothing is followed by wider ones, then by a scan."""

    class Blind(Hnsw):
        asked: list = []

        def search(self, q, beam):
            self.asked.append(beam)
            return super().search(q, beam) if beam >= 128 else np.full((len(q), 1), -1)

    x = unit(clustered(5, 2000, 16, 30, 0.08).astype(float))
    g = Hnsw.build(x)
    g.__class__ = Blind
    _, links, audit = E.within(g, x, np.ones(len(x), np.int64), 0.93)
    assert Blind.asked == [32, 64, 128] and audit.beam == 128 and audit.recall < 0.1
    assert (links == (x @ x.T >= 0.93).sum(1) - 1).all()


@pytest.mark.parametrize("shard", [16384, 1500])
def test_thousands_of_vectors_against_all_pairs(spark, shard):
    x = clustered(6, 5000, 24, 120, 0.08)
    df = spark.createDataFrame([(i, v.tolist(), i % 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicate_vectors(df, shard=shard).collect()}
    u = unit(x.astype(float))
    a, b = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    low = E.groups(len(x), a, b)
    n = np.bincount(np.concatenate([a, b]), minlength=len(x))
    assert n.sum() > 1000 and got == {i: (int(n[i]), int(low[i])) for i in range(len(x))}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicate_vectors(none).count() == 0
    assert N.nearest_vectors(none, none).count() == 0


def test_chi_square():
    assert N.chi_square(N.chi_square_inverse(0.9, 12), 12) == pytest.approx(0.9)
    assert N.chi_square_inverse(0.95, 2) == pytest.approx(5.991, abs=1e-3)


@pytest.mark.parametrize("shard", [10_000, 500])
def test_nearest_against_all_pairs(spark, shard):
    x = clustered(4, 2000, 32, 30, 0.3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(6000 + i, v) for i, v in enumerate(BAD)] + [(None, rows[1][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in N.nearest_vectors(df, df.where("vec_id % 50 = 0"), shard=shard, block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in rows[:2009]])
    u = unit(np.array([r[1] for r in rows[:2009]], np.float32).astype(float))
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        cos = u @ u[np.flatnonzero(ids == q)[0]]
        for _, v, s in found:
            assert s == pytest.approx(cos[np.flatnonzero(ids == v)[0]], abs=1e-12) and v != q
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
        true = [int(ids[i]) for i in np.lexsort((ids, -cos.round(12))) if ids[i] != q][:5]
        hits += len(set(true) & {v for _, v, _ in found})
        total += 5
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    assert hits / total >= 0.95
    assert [v for _, v, _ in got[50]] == [5000, 5001, 5002, 5003, 5004]


def nearest(spark, x, shard=10_000, ids=None):
    ids = range(len(x)) if ids is None else ids
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest_vectors(df, df.where("vec_id % 50 = 0"), shard=shard).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score, r.verified))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("shard", [10_000, 64])
def test_ties_of_distinct_vectors(spark, shard):
    """Copies scaled by powers of two have equal cosines and are distinct vectors."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 16))
    x[1:41] = x[0] * 2.0 ** rng.permutation(np.arange(-20, 20))[:, None]
    x[100:130] = x[50] * 2.0 ** np.arange(1, 31)[:, None]
    got = nearest(spark, x, shard)
    assert [v for _, v, _, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _, _ in got[50]] == [100, 101, 102, 103, 104]
    # further off, too: forty vectors of one direction are the nearest of a query that isn't among them
    y = np.vstack([x[:41], rng.standard_normal((60, 16))])
    y[0] = x[0] + 0.05 * rng.standard_normal(16)
    assert [v for _, v, _, _ in nearest(spark, y, shard)[0]] == [1, 2, 3, 4, 5]


def test_cosines_are_the_same_bits_anywhere():
    from corpusloom.llm.vectors import cosines

    rng = np.random.default_rng(12)
    for d in (1, 3, 8, 64, 129, 1000):
        a, b = rng.standard_normal((37, d)), rng.standard_normal((37, d))
        whole = cosines(a, b)
        assert all(cosines(a[i : i + 1], b[i : i + 1])[0] == whole[i] for i in range(37))
        assert (cosines(np.broadcast_to(a[0], a.shape), b) == [cosines(a[:1], b[i : i + 1])[0] for i in range(37)]).all()


def test_clustered_vectors_are_searched_in_part(spark):
    """On clusters the test stops early: whole cells and most leaves are skipped, and recall holds."""
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((100, 32))
    x = np.repeat(centres, 60, 0) + 0.08 * rng.standard_normal((6000, 32))
    got = nearest(spark, x, 512)
    u = unit(x)
    hits = sum(len({v for _, v, _, _ in found} & set(np.argsort(-(u @ u[q]), kind="stable")[1:6].tolist())) for q, found in got.items())
    assert len(got) == 120 and hits / 600 >= 0.9
    assert np.mean([found[0][3] for found in got.values()]) < 0.5 * 6000


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in N.nearest_vectors(df, df).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]


def test_search_stops_early_on_the_table(spark):
    """Vectors without much structure: the test holds before all rows are verified, and recall stays."""
    from ..conftest import DATA

    rows = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    got = N.nearest_vectors(rows, rows.where("vec_id % 50 = 0")).collect()
    held = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(held))
    x = unit(np.array([held[i] for i in ids.tolist()]))
    found, verified = {}, {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.verified
    hits = 0
    for q in found:
        s = x @ unit(held[q][None])[0]
        s[ids == q] = -2
        hits += len(found[q] & set(ids[np.argsort(-s)[: N.NEIGHBOURS]].tolist()))
    assert len(found) == 40 and hits >= 0.9 * N.NEIGHBOURS * len(found)
    assert np.mean(list(verified.values())) < 0.6 * len(ids)
