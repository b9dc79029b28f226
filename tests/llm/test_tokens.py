import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P
from corpusloom.llm.token_files import EliasFano, Reader, token_binary, write_token_files
from corpusloom.llm.tokens import END_ID, Pieces, default_vocab

TEXTS = [
    (5, "The cat's here, isn't it? Yes!\nÉcole ÀÉ naïve; 3.14 (x)"),
    (1, None),
    (2, ""),
    (2, "repeated id"),
    (2, "repeated id"),
    (None, "no id"),
    (-7, "中文 text ﬁ ² कि <|endoftext|> <|ENDOFTEXT|> A\u0301b"),
    (9, "word " * 3000),
    (1 << 40, "x" * 5000),
]


@pytest.fixture(scope="module")
def cache():
    return Pieces(default_vocab())


def library(cache, text):
    return cache.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAZéÉßñÑİıŉ²½ªº١中ा\u0301\u0308 \t\n.,;:!?'’s\"()-_<|>ﬁ0", max_size=14))
def test_pieces_are_the_librarys(cache, text):
    assert np.frombuffer(cache.ids(text), "<u4").tolist() == library(cache, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**9) | st.integers(0, 2**64 - 1), max_size=300).map(sorted))
def test_elias_fano(values):
    e = EliasFano.encode(np.array(values, np.uint64))
    assert e.select(np.arange(len(values))).tolist() == values
    again = EliasFano.read(e.bytes(), *e.shape())
    assert again.select(np.arange(len(values))[::-1]).tolist() == values[::-1]


def test_elias_fano_is_small():
    e = EliasFano.encode(np.arange(0, 1_000_000, 100))
    assert e.nbytes * 8 / 10_000 < 2 + np.log2(100) + 0.2  # directory and all
    with pytest.raises(ValueError, match="decrease"):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        e.select(10_000)


def rows(spark, extra=True):
    schema = "doc_id long, text string" + (", start long, ids string, file string" if extra else "")
    return spark.createDataFrame([(*r, 1, "x", None) if extra else r for r in TEXTS], schema).repartition(3)


def test_token_files_round_trip(spark, cache, tmp_path):
    files = write_token_files(rows(spark), f"file://{tmp_path}/t").orderBy("no").collect()
    docs, at = [], 0
    assert [f.no for f in files] == list(range(len(files)))
    for _, name, n, tokens, start in files:
        assert start == at
        r = Reader(name)
        assert (r.n_docs, r.n_tokens) == (n, tokens)
        got = list(r)
        assert [r.ids(*r.bounds(i)).tolist() for i in range(n)] == [ids.tolist() for _, _, ids in got]
        docs += [(d, at + s, ids.tolist()) for d, s, ids in got]
        at += tokens
    ids = [d for d, _, _ in docs]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == len(TEXTS)
    want = sorted((str(d), [*library(cache, t), END_ID]) for d, t in TEXTS)
    assert sorted((str(d), x) for d, _, x in docs) == want
    assert not list(tmp_path.rglob("*.tmp"))


def test_token_query_columns(spark, cache):
    got = token_binary(rows(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id in (5, 9)}
    for d, t in TEXTS:
        if d in by:
            ids = [*library(cache, t), END_ID]
            assert by[d].n_tokens == len(ids) and by[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_select_over_many_super_blocks():
    rng = np.random.default_rng(4)
    values = np.cumsum(rng.integers(0, 900, 200_000)).astype(np.uint64)
    e = EliasFano.encode(values)
    e = EliasFano.read(e.bytes(), *e.shape())
    assert len(e.supers) > 3 and (e.select(np.arange(len(values))) == values).all()
    some = rng.integers(0, len(values), 500)
    assert (e.select(some) == values[some]).all()


def test_wide_ids_files_and_long_texts(spark, cache, tmp_path, monkeypatch):
    """The least and greatest doc_id of 64 bits in one file, documents longer than what is read at
    once, files closed at their bound, and one task a file."""
    import sys

    from pyspark import cloudpickle

    from corpusloom.llm import token_files as T

    cloudpickle.register_pickle_by_value(sys.modules["corpusloom.llm.token_files"])
    try:
        monkeypatch.setattr(T, "FILE_IDS", 5000)
        monkeypatch.setattr(T, "IDS_AT_ONCE", 1000)
        monkeypatch.setattr(T, "DOCS_AT_ONCE", 2)
        texts = {-(1 << 63): "least", (1 << 63) - 1: "greatest one", 0: "word " * 7000, 1: "a b c", 2: "", 3: "x y " * 3000, 4: None}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
        manifest = T.write_token_files(df, f"file://{tmp_path}/w")
        assert manifest.count() >= 3 and all(r.docs for r in manifest.collect())
        read = T.read_token_files(manifest)
        assert read.rdd.getNumPartitions() == manifest.count()
        got = {r.doc_id: r for r in read.collect()}
        at = 0
        for d in sorted(texts):
            ids = [*library(cache, texts[d]), END_ID]
            assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert len(got) == len(texts)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["corpusloom.llm.token_files"])


def test_one_file_with_the_widest_ids(tmp_path):
    from corpusloom.llm.token_files import Writer

    w = Writer(f"file://{tmp_path}/one.cltok", 2)
    ids = [None, None, -(1 << 63), -5, 0, (1 << 63) - 1]
    for k, d in enumerate(ids):
        w.add(d, np.arange(k + 1, dtype=np.uint32))
    w.close()
    assert [(d, s, len(x)) for d, s, x in Reader(f"file://{tmp_path}/one.cltok")] == [(d, k * (k + 1) // 2, k + 1) for k, d in enumerate(ids)]


def test_empty_table(spark):
    none = rows(spark).limit(0)
    assert token_binary(none).count() == 0 and P.pack_documents(none).count() == 0


def cost_of(cuts, places, cost, window, powers, power_cost):
    total, a = 0.0, 0
    known = dict(zip(places, cost, strict=True))
    for b in cuts:
        size = b - a
        assert 0 < size <= window
        pad = window - size
        if size in powers:
            pad = min(pad, power_cost)
        total += pad + known[b]
        a = b
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 2.0, 5.0])), min_size=1, max_size=40))
def test_cuts_are_the_cheapest(steps):
    places, cost, at = [], [], 0
    for s, c in steps:
        at += s
        places.append(at)
        cost.append(c)
    window, powers, power_cost = 16, (4, 8), 3.0
    got = P.best_cuts(places, cost, window, powers, power_cost)
    best = {0: 0.0}
    for j, (b, c) in enumerate(zip(places, cost, strict=True)):
        options = []
        for a in [0, *places[:j]]:
            size = b - a
            if size <= window:
                pad = window - size
                options.append(best[a] + (min(pad, power_cost) if size in powers else pad) + c)
        best[b] = min(options)
    assert cost_of(got, places, cost, window, powers, power_cost) == pytest.approx(best[places[-1]])


def test_packing(spark, cache):
    pieces = P.pack_documents(rows(spark)).collect()
    ids = {}
    for d, t in TEXTS:
        ids.setdefault(d, []).append([*library(cache, t), END_ID])
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for (d, n), ps in by_doc.items():
        same = [x for x in ids[d] if len(x) == n]
        covered = sorted((p.start, p.length) for p in ps)
        assert [s for s, _ in covered][:: len(same)][0] == 0 and sum(k for _, k in covered) == n * len(same)
        for p in ps:
            assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in same)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= P.WINDOW


def test_pieces_across_stretches():
    """With many short stretches, the last sequence of one starts the next: nothing is lost or padded early."""
    rng = np.random.default_rng(2)
    docs = [(d, rng.integers(2, 50, int(rng.integers(1, 900))).astype(np.uint32)) for d in range(120)]
    packer = P.Packer(np.array([7, 9], np.uint32), window=128, base=5, stretch=1000)
    pieces = [p for d, ids in docs for p in packer.add(d, ids)]
    before_end = len({p[5] for p in pieces})
    pieces += list(packer.flush())
    assert before_end > 50
    at = 0
    stream = np.concatenate([ids for _, ids in docs])
    sequences = {}
    for d, start, length, crc, total, sequence, offset in pieces:
        ids = docs[d][1]
        assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        assert (ids[start : start + length] == stream[at : at + length]).all()
        at += length
        assert sequences.get(sequence, 0) == offset
        sequences[sequence] = offset + length
    assert at == len(stream) and list(sequences) == list(range(5, 5 + len(sequences))) and max(sequences.values()) <= 128
    whole = P.best_cuts(*P.cut_places(np.cumsum([len(x) for _, x in docs]), np.flatnonzero(np.isin(stream, [7, 9])) + 1, len(stream), 128), 128)
    assert len(sequences) <= 1.05 * len(whole)


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    sizes = [r.n for r in P.pack_documents(docs).groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else P.WINDOW - n for n in sizes)
    assert padding < 0.03 * sum(sizes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from("ds")), min_size=1, max_size=40))
def test_no_filler_where_a_boundary_lies_within_the_window(steps):
    window, at = 16, 0
    ends, sentences = [], []
    for s, kind in steps:
        at += s
        (ends if kind == "d" else sentences).append(at)
    ends = sorted({*ends, at})
    places, cost = P.cut_places(np.array(ends), np.array(sentences, int), at, window)
    known = [0, *sorted({*ends, *sentences})]
    assert set(known[1:]) <= set(places) and places == sorted(set(places))
    assert all(b - a <= window for a, b in zip([0, *places], places, strict=False))
    for p, c in zip(places, cost, strict=True):
        if p not in known:
            before = max(x for x in known if x < p)
            assert c == P.FILLER_COST and not any(before < x <= before + window for x in known)
