"""b-bit MinHash near-duplicate detection with exact confirmation.

1. Each document's set of five-word shingles (64-bit hashes) gives 256 minima. 51 bands of five
   minima are hashed to candidate keys; of every minimum the two low bits are kept and packed
   into eight longs.
2. Documents with equal sets are one class; only its representative (smallest doc_id) goes on.
3. Not all pairs of a key's bucket are made: each member proposes one partner, the smallest member
   of the bucket's largest component so far, from the buckets that agree most. Pairs whose
   sizes allow the threshold and whose similarity, estimated from bit counts of the packed
   signatures and corrected for chance collisions, isn't clearly under it are confirmed on the
   full sets. Where a set is small (SMALL) the estimate is too wide and isn't asked. Two such
   rounds join nearly all that belongs together.
4. So that no link is lost to step 3, components that then still share buckets, and that sizes
   and estimates (of small sets sizes alone) connect, form clusters; each cluster's texts meet in
   blocks and full sets are compared across components by matrix products. Pairs are never rows.
   Members of a bucket, too, meet in blocks of a bounded number (see _meetings): those of its
   largest component with the others, and the others with each other.
5. Components of the confirmed links.

At similarity 0.75 a pair shares no band with probability (1 - 0.75^5)^51 = 10^-6 (at 0.8,
10^-9). From SMALL shingles on its estimate falls under MARGIN with about 10^-5 (simulated: none of
15,000 pairs of 64 and 100 shingles; without the exception for small sets it was 1.6 % of pairs with
3 of 4 shingles in common, 0.2 % with 6 of 8, 0.07 % with 9 of 12).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, lean, written

SHINGLE = 5
PERMUTATIONS, BANDS, ROWS = 256, 51, 5
BITS = 2
WORDS = PERMUTATIONS * BITS // 64
#: Estimates of sets that aren't small have a standard deviation of 0.033 at similarity 0.75.
MARGIN = 0.15
#: Below so many shingles the low bits of minima depend on each other (0.09 at 4 shingles).
SMALL = 64
#: Rounds of proposals before the rest is compared in blocks of so many documents and, of texts,
#: about so many shingles (a longer text is a block of its own).
ROUNDS = 2
MEETING, MEETING_SHINGLES = 512, 1 << 20
SHINGLES_AT_ONCE = 4096
SIMILARITY = 0.75

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the k-word shingles; with fewer words, of all words as one."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : n - k + 1 + i]
    return np.unique(_mix(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, (_A * h[None, i : i + 1024] + _B).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    m = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for i in range(ROWS):
        key = _mix(key + m[:, i])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    lanes = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(WORDS, -1)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed signatures: the share of equal lanes, corrected for those equal by chance."""
    differ = None
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        n = F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return (1 - differ / F.lit(PERMUTATIONS) - chance) / (1 - chance)


SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c1 and c2 (128-bit hash of the set), bands and packed signature of docs (doc_id, text)."""
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in lean(batches):
            n, cs, bands, sigs = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                low = minima(s)
                n.append(len(s))
                cs.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64))
                bands.append(band_keys(low) if len(s) else low[:0].astype(np.int64))
                sigs.append(packed(low))
            if n:
                c, s = np.array(cs), np.array(sigs)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(bands, pa.list_(pa.int64())), *(pa.array(s[:, i]) for i in range(WORDS))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCH)


#: Document ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the documents wanted (doc_id)."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id", "left_semi"), "texts")


def _confirmed(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    hundred = round(100 * similarity)
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for t in lean(batches):
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x = x.as_py()
                p = last[1] if x == last[0] else shingle_set(x)
                last = (x, p)
                q = shingle_set(y.as_py())
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * common >= hundred * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays(list(t.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct(), "confirmed")
    drop(texts)
    return out


def _meetings(rows: DataFrame, group: str, blocks: Callable[[Column, Column], Column]) -> DataFrame:
    """rows (group, component, rep, n_shingles and others) dealt into meetings (group, i, j, side) of two
    blocks each. A group's largest component (A) needs no meeting with itself: block i of the rest (X)
    meets block j of X (0 to xs - 1, i <= j) or block j - xs of A. blocks: their number for a count of
    rows and of shingles."""
    parts = rows.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = parts.groupBy(group).agg(F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("a"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    sizes = sizes.select(group, F.col("a.component").alias("largest"), blocks(F.col("n") - F.col("a.n"), F.col("s") - F.col("a.s")).alias("xs"), blocks(F.col("a.n"), F.col("a.s")).alias("as"))
    placed = rows.join(sizes, group).withColumn("inner", F.col("component") == F.col("largest"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("as")).otherwise(F.col("xs"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    meet = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    block, xs = F.col("block"), F.col("xs")
    of_a = F.transform(every(xs), lambda i: meet(i, xs + block, 1))
    first = F.transform(F.sequence(block, xs + F.col("as") - 1), lambda j: meet(block, j, 0))
    second = F.transform(F.filter(every(xs), lambda i: i <= block), lambda i: meet(i, block, 1))
    placed = placed.where("xs > 0").withColumn("m", F.explode(F.when(F.col("inner"), of_a).otherwise(F.concat(first, second))))
    return placed.select(*rows.columns, "m.*")


def _bucket_edges(rows: DataFrame, similarity: float, meeting: int = MEETING) -> DataFrame:
    """(a, b): edges between components that join those of a bucket whose members' sizes allow
    `similarity` and whose estimates, unless a set is small, come near it. rows: key, component, rep,
    n_shingles and signature. No more edges leave a meeting than it has members."""
    names = ["group", "component", "n_shingles", *(f"s{i}" for i in range(WORDS))]
    hundred = round(100 * similarity)
    most = math.floor(PERMUTATIONS * (1 - 2.0**-BITS) * (1 - (similarity - MARGIN)))  # differing lanes

    def edges(c: np.ndarray, n: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int]]:
        # breadth first; each member is held only against those not yet reached
        left = np.arange(len(c))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                z = s[left] ^ s[i]
                differ = np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
                same = c[left] == c[i]
                low, high = np.minimum(n[left], n[i]), np.maximum(n[left], n[i])
                hit = same | (100 * low >= hundred * high) & ((low < SMALL) | (differ <= most))
                for x in np.unique(c[left[hit & ~same]]).tolist():
                    yield int(c[i]), x
                queue += left[hit].tolist()
                left = left[~hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, len(names)), np.int64)  # at most one meeting goes on in the next batch
        for b in chain(batches, [None]):
            t = rest if b is None else np.vstack([rest, np.array([b.column(i).to_numpy() for i in range(len(names))]).T])
            if not len(t):
                continue
            starts = np.flatnonzero(np.concatenate([[True], t[1:, 0] != t[:-1, 0]]))
            stop = len(t) if b is None else starts[-1]
            found = set()
            for i, j in zip(starts, [*starts[1:], len(t)], strict=True):
                if i < stop:
                    found.update(edges(t[i:j, 1], t[i:j, 2], np.ascontiguousarray(t[i:j, 3:]).view(np.uint64)))
            rest = t[stop:]
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    # most buckets are one meeting of one block; their rows needn't be told apart by sides
    small = rows.groupBy("key").agg(F.count("*").alias("n"))
    rows = rows.join(small, "key")
    one = rows.where(F.col("n") <= meeting).withColumn("group", F.col("key"))
    many = _meetings(rows.where(F.col("n") > meeting).drop("n"), "key", lambda n, _: F.ceil(n / meeting).cast("int")).withColumn("group", F.xxhash64("key", "i", "j"))
    return one.select(names).union(many.select(names)).repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long").distinct()


def similar_pairs(one: list[np.ndarray], two: list[np.ndarray], hundred: int) -> np.ndarray:
    """Matrix of whether sets are similar enough, by products over the shingles that both sides share."""
    n, m = np.array([len(s) for s in one]), np.array([len(s) for s in two])
    p, q = np.concatenate(one), np.concatenate(two)
    at_p, at_q = np.repeat(np.arange(len(one)), n), np.repeat(np.arange(len(two)), m)
    known = np.intersect1d(p, q)
    common = np.zeros((len(one), len(two)), np.float32)
    for i in range(0, len(known), SHINGLES_AT_ONCE):
        k = known[i : i + SHINGLES_AT_ONCE]
        sides = []
        for h, at, size in ((p, at_p, len(one)), (q, at_q, len(two))):
            col = np.minimum(np.searchsorted(k, h), len(k) - 1)
            ok = k[col] == h
            x = np.zeros((size, len(k)), np.float32)
            x[at[ok], col[ok]] = 1
            sides.append(x)
        common += sides[0] @ sides[1].T
    common = np.rint(common).astype(np.int64)
    return 100 * common >= hundred * (n[:, None] + m[None, :] - common)


def _across(docs: DataFrame, rows: DataFrame, sigs: DataFrame, similarity: float, meeting: int = MEETING) -> DataFrame | None:
    """Links between components of rows (key, rep, component), found without making pairs.

    Components that sizes and estimates connect form a cluster, whose members' texts meet in blocks
    (see _meetings). In each meeting full sets are compared, and one link is reported for components
    it joins.
    """
    hundred = round(100 * similarity)
    edges = written(_bucket_edges(rows.join(sigs, "rep"), similarity, meeting), "edges")
    if edges.isEmpty():
        drop(edges)
        return None
    joined = components(edges)
    cluster = written(joined, "clusters")
    drop(edges, joined)
    members = rows.select("rep", "component").distinct().join(cluster.toDF("component", "cluster"), "component").join(sigs.select("rep", "n_shingles"), "rep")
    members = written(members, "members")
    placed = _meetings(members, "cluster", lambda n, shingles: F.ceil(F.greatest(n / meeting, F.when(n > 0, shingles / MEETING_SHINGLES).otherwise(0))).cast("int"))
    placed = placed.select("cluster", "component", "rep", "i", "j", "side")
    texts = _texts(docs, members.select(F.col("rep").alias("doc_id")).distinct())
    units = placed.join(texts.withColumnRenamed("doc_id", "rep"), "rep")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(one) and len(two):
            like = similar_pairs([shingle_set(t) for t in one["text"]], [shingle_set(t) for t in two["text"]], hundred)
            c, d = one["component"].to_numpy(), two["component"].to_numpy()
            like &= c[:, None] != d[None, :]
            # one link for each two components that meet here, found component by component
            for k in np.unique(c).tolist():
                rows = np.flatnonzero(c == k)
                cols = np.flatnonzero(like[rows].any(axis=0))
                _, first = np.unique(d[cols], return_index=True)
                cols = cols[first]
                out.append(np.stack([one["rep"].to_numpy()[rows[like[np.ix_(rows, cols)].argmax(axis=0)]], two["rep"].to_numpy()[cols]], axis=1))
        out = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    more = written(units.groupBy("cluster", "i", "j").applyInPandas(verify, "a long, b long").distinct(), "confirmed")
    drop(texts, members, cluster)
    return more


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, meeting: int = MEETING) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs (doc_id, text), one row a row.

    Links: 100 * |intersection| >= 100 * similarity * |union| of the shingle sets. Texts without
    words, null or empty, link with nothing. Rows with null doc_id link with nothing, their
    component_id is null and they are kept. Rows that repeat a doc_id are one document with the
    links of each. Other columns are ignored. An empty table gives no rows.
    """
    sig = [f"s{i}" for i in range(WORDS)]
    all_docs = written(sketches(docs), "sketches")
    sets = all_docs.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min_by("bands", "doc_id").alias("bands"), *(F.min_by(s, "doc_id").alias(s) for s in sig))
    classes = written(classes, "classes")
    members = classes.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    active = written(members.join(shared, "key"), "buckets")

    def estimated(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"{x}n"), *(F.col(s).alias(f"{x}{s}") for s in sig)), x)
        good = estimate([F.col(f"a{s}") for s in sig], [F.col(f"b{s}") for s in sig]) >= similarity - MARGIN
        low, high = F.least("an", "bn"), F.greatest("an", "bn")
        return pairs.where((100 * low >= round(100 * similarity) * high) & ((low < SMALL) | good)).select("a", "b").distinct()

    def placed(found: DataFrame | None) -> DataFrame:
        """Members of buckets that hold several components, with their components."""
        rows = active.withColumn("component", F.col("rep")) if found is None else active.join(found, active.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return rows if found is None else rows.join(mixed, "key")

    def proposed(rows: DataFrame) -> DataFrame:
        """(a, b): for each member b one a of another component: the smallest of the bucket's largest
        component, from the buckets that agree most."""
        by_part = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("rep").alias("a"))
        hub = by_part.groupBy("key").agg(F.min_by(F.struct("a", "component"), F.struct(-F.col("n"), "component")).alias("hub"))
        votes = rows.join(hub, "key").where("component <> hub.component").groupBy(F.col("hub.a").alias("a"), F.col("rep").alias("b")).count()
        return votes.groupBy("b").agg(F.min_by("a", F.struct(-F.col("count"), "a")).alias("a")).select("a", "b")

    found, links, confirmed = None, None, []
    for no in range(ROUNDS + 1):
        rows = written(placed(found), "placed")
        if no < ROUNDS:
            pairs = written(estimated(proposed(rows)), "pairs")
            more = None if pairs.isEmpty() else _confirmed(docs, pairs, similarity)
            drop(pairs)
        else:
            more = _across(docs, rows, classes.select("rep", "n_shingles", *sig), similarity, meeting)
        drop(rows)
        if more is None:
            continue
        links = more if links is None else links.union(more)
        confirmed.append(more)
        joined = components(links)
        if found is not None:
            drop(found)
        found = written(joined, "components")
        drop(joined)
    drop(active, *confirmed)

    alone_classes = found is None
    if alone_classes:
        found = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    class_of = classes.select("c1", "c2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    # the smallest doc_id of a class is its representative, so a component's smallest node is its smallest document
    out = sets.select("doc_id", "n_shingles", "c1", "c2").join(class_of, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id")
    alone = all_docs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = written(out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "duplicates")
    drop(all_docs, classes, *([] if alone_classes else [found]))
    return out
