"""Near-duplicate embeddings by small-world graphs, one per shard.

Vectors with equal labels link if their cosine is high enough. Equal vectors are one class. Classes
are dealt into shards of a bounded size by label; each shard has a graph (see hnsw), every shard of
a label is queried with the vectors of every other, and all found links are verified in double
precision. A shard of any size is searched by beams first; they are widened until an audit against
brute force on AUDIT rows misses no link, and only a shard whose wide beams fail the audit is scanned.
(If a share p of the rows had a link lost, an audit would pass with (1 - p)^1024: 1e-3 with 0.7 % of
them.) Within the groups so found all pairs are counted by block matrix products, so a dense group
doesn't depend on how wide a beam was. Between tasks go counts and one edge per pair of groups, never
all pairs; of the two shards that meet, one comes with its graph, the other as queries without one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, written
from .hnsw import Hnsw, unit
from .vectors import matrix, usable

COSINE = 0.93
#: Rows of a shard, fewer where they would take more bytes than this.
SHARD, SHARD_BYTES = 16384, 1 << 25
BEAM = 32
AUDIT = 1024
BLOCK = 2048


def groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _beams(g: Hnsw, x: np.ndarray, q: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs (row of q, row of x) with at least this cosine: by ever wider beams, last by a scan (beam 0)."""
    beam = min(BEAM, g.n)
    while True:
        found = g.search(q, beam)
        a, b = np.repeat(np.arange(len(q)), found.shape[1]), found.ravel()
        a, b = a[b >= 0], b[b >= 0]
        ok = np.concatenate([np.einsum("ad,ad->a", q[a[i : i + 65536]], x[b[i : i + 65536]]) >= cosine for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        yield beam, a[ok], b[ok]
        beam *= 2
        if beam * 4 >= g.n:  # wider ones cost more than a scan
            break
    parts = []
    for i in range(0, len(q), BLOCK):
        r, c = np.nonzero(_scan(x, q[i : i + BLOCK], cosine))
        parts.append((r + i, c))
    yield 0, np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])


def _audit(x: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """A sample of rows of q and their true numbers of links."""
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    return sample, _scan(x, q[sample], cosine).sum(1)


@dataclass
class Audit:
    """The beam that passed (0: a scan), and the share of the sample's links that the first one led to."""

    beam: int = 0
    recall: float | None = None

    def passed(self, beam: int, got: np.ndarray, want: np.ndarray) -> bool:
        self.beam = beam
        if self.recall is None:
            self.recall = float(np.minimum(got, want).sum() / max(1, want.sum())) if want.any() else 1.0
        return bool((got >= want).all())


def within(g: Hnsw, x: np.ndarray, copies: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, Audit]:
    """Group of each row and its links, counting copies."""
    sample, want = _audit(x, x, cosine)
    audit = Audit()
    for beam, a, b in _beams(g, x, x, cosine):
        group = groups(len(x), a, b)
        links, plain = copies - 1, np.ones(len(x), np.int64)
        for part in _members(group):
            for i in range(0, len(part), BLOCK):
                rows = part[i : i + BLOCK]
                near = _scan(x[part], x[rows], cosine)
                near[np.arange(len(rows)), i + np.arange(len(rows))] = False
                links[rows] += near @ copies[part]
                plain[rows] += near.sum(1)
        if audit.passed(beam, plain[sample] - 1, want - 1):  # less the row itself
            break
    return group, links, audit


def between(g: Hnsw, one: dict, two: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, Audit]:
    """Pairs of groups with links, and the links of each side's rows into the other, counting copies. g indexes two."""
    sample, want = _audit(two["x"], one["x"], cosine)
    in_one = {int(one["group"][p[0]]): p for p in _members(one["group"])}
    in_two = {int(two["group"][p[0]]): p for p in _members(two["group"])}
    audit = Audit()
    for beam, a, b in _beams(g, two["x"], one["x"], cosine):
        pairs = np.unique(np.stack([one["group"][a], two["group"][b]], 1), axis=0)
        more = np.zeros(len(one["x"]), np.int64), np.zeros(len(two["x"]), np.int64)
        plain = np.zeros(len(one["x"]), np.int64)
        for ga, gb in pairs.tolist():
            pa, pb = in_one.get(ga, np.array([ga])), in_two.get(gb, np.array([gb]))
            for i in range(0, len(pa), BLOCK):
                rows = pa[i : i + BLOCK]
                near = _scan(two["x"][pb], one["x"][rows], cosine)
                more[0][rows] += near @ two["copies"][pb]
                more[1][pb] += one["copies"][rows] @ near
                plain[rows] += near.sum(1)
        if audit.passed(beam, plain[sample], want):
            break
    return pairs, *more, audit


def _scan(x: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    return q @ x.T >= cosine


def _members(group: np.ndarray) -> Iterator[np.ndarray]:
    by = np.argsort(group, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        if len(part) > 1:
            yield part


INDEX = "shard int, shards int, nodes array<long>, keys array<long>, links array<long>, groups array<long>, rows binary, graph binary"


def _index(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """A shard's graph, and the links and groups within it."""
    pdf = pdf.sort_values(["node", "key"]).reset_index(drop=True)
    x, copies = unit(matrix(pdf["embedding"])), pdf["copies"].to_numpy(np.int64)
    nodes = pdf["node"].to_numpy(np.int64)
    g = Hnsw.build(x)
    group, links, _ = within(g, x, copies, cosine)
    rows = graph = b""
    shards = int(pdf["shards"].iloc[0])
    if shards > 1:
        f = io.BytesIO()
        np.savez(f, x=x, copies=copies, nodes=nodes, keys=pdf["key"].to_numpy(np.int64), group=group)
        rows, graph = f.getvalue(), g.dump()
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "shards": [shards], "nodes": [nodes], "keys": [pdf["key"].to_numpy(np.int64)], "links": [links], "groups": [nodes[group]], "rows": [rows], "graph": [graph]})


def _across(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between two shards: (node, key, more links) and edges between groups (node, other node)."""
    pdf = pdf.sort_values("graph", key=lambda g: g.notna())
    one, two = ({k: z[k] for k in z.files} for z in (np.load(io.BytesIO(r)) for r in pdf["rows"]))
    pairs, *more, _ = between(Hnsw.load(pdf["graph"].iloc[1], two["x"]), one, two, cosine)
    out = []
    for z, m in zip((one, two), more, strict=True):
        at = np.flatnonzero(m)
        out.append(pd.DataFrame({"node": z["nodes"][at], "key": z["keys"][at], "links": m[at], "other": None}))
    out.append(pd.DataFrame({"node": one["nodes"][pairs[:, 0]], "key": 0, "links": 0, "other": two["nodes"][pairs[:, 1]]}))
    return pd.concat(out).astype({"other": "Int64"})


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for rows (vec_id, embedding, label), one row a row.

    Links hold between rows of equal, non-null label whose vectors have the same length and at
    least this cosine. Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows with null vec_id or label, link with nothing: n_links 0, the component is the vec_id
    itself, kept (also where that is null). Repeated rows are vectors of their own that link; rows
    that repeat a vec_id share its component. Other columns are ignored. An empty table gives no rows.
    """
    v = F.col("embedding")
    base = rows.select("vec_id", "embedding", "label").withColumn("ok", usable(v) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    base = base.withColumn("key", F.xxhash64(v)).withColumn("key2", F.xxhash64(F.lit(1), v))
    classes = base.where("ok").groupBy("label", "key", "key2").agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "vectors")
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key", "key2"), F.col("shards")).cast("int"))
    index = dealt.select("label", "dim", "shard", "shards", "node", "key", "copies", "embedding").groupBy("label", "dim", "shard")
    index = written(index.applyInPandas(lambda key, pdf: _index(pdf, cosine).assign(label=key[0], dim=key[1]), f"label {dict(classes.dtypes)['label']}, dim int, {INDEX}"), "graphs")

    found = index.selectExpr("inline(arrays_zip(nodes, keys, links, groups))").toDF("node", "key", "links", "group")
    used = [classes, index]
    if index.where("shards > 1").isEmpty():
        result = found.select("node", "key", "links", F.col("group").alias("component"))
    else:
        many = index.where("shards > 1").select("label", "dim", "shard", "rows", "graph", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("o")).where("o <> shard")
        # the graphs of a shard and of the other one are asked about equally often
        low, high = F.least("shard", "o"), F.greatest("shard", "o")
        asked = F.when((low + high) % 2 == 0, low).otherwise(high)
        many = many.select("label", "dim", low.alias("i"), high.alias("j"), "rows", F.when(asked == F.col("shard"), F.col("graph")).alias("graph"))
        across = written(many.groupBy("label", "dim", "i", "j").applyInPandas(lambda pdf: _across(pdf, cosine), "node long, key long, links long, other long"), "across")
        more = across.where("other is null").groupBy("node", "key").agg(F.sum("links").alias("more"))
        edges = across.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(found.where("node <> group").select("node", "group"))
        joined = components(edges)
        used += [across, joined]
        result = found.join(more, ["node", "key"], "left").join(joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
        result = result.select("node", "key", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    of_class = classes.select("label", "key", "key2", "node").join(result, ["node", "key"]).select("label", "key", "key2", "links", "component")
    linked_rows = base.where("ok").select("vec_id", "label", "key", "key2").join(of_class, ["label", "key", "key2"])
    out = linked_rows.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")))
    out = written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "components")
    drop(*used)
    return out
