"""Hierarchical navigable small-world graphs in numpy, built and searched many vectors at a time."""

from __future__ import annotations

import io

import numpy as np

LINKS = 12
BUILD_BEAM = 32
AT_ONCE = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hnsw:
    """Nodes are numbered by falling level, so layer l is a prefix of them. A node's list in a layer
    has `links` chosen neighbours, spread in direction, and as many of those that chose it."""

    def __init__(self, order: np.ndarray, x: np.ndarray, layers: list[np.ndarray]):
        self.order, self.layers = order, layers
        # a last row of zeros takes the place of missing neighbours
        self.x = np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)
        self.n = len(x)

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 0) -> Hnsw:
        """x: unit rows."""
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        g = cls(order, x[order], [])
        sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
        g.layers = [np.zeros((0, 0), np.int32)] * len(sizes)
        for k in reversed(range(len(sizes))):
            g._layer(k, sizes[k], sizes[k + 1] if k + 1 < len(sizes) else 0, links, beam)
        return g

    def _layer(self, k: int, size: int, above: int, links: int, beam: int) -> None:
        none = self.n
        lists = np.full((size, 2 * links), none, np.int32)
        self.layers[k] = lists
        done = 0
        while done < size:
            step = min(size - done, max(256, above)) if not done else min(size - done, done, AT_ONCE)
            new = np.arange(done, done + step)
            q = self.x[new]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            c = min(beam, step - 1)
            ids = np.full((step, 0), none, np.int64)
            if c > 0:
                ids = new[np.argpartition(-near, c - 1, axis=1)[:, :c]]
            if done:
                at = self._descend(q, k + 1)
                found, _ = self._beam(k, q, at, beam)
                ids = np.hstack([ids, found])
            self._link(lists, new, ids, links)
            done += step

    def _link(self, lists: np.ndarray, new: np.ndarray, ids: np.ndarray, links: int) -> None:
        none = self.n
        if not ids.shape[1]:
            return
        sims = np.einsum("ad,acd->ac", self.x[new], self.x[ids])
        sims[ids == none] = -np.inf
        rank = np.argsort(-sims, axis=1)[:, :BUILD_BEAM + 16]
        ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        width = ids.shape[1]
        kept = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)  # to a kept one
        for c in range(width):
            take = (sims[:, c] > closest[:, c]) & (kept.sum(1) < links) & (ids[:, c] != none)
            kept[:, c] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
        # room that is left goes to the nearest of the others
        first = np.argsort(~kept, axis=1, kind="stable")[:, :links]
        chosen = np.take_along_axis(ids, first, 1)
        lists[new, : chosen.shape[1]] = chosen
        # and back: of those that chose a node the nearest stay
        src, dst = chosen.ravel(), np.repeat(new, chosen.shape[1])
        ok = src != none
        src, dst = src[ok], dst[ok]
        old = np.unique(src)
        row, col = np.nonzero(lists[old, links:] != none)
        src, dst = np.concatenate([src, old[row]]), np.concatenate([dst, lists[old[row], links + col]])
        sim = np.einsum("ad,ad->a", self.x[src], self.x[dst])
        by = np.lexsort((-sim, src))
        src, dst = src[by], dst[by]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        ok = place < links
        lists[old, links:] = none
        lists[src[ok], links + place[ok]] = dst[ok]

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest node found greedily in the layers from the top down to `to`."""
        at = np.zeros(len(q), np.int64)
        for k in reversed(range(to, len(self.layers))):
            lists = self.layers[k]
            best = np.einsum("ad,ad->a", q, self.x[at])
            moving = np.arange(len(q))
            while len(moving):
                ids = lists[at[moving]]
                sims = np.einsum("ad,acd->ac", q[moving], self.x[ids])
                sims[ids == self.n] = -np.inf
                j = sims.argmax(1)
                s = sims[np.arange(len(moving)), j]
                better = s > best[moving] + 1e-7
                ids = ids[np.arange(len(moving)), j]
                moving, s, ids = moving[better], s[better], ids[better]
                at[moving], best[moving] = ids, s
        return at

    def _beam(self, k: int, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes met from `at` on, and their similarities; missing ones are n."""
        lists, n = self.layers[k], len(q)
        ids = np.full((n, beam), self.n, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, self.n + 1), bool)
        seen[:, self.n] = True
        ids[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("ad,ad->a", q, self.x[at]), True
        seen[np.arange(n), at] = True
        live = np.arange(n)
        while True:
            s = np.where(open_[live], sims[live], -np.inf)
            j = s.argmax(1)
            go = s[np.arange(len(live)), j] > -np.inf
            live, j = live[go], j[go]
            if not len(live):
                return ids, sims
            open_[live, j] = False
            near = lists[ids[live, j]].astype(np.int64)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            # lists may name a neighbour twice: chosen and choosing
            o = np.sort(np.where(fresh, near, self.n), axis=1)
            o[:, 1:][o[:, 1:] == o[:, :-1]] = self.n
            s = np.einsum("ad,acd->ac", q[live], self.x[o])
            s[o == self.n] = -np.inf
            all_s = np.hstack([sims[live], s])
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(np.hstack([ids[live], o]), top, 1)
            open_[live] = np.take_along_axis(np.hstack([open_[live], s > -np.inf]), top, 1)
            sims[live] = np.take_along_axis(all_s, top, 1)

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """For each row of q (unit) the rows of the indexed x found, `beam` or fewer; -1 for missing ones."""
        out = []
        names = np.append(self.order, -1)
        for i in range(0, len(q), AT_ONCE):
            part = q[i : i + AT_ONCE].astype(np.float32)
            found, _ = self._beam(0, part, self._descend(part, 1), min(beam, self.n))
            out.append(names[found])
        return np.vstack(out) if out else np.zeros((0, 1), np.int64)

    def dump(self) -> bytes:
        """The graph without its vectors."""
        f = io.BytesIO()
        np.savez(f, order=self.order, **{f"l{k}": v for k, v in enumerate(self.layers)})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes, x: np.ndarray) -> Hnsw:
        """x: the unit rows it was built from."""
        z = np.load(io.BytesIO(raw))
        return cls(z["order"], x[z["order"]], [z[f"l{k}"] for k in range(len(z.files) - 1)])
