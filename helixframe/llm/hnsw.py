"""A hierarchical navigable small-world graph over one shard's vectors, in flat arrays.

Layers are built from the top down. A layer's vectors come in batches; a batch is searched for in the graph so far, linked to
a diverse choice of what it finds, and linked back, where full lists are thinned by the same choice. All searches run side by
side, so that NumPy does the work. Built twice from the same vectors, the graph is the same.
"""

from __future__ import annotations

import numpy as np


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of vectors."""
    return np.maximum(np.einsum("bmd,bmd->bm", v, v) - 2 * np.einsum("bd,bmd->bm", q, v) + np.einsum("bd,bd->b", q, q)[:, None], 0)


def search_layer(q: np.ndarray, entry: np.ndarray, ef: int, links: np.ndarray, vectors: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search side by side: the ``ef`` nearest found for each query, nearest first, -1 where there are fewer."""
    b = len(q)
    beam = np.full((b, ef), -1, dtype=np.int64)
    dist = np.full((b, ef), np.inf, dtype=np.float32)
    done = np.ones((b, ef), dtype=bool)
    seen = np.zeros((b, len(vectors)), dtype=bool)
    beam[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(q, vectors[entry][:, None])[:, 0]
    seen[np.arange(b), entry] = True
    live = np.arange(b)
    width = min(width, ef)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, width - 1, axis=1)[:, :width] if width < ef else np.argsort(open_, axis=1)
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        on = ok.any(axis=1)
        live, pick, ok = live[on], pick[on], ok[on]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.where(ok, beam[live[:, None], pick], -1)
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], near]] = -1
        most = int((near >= 0).sum(axis=1).max())
        if not most:
            continue
        near = -np.sort(-near, axis=1)[:, :most]
        real = near >= 0
        rows, cols = np.nonzero(real)
        seen[live[rows], near[rows, cols]] = True
        d = np.where(real, _distances(q[live], vectors[near]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_n = np.concatenate([beam[live], near], axis=1)
        all_o = np.concatenate([done[live], ~real], axis=1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[live], beam[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_d, all_n, all_o))
    order = np.argsort(dist, axis=1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(beam, order, 1), -1), dist


def choose(cand: np.ndarray, dist: np.ndarray, m: int, vectors: np.ndarray) -> np.ndarray:
    """Up to m of each row's candidates (nearest first, -1 for none): first those nearer to the row's vector than to any
    chosen before, then the nearest others."""
    v = vectors[cand]
    norm = np.einsum("bmd,bmd->bm", v, v)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(cand.shape, dtype=bool)
    for j in range(cand.shape[1]):
        near = (chosen & (between[:, j] < dist[:, j, None])).any(axis=1)
        chosen[:, j] = (cand[:, j] >= 0) & ~near & (chosen.sum(axis=1) < m)
    order = np.argsort(np.where(chosen, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(cand, order, 1)


class Hnsw:
    """vectors: n x d float32. links[0] has n rows; links[l] has one for each of nodes[l], by its place there."""

    def __init__(self, vectors: np.ndarray, m: int = 16, ef: int = 96, seed: int = 0):
        self.vectors, self.m = np.ascontiguousarray(vectors, dtype=np.float32), m
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(m)), 8).astype(np.int64)
        order = np.lexsort((np.arange(n), -level))
        sizes = [int((level >= l).sum()) for l in range(int(level.max(initial=0)) + 1)] if n else [0]
        self.order = order  # the first sizes[l] of it are layer l
        self.layers: list[np.ndarray] = []
        ordered = self.vectors[order]
        for size in reversed(sizes):
            self.layers.insert(0, self._layer(ordered[:size], ef))

    def _descend(self, q: np.ndarray, layers: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        entry = np.zeros(len(q), dtype=np.int64)
        for links in reversed(layers):
            entry = search_layer(q, entry, 8, links, vectors[: len(links)])[0][:, 0]
        return entry

    def _layer(self, vectors: np.ndarray, ef: int) -> np.ndarray:
        n, full = len(vectors), 2 * self.m
        links = np.full((n, full), -1, dtype=np.int64)
        upper, at = list(self.layers), 1
        while at < n:
            end = min(n, at + max(1, min(256, at // 2)))
            q = vectors[at:end]
            entry = self._descend(q, upper, vectors) if upper else np.zeros(len(q), dtype=np.int64)
            found, dist = search_layer(q, np.minimum(entry, at - 1), min(ef, max(8, at)), links[:at], vectors[:at])
            found, dist = found[:, :64], dist[:, :64]
            own = choose(found, dist, self.m, vectors)
            links[at:end, : own.shape[1]] = own
            self._back(links, vectors, np.repeat(np.arange(at, end), own.shape[1]), own.ravel(), full)
            at = end
        return links

    def _back(self, links: np.ndarray, vectors: np.ndarray, new: np.ndarray, old: np.ndarray, full: int) -> None:
        new, old = new[old >= 0], old[old >= 0]
        order = np.lexsort((new, old))
        new, old = new[order], old[order]
        nodes, first, many = np.unique(old, return_index=True, return_counts=True)
        fresh = np.full((len(nodes), int(many.max(initial=0))), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(nodes)), many)
        fresh[row, np.arange(len(old)) - first[row]] = new
        for i in range(0, len(nodes), 512):
            part = nodes[i : i + 512]
            cand = np.concatenate([links[part], fresh[i : i + 512]], axis=1)
            dist = np.where(cand >= 0, _distances(vectors[part], vectors[cand]), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")[:, : int((cand >= 0).sum(axis=1).max())]
            cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
            if cand.shape[1] > full:
                over = (cand >= 0).sum(axis=1) > full
                kept = cand[:, :full].copy()
                kept[over] = choose(cand[over], dist[over], full, vectors)
                cand = kept
            links[part] = -1
            links[part, : cand.shape[1]] = cand

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Rows of the k nearest found of each query, -1 for none."""
        if not len(self.vectors):
            return np.full((len(q), k), -1, dtype=np.int64)
        q = np.ascontiguousarray(q, dtype=np.float32)
        ordered = self.vectors[self.order]
        out = []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            entry = self._descend(part, self.layers[1:], ordered)
            found = search_layer(part, entry, max(ef, k), self.layers[0], ordered)[0][:, :k]
            out.append(np.where(found >= 0, self.order[found], -1))
        return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)

    def to_arrays(self) -> dict[str, bytes]:
        return {"graph_order": self.order.astype("<i4").tobytes(), "graph_sizes": np.array([len(x) for x in self.layers], dtype="<i4").tobytes(), "graph_links": np.concatenate([x.astype("<i4").ravel() for x in self.layers] or [np.zeros(0, "<i4")]).tobytes()}

    @classmethod
    def from_arrays(cls, vectors: np.ndarray, m: int, graph_order: bytes, graph_sizes: bytes, graph_links: bytes) -> Hnsw:
        self = cls.__new__(cls)
        self.vectors, self.m = vectors, m
        self.order = np.frombuffer(graph_order, dtype="<i4").astype(np.int64)
        flat, at, self.layers = np.frombuffer(graph_links, dtype="<i4").astype(np.int64), 0, []
        for size in np.frombuffer(graph_sizes, dtype="<i4").tolist():
            self.layers.append(flat[at : at + size * 2 * m].reshape(size, 2 * m))
            at += size * 2 * m
        return self
