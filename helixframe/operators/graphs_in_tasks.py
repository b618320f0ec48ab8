"""Measures of graphs whose links fit one task with ease: shortest paths from blocks of sources, main eigenvectors, communities.

A task gets the links of one graph, each once (graph, src, dst, and w where weights count), and for paths one block of its
sources, so a graph's sources spread over tasks. ``networks`` decides which graphs come here and works on larger ones by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values that one step of a search holds for all links at once.
STEP = 16 << 20
#: Nodes, over all sources that are followed at once, whose numbers of paths stay in the cache.
STATES = 1 << 16
#: Values of nodes that are compared at once, and neighbours of a node that are compared by themselves.
CACHED, HUB = 16 << 10, 64


class Links:
    """Both directions of the links between nodes 0, 1 ... in the order of their ids, sorted by the end they lead to."""

    def __init__(self, table: pa.Table):
        src, dst = table.column("src").combine_chunks(), table.column("dst").combine_chunks()
        ids = pc.unique(pa.concat_arrays([src, dst]))
        self.ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(x, self.ids).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        frm, to = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((frm, to))
        self.src, self.dst = frm[order], to[order]
        self.n, self.starts = len(self.ids), np.searchsorted(self.dst, np.arange(len(self.ids)))
        if "w" in table.column_names:
            w = table.column("w").to_numpy()
            self.w = np.concatenate([w, w])[order]

    def some(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the links from active nodes the starts of runs to one node, these nodes, and the ends they come from."""
        at = np.flatnonzero(active[self.src])
        to = self.dst[at]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
        return starts, to[starts], self.src[at]

    def along(self, places: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of nodes that stand at ``places``, each in one of several stretches of all nodes: both ends' places."""
        node = places % self.n
        many = degree[node]
        base = np.repeat(places - node, many) if len(places) and places[-1] >= self.n else 0
        at = np.arange(many.sum())
        at += np.repeat(self.starts[node] - np.cumsum(many) + many, many)
        return np.repeat(places, many), self.src[at] + base

    def parts(self) -> np.ndarray:
        """The first node of each node's component."""
        label = np.arange(self.n)
        while True:
            low = np.minimum(label, np.minimum.reduceat(label[self.src], self.starts))
            np.minimum.at(low, label, low.copy())  # roots hear of it, too
            low = low[low]
            if np.array_equal(low, label):
                return label
            label = low


class Near:
    """Neighbours of the nodes of ``links``, numbered anew so that degrees fall: of any ascending nodes those that have a k-th
    neighbour come first, so values of neighbours (rows of a matrix) are compared by whole rows, without a table of all links."""

    def __init__(self, links: Links):
        degree = np.diff(np.append(links.starts, len(links.src)))
        self.order = np.argsort(-degree, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(links.n)
        self.n, self.degree, self.first, self.next = links.n, degree[self.order], links.starts[self.order], self.place[links.src]
        self.w = links.w

    def around(self, rows: np.ndarray) -> np.ndarray:
        """The neighbours of some nodes, ascending."""
        far = self.degree[rows]
        at = np.arange(far.sum()) + np.repeat(self.first[rows] - np.cumsum(far) + far, far)
        mark = np.zeros(self.n, dtype=bool)
        mark[self.next[at]] = True
        return np.flatnonzero(mark)

    def pieces(self, rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """Ascending nodes in parts whose values, ``width`` each, stay in the cache."""
        size = max(1, CACHED // max(1, width))
        return (rows[i : i + size] for i in range(0, len(rows), size))

    def least(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each node its own values or, where less, those of a neighbour and the link's ``w``."""
        out = values[rows]
        first, hubs = self.first[rows], int(np.searchsorted(-self.degree[rows], -HUB))
        for i in range(hubs):
            at = slice(first[i], first[i] + self.degree[rows[i]])
            np.minimum(out[i], (values[self.next[at]] + self.w[at, None]).min(axis=0), out=out[i])
        for k, end in self._ends(rows, hubs):
            at = first[hubs:end] + k
            step = values[self.next[at]]
            step += self.w[at, None]
            np.minimum(out[hubs:end], step, out=out[hubs:end])
        return out

    def _ends(self, rows: np.ndarray, hubs: int) -> Iterator[tuple[int, int]]:
        """For each k the end of the nodes, after the hubs, that have a k-th neighbour."""
        if hubs < len(rows):
            most = int(self.degree[rows[hubs]])
            yield from enumerate(np.searchsorted(-self.degree[rows], -np.arange(most), side="left").tolist())

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Lengths of the shortest paths to all nodes (rows) from some (columns); only neighbours of nodes that came nearer are seen again."""
        out = np.full((self.n, len(sources)), np.inf)
        out[sources, np.arange(len(sources))] = 0
        moved = np.sort(sources)
        while len(moved):
            found = []
            for some in self.pieces(self.around(moved), len(sources)):
                new = self.least(out, some)
                found.append(some[(new < out[some]).any(axis=1)])
                out[some] = new
            moved = np.concatenate(found)
        return out


def _sources(links: Links, q: pa.Table) -> np.ndarray:
    return np.sort(pc.index_in(q.column("id").combine_chunks(), links.ids).to_numpy(zero_copy_only=False).astype(np.int64))


def _of(q: pa.Table, n: int) -> pa.Array:
    return q.column("graph").combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64)))


def path_sums(key, q: pa.Table, t: pa.Table) -> pa.Table:
    """(graph, part, m, total, far): of each component the first node, the size, the sum of the distances from the block's
    sources and the largest one. A source is a bit of a word, so a step serves 64 sources with one operation."""
    g = Links(t)
    sources, parts = _sources(g, q), g.parts()
    total, far = np.zeros(g.n, dtype=np.int64), np.zeros(g.n, dtype=np.int64)
    width = 64 * max(1, min(32, STEP // max(1, len(g.src))))
    for s in range(0, len(sources), width):
        block = sources[s : s + width]
        front = np.zeros((g.n, -(-len(block) // 64)), dtype=np.uint64)
        place = np.arange(len(block))
        front[block, place // 64] = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
        seen, step = front.copy(), 0
        while True:
            starts, to, frm = g.some(front.any(axis=1))
            new = np.bitwise_or.reduceat(front[frm], starts, axis=0) & ~seen[to]
            met = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            if not met.any():
                break
            step += 1
            front = np.zeros_like(seen)
            front[to] = new
            seen |= front
            total[to] += step * met
            far[to[met > 0]] = np.maximum(far[to[met > 0]], step)
    first, at = np.unique(parts, return_inverse=True)
    largest = np.zeros(len(first), dtype=np.int64)
    np.maximum.at(largest, at, far)
    sums = np.zeros(len(first), dtype=np.int64)
    np.add.at(sums, at, total)
    return pa.table({"graph": _of(q, len(first)), "part": g.ids.take(pa.array(first)), "m": pa.array(np.bincount(at)), "total": pa.array(sums), "far": pa.array(largest)})


def dependency_sums(key, q: pa.Table, t: pa.Table) -> pa.Table:
    """(graph, id, delta, seen, total, far): of each node Brandes' dependencies, the sources that reach it, and the sum and the
    largest of their distances, from all sources of the block. A few sources at a time have a stretch of one array each, a step
    goes along the links of the nodes met last, and the way back along those of them that led on: a link counts once for a source."""
    g = Links(t)
    n, sources, degree = g.n, _sources(g, q), np.diff(np.append(g.starts, len(g.src)))
    delta_sum, seen, total, far = np.zeros(n), *(np.zeros(n, dtype=np.int64) for _ in range(3))
    width = max(1, min(64, STATES // n))
    for s in range(0, len(sources), width):
        block = sources[s : s + width]
        size = n * len(block)
        front = block + n * np.arange(len(block))
        paths, dist, left = np.zeros(size), np.full(size, -1, dtype=np.int32), len(block) * len(g.src)
        paths[front], dist[front] = 1, 0
        levels, steps = [front], []
        while True:
            ahead = int(degree[front % n].sum())
            left -= ahead
            if ahead <= left:
                frm, to = g.along(front, degree)
                on = np.flatnonzero(dist[to] < 0)
            else:  # nodes not met have fewer links than those met last
                to, frm = g.along(np.flatnonzero(dist < 0), degree)
                on = np.flatnonzero(dist[frm] == len(steps))
            if not len(on):
                break
            frm, to = frm[on], to[on]
            if len(to) < size >> 5:
                front, at = np.unique(to, return_inverse=True)
                paths[front] = np.bincount(at, paths[frm])
            else:
                sums = np.bincount(to, paths[frm], size)
                front = np.flatnonzero(sums)
                paths[front] = sums[front]
            dist[front] = len(levels)
            levels.append(front)
            steps.append((frm, to))
        delta, share = np.zeros(size), np.zeros(size)
        for i in range(len(steps) - 1, 0, -1):
            here, (frm, to), below = levels[i], steps[i], levels[i + 1]
            share[below] = (1 + delta[below]) / paths[below]
            if len(to) < size >> 5:
                up = np.bincount(np.searchsorted(here, frm), share[to], len(here))
            else:
                up = np.bincount(frm, share[to], size)[here]
            delta[here] = paths[here] * up
        dist = dist.reshape(-1, n)
        delta_sum += delta.reshape(-1, n).sum(axis=0)
        seen += (dist > 0).sum(axis=0)
        total += np.maximum(dist, 0).sum(axis=0, dtype=np.int64)
        far = np.maximum(far, dist.max(axis=0))
    return pa.table({"graph": _of(q, n), "id": g.ids, "delta": pa.array(delta_sum), "seen": pa.array(seen), "total": pa.array(total), "far": pa.array(far.astype(np.int32))})


def combination(m: np.ndarray, scale: float, depth: int) -> np.ndarray:
    """Of the products of x, Ax, A(Ax) ... (``m``) the combination that is nearest to the main eigenvector."""
    values, vectors = np.linalg.eigh(m[:depth, :depth])
    good = values > values[-1] * 1e-13
    base = vectors[:, good] / np.sqrt(values[good])
    inner = base.T @ m[:depth, 1:] @ base * scale
    y = base @ np.linalg.eigh((inner + inner.T) / 2)[1][:, -1]
    return y * (np.sign(y @ m[:depth, 0]) or 1.0)


def main_vector(cycles: int, tolerance: float, depth: int):
    def run(t: pa.Table) -> pa.Table:
        g = Links(t)
        scale = float(np.bincount(g.dst).max())
        x = np.full(g.n, 1 / np.sqrt(g.n))
        for _ in range(cycles):
            steps = [x]
            for _ in range(depth):
                steps.append(np.add.reduceat(steps[-1][g.src], g.starts) / scale)
            wide = np.stack(steps)
            new = combination(wide @ wide.T, scale, depth) @ wide[:depth]
            moved, x = np.abs(new - x).max(), new
            if moved <= tolerance:
                break
        return pa.table({"graph": _of(t, g.n), "id": g.ids, "eigenvector": pa.array(x)})

    return run


def louvain(none: float):
    """(graph, id, community) of one graph whose nodes have ``hash_src`` and ``hash_dst`` besides: the rounds of ``networks``,
    judged for this graph alone."""

    def run(t: pa.Table) -> pa.Table:
        g = Links(t)
        salt = np.zeros(g.n, dtype=np.int64)
        for end in ("src", "dst"):
            salt[pc.index_in(t.column(end).combine_chunks(), g.ids).to_numpy(zero_copy_only=False).astype(np.int64)] = t.column(f"hash_{end}").to_numpy()
        src, dst, w = g.src, g.dst, g.w
        k = np.bincount(src, w, g.n)
        m2, label, nodes = k.sum(), np.arange(g.n), np.arange(g.n)
        while True:
            c = _moved(src, dst, w, k, m2, salt, nodes, none)
            if np.array_equal(c[nodes], nodes):
                break
            label = c[label]
            k = np.bincount(c[nodes], k[nodes], g.n)
            pair, at = np.unique(c[src] * g.n + c[dst], return_inverse=True)
            w = np.bincount(at, w, len(pair))
            src, dst = pair // g.n, pair % g.n
            src, dst, w = (x[pair // g.n != pair % g.n] for x in (src, dst, w))
            nodes = np.unique(c[nodes])
        low = np.full(g.n, g.n)
        np.minimum.at(low, label, np.arange(g.n))
        return pa.table({"graph": _of(t, g.n), "id": g.ids, "community": g.ids.take(pa.array(low[label]))})

    return run


def _moved(src, dst, w, k, m2, salt, nodes, none):
    """The communities of one level's nodes: as ``networks._level`` and ``_judged``."""
    n = len(salt)
    kept, best_q, part, rounds, c = None, None, 1, 0, np.arange(n)
    while True:
        tot, many = np.bincount(c[nodes], k[nodes], n), np.bincount(c[nodes], minlength=n)
        pair, at = np.unique(src * n + c[dst], return_inverse=True)
        sums = np.bincount(at, w, len(pair))
        i, to = pair // n, pair % n
        mine = to == c[i]
        w_own = np.bincount(i[mine], sums[mine], n)
        allowed = ~mine & ((many[c[i]] > 1) | (many[to] > 1) | (to < c[i]))
        i, to, value = i[allowed], to[allowed], (sums - k[i] * tot[to] / m2)[allowed]
        order = np.lexsort((to, -value, i))
        i, to, value = i[order], to[order], value[order]
        first = np.concatenate([[True], np.diff(i) > 0]) if len(i) else np.zeros(0, dtype=bool)
        best, gain = c.copy(), np.zeros(n)
        i, to, value = i[first], to[first], value[first]
        best[i] = to
        gain[i] = value - (w_own[i] - k[i] * (tot[c[i]] - k[i]) / m2)
        q = float((w_own[nodes] / m2 - k[nodes] * tot[c[nodes]] / m2 / m2).sum())
        current = (c, best, gain)
        if kept is None or q > best_q + 1e-12:
            kept, best_q, part = current, q, max(1, part // 2)
        else:
            part *= 2
        if part > 8 or kept is current and not (gain > none).any():
            return kept[0]
        rounds += 1
        moves = (kept[2] > none) & ((salt >> (3 * (rounds % 20))) & (part - 1) == 0)
        c = np.where(moves, kept[1], kept[0])
