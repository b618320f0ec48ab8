"""Scores of many pairs of vectors, a block of rows against a block of rows at a time.

Rows of a group are dealt to blocks by a hash of their ids, and each pair of blocks is a task's work, so a group of any size
spreads over tasks and a task holds two blocks. A row is sent once for each block that it meets, so blocks are as large as a
task holds with ease, and tasks go through them by tiles. Scores are summed in array order, component by component, as the
column expressions of ``functions.vectors`` do, so both give the same bits; which pairs are worth that, a product of matrices
of single precision says, within a bound of its rounding. Only the best or the wanted pairs leave a task.

Vectors are compared with those of their own length only; rows without a vector or a group take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, apart, ship

#: Rows of a block over all rows and of a block of pairs, and blocks to which a family of pairs is dealt before blocks get larger.
BLOCK, LARGE, SPREAD = 1024, 4096, 4
#: Rows of a block of queries within their groups, and bytes of its vectors at most; searched rows come in blocks of ``WIDE`` times as many,
#: up to ``MANY`` of them in a task.
ASKED, HELD, WIDE, MANY = 16384, 8 << 20, 4, 16
#: Rows and columns of a tile of scores in a task.
TILE, ACROSS = 256, 4096


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``a`` with all rows of ``b``, summed in the order of components."""
    out = np.zeros((len(a), len(b)))
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(0, len(a), 128):  # pieces that stay in the cache
        for j in range(0, len(b), 256):
            part = np.zeros((min(128, len(a) - i), min(256, len(b) - j)))
            product = np.empty_like(part)
            for x, y in zip(at[:, i : i + 128], bt[:, j : j + 256]):
                part += np.multiply(x[:, None], y[None, :], out=product)
            out[i : i + 128, j : j + 256] = part
    return out


def norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return np.sqrt(out)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine similarities; 0 where a norm is 0."""
    scale = norms(a)[:, None] * norms(b)[None, :]
    return np.divide(dots(a, b), scale, out=np.zeros(scale.shape), where=scale != 0)


class _Cosines:
    """Cosines of rows of ``a`` and ``b``: ``near`` of a tile, off by at most ``slack``, and the exact ones of some of its pairs.

    Where a value is not finite, or a norm is so small or large that products of norms could leave the range of doubles,
    tiles are exact and ``slack`` is 0.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.at, self.bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        with np.errstate(all="ignore"):
            self.na, self.nb = norms(a), norms(b)
        size = np.concatenate([self.na, self.nb])
        self.plain = bool(((size == 0) | ((size > 1e-100) & (size < 1e100))).all() and np.isfinite(a).all() and np.isfinite(b).all() and (size[np.concatenate([a, b]).any(axis=1)] > 0).all())
        self.kind = np.float32 if self.plain else np.float64
        # twice what unit vectors of single precision, and their products, can be off
        self.slack = 2 * (a.shape[1] + 16) * float(np.finfo(np.float32).eps) if self.plain else 0.0
        if self.plain:
            self.ua = (a / np.where(self.na > 0, self.na, 1)[:, None]).astype(np.float32)
            self.ub = np.ascontiguousarray((b / np.where(self.nb > 0, self.nb, 1)[:, None]).astype(np.float32).T)

    def near(self, rows: slice, columns=slice(None)) -> np.ndarray:
        if self.plain:
            return self.ua[rows] @ self.ub[:, columns]
        with np.errstate(all="ignore"):
            return cosines(self.a[rows], self.b[columns])

    def floor(self, least: np.ndarray) -> np.ndarray:
        """The smallest values of ``near`` that can stand for a cosine of ``least``; -inf never does."""
        return np.maximum(least - self.slack, np.finfo(self.kind).min).astype(self.kind)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            dot = np.zeros(len(x))
            with np.errstate(all="ignore"):
                for p, q in zip(self.at, self.bt):
                    dot += p[x] * q[y]
                scale = self.na[x] * self.nb[y]
                out[s : s + len(x)] = np.divide(dot, scale, out=np.zeros(len(x)), where=scale != 0)
        return out


def _places(i: np.ndarray, n: int) -> np.ndarray:
    """Places from 0 within runs of equal values of ``i``, which ascends and is under ``n``."""
    return np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i]


def _counted(b: np.ndarray, k: int) -> np.ndarray:
    """The rows of ``b`` that have fewer than ``k`` equal rows before them."""
    _, at, n = np.unique(norms(b), return_inverse=True, return_counts=True)  # equal rows have equal norms
    some = np.flatnonzero(n[at] > k)
    keep = np.ones(len(b), dtype=bool)
    if len(some) and b.shape[1]:
        _, code = np.unique(np.ascontiguousarray(b[some]).view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        keep[some[order]] = _places(code[order], code.max() + 1) < k
    return np.flatnonzero(keep)


def _best(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and cosine of the ``k`` best of each row of ``a``, best first, ties to the earlier row of ``b``;
    ``own`` is a row of ``b`` that does not count (-1: none)."""
    with np.errstate(all="ignore"):
        rows = _counted(b, k if own is None else k + 1)  # no more copies of a vector can be among the best
    if len(rows) < len(b):
        if own is not None:
            place = np.full(len(b), -1)
            place[rows] = np.arange(len(rows))
            own = np.where(own >= 0, place[own], -1)
        b = b[rows]
    pair, out = _Cosines(a, b), []
    for s in range(0, len(a), TILE):
        n = min(TILE, len(a) - s)
        mine = np.full(n, -1) if own is None else own[s : s + n]
        # the k best values so far bound the last of all from below, so later columns add few candidates
        best, found = np.full((n, k), -np.inf, dtype=pair.kind), []
        for c in range(0, len(b), ACROSS):
            value = pair.near(slice(s, s + n), slice(c, c + ACROSS))
            there = np.flatnonzero((mine >= c) & (mine < c + ACROSS))
            value[there, mine[there] - c] = -np.inf
            if not pair.plain:
                value[~np.isfinite(value)] = -np.inf
            if c == 0:
                h = min(k, value.shape[1])
                best[:, :h] = np.partition(value, value.shape[1] - h, axis=1)[:, value.shape[1] - h :]
            at = np.flatnonzero(value >= pair.floor(best.min(axis=1))[:, None])
            i, j = np.divmod(at, value.shape[1])
            near = value.ravel()[at]
            found.append((i, j + c, near))
            if c and len(i):
                more = np.full((n, np.bincount(i).max()), -np.inf, dtype=pair.kind)
                more[i, _places(i, n)] = near
                best = np.concatenate([best, more], axis=1)
                best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
            if sum(len(x[0]) for x in found) > HELD // 8:  # many values that are equal within the bound
                found = [_settled(pair, s, found, best, k)[:3]]
        i, j, _, score = _settled(pair, s, found, best, k)
        out.append((i + s, rows[j], score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _settled(pair: _Cosines, s: int, found: list, best: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row from ``s`` on, column, value and exact cosine of the ``k`` best of the candidates ``found``, best first."""
    i, j, near = (np.concatenate(x) for x in zip(*found))
    keep = near >= pair.floor(best.min(axis=1))[i]
    i, j, near = i[keep], j[keep], near[keep]
    score = pair.exact(i + s, j)
    order = np.lexsort((j, -score, i))
    order = order[_places(i[order], len(best)) < k]
    return i[order], j[order], near[order], score[order]


def _fewest(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` by differing signs."""
    out, most = [], a.shape[1] + 1
    for s in range(0, len(a), TILE):
        n, best = min(TILE, len(a) - s), None
        mine = np.full(n, -1) if own is None else own[s : s + n]
        for c in range(0, len(b), WIDE * ACROSS):
            cost = differing(a[s : s + n], b[c : c + WIDE * ACROSS]).astype(np.int64)
            there = np.flatnonzero((mine >= c) & (mine < c + cost.shape[1]))
            cost[there, mine[there] - c] = most
            code = cost * len(b) + np.arange(c, c + cost.shape[1])  # no two are equal
            best = code if best is None else np.concatenate([best, code], axis=1)
            if k < best.shape[1]:
                best = np.partition(best, k - 1, axis=1)[:, :k]
        code = np.sort(best, axis=1).ravel()
        real = code < most * len(b)
        out.append((np.repeat(np.arange(n) + s, len(code) // n)[real], code[real] % len(b), (code[real] // len(b)).astype(np.float64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs differ, from packed bits."""
    x, y = np.packbits(a > 0, axis=1), np.packbits(b > 0, axis=1)
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for p, q in zip(x.T, y.T):
        out += np.bitwise_count(p[:, None] ^ q[None, :])
    return out


def sized(rows: DataFrame, *keys: str, block: int | Column) -> DataFrame:
    """Number of blocks of each group."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))


#: Groups, and characters of their names, whose sizes are sent to every task.
FEW, NAMES = 100_000, 16 << 20


def known(sizes: DataFrame) -> DataFrame:
    """Sizes of groups, counted once: those of few groups are sent to the tasks, so that rows stay where they are until they are
    dealt to blocks; those of more are joined by shuffling both."""
    head = _listed(sizes)
    return sizes if head is None else _sent(sizes, head)


def _listed(sizes: DataFrame) -> list | None:
    """The sizes of few groups."""
    head = sizes.limit(FEW + 1).collect()
    return None if len(head) > FEW or sum(len(str(r[0])) for r in head) > NAMES else head


def _sent(sizes: DataFrame, head: list) -> DataFrame:
    return F.broadcast(sizes.sparkSession.createDataFrame(head, sizes.schema))


def _dealt(rows: DataFrame, own: str, ident: str) -> DataFrame:
    return rows.withColumn("at", F.pmod(F.xxhash64(F.col(ident)), F.col(own)).cast("int"))


def _top(k: int, hamming: bool, exclude_self: bool, block: int, held: int):
    """The best of a block of queries among the rows of a group, which follow the queries by ``dim`` and ascending id; rows are
    held a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, code, family, found = {}, None, None, None
        for (row, dim), parts in groupby(_runs(batches), key=lambda r: r[0]):
            if not row:
                asked[dim] = pa.Table.from_batches([b for _, b in parts])
                continue
            if dim not in asked:
                continue
            if code is None:
                ids = pa.chunked_array([c for t in asked.values() for c in t.column("query_id").chunks]).dictionary_encode("encode").combine_chunks()
                code, cuts = ids.indices.to_numpy(), np.cumsum([0, *(len(t) for t in asked.values())])
                code = dict(zip(asked, (code[i:j] for i, j in zip(cuts, cuts[1:]))))
                alone, family = len(ids.dictionary) == len(ids), asked[dim].column("family_id").combine_chunks().slice(0, 1)
            q = asked[dim]
            a, size = matrix(q.column("q")), WIDE * max(1, min(block, held // 8 // max(dim, 1)))
            for t in _pieces((b for _, b in parts), size):
                them = t.column("protein_id").combine_chunks()
                own = pc.fill_null(pc.index_in(q.column("query_id").combine_chunks(), them), -1).to_numpy(zero_copy_only=False) if exclude_self else None
                i, j, score = (_fewest if hamming else _best)(a, matrix(t.column("q")), k, own)
                new = code[dim][i], them.take(pa.array(j)), score
                found = new if found is None and alone else _merged(found, new, k, hamming)
        if found is not None:
            i, them, score = found
            rank = (_places(i, len(ids.dictionary)) + 1).astype(np.int32)
            yield from pa.table({"family_id": family.take(pa.array(np.zeros(len(i), dtype=np.int64))), "query_id": ids.dictionary.take(pa.array(i)), "protein_id": them, "score": pa.array(score), "rank": pa.array(rank)}).to_batches(max_chunksize=1 << 16)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Stretches of batches that are of one side (0: queries) and one ``dim``."""
    last = (0, -1)
    for b in batches:
        row, dim = b.column("row").to_numpy(), b.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(row) != 0) | (np.diff(dim) != 0)) + 1).tolist(), len(row)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                key = int(row[i]), int(dim[i])
                if key < last:
                    raise ValueError("queries must come before the rows of their group")
                last = key
                yield key, b.slice(i, j - i)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, and one of what is left."""
    have, n = [], 0
    for b in batches:
        while n + b.num_rows >= size:
            have.append(b.slice(0, size - n))
            b, n = b.slice(size - n), 0
            yield pa.Table.from_batches(have)
            have = []
        if b.num_rows:
            have.append(b)
            n += b.num_rows
    if have:
        yield pa.Table.from_batches(have)


def _merged(old: tuple | None, new: tuple, k: int, least: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The ``k`` best of each query among its best so far and new ones: query, id and score, in the order of queries and ranks."""
    both = [x for x in (old, new) if x is not None]
    i, them, score = np.concatenate([x[0] for x in both]), pa.concat_arrays([x[1] for x in both]), np.concatenate([x[2] for x in both])
    place = pc.rank(them, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((place, score if least else -score, i))
    order = order[_places(i[order], i.max() + 1 if len(i) else 0) < k]
    return i[order], them.take(pa.array(order)), score[order]


def top(queries: DataFrame, rows: DataFrame, k: int, hamming: bool = False, exclude_self: bool = False, block: int = ASKED) -> DataFrame:
    """The ``k`` best of each query (query_id, family_id, q) among the rows (protein_id, family_id, v) of its family:
    family_id, query_id, protein_id, score and rank, ties to the smaller id. The score is the cosine or the number of differing signs.
    Rows of equal query_id in one family are one query.

    A block of queries meets up to ``MANY`` blocks of rows in one task, one after another, and leaves it ranked; only where some
    family has more rows, the best of several tasks meet once again. Vectors are moved in the type that they have.
    """
    spark = rows.sparkSession
    ship(spark)
    keys = ("family_id", "dim")
    q = queries.where("q is not null and family_id is not null").select("family_id", F.size("q").alias("dim"), "query_id", "q")
    v = rows.where("v is not null and family_id is not null").select("family_id", F.size("v").alias("dim"), "protein_id", "v")
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(HELD / 8 / F.greatest("dim", F.lit(1)))))
    shares = q.groupBy(*keys).agg((F.count("*") / size).alias("qs")).join(v.groupBy(*keys).agg((F.count("*") / (size * (WIDE * MANY))).alias("vs")), [*keys])
    family = Window.partitionBy("family_id")  # a query's rows of all lengths meet in one task
    sizes = shares.select(*keys, *(F.ceil(F.sum(c).over(family)).cast("int").alias(c) for c in ("qs", "vs")))
    head = _listed(sizes)
    plan = sizes if head is None else _sent(sizes, head)
    kinds = dict(q.dtypes) | dict(v.dtypes)
    q = _dealt(q.join(plan, [*keys]), "qs", "query_id").select("family_id", F.col("at").alias("x"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("y"), F.lit(0).cast("byte").alias("row"), "dim", "query_id", F.lit(None).cast(kinds["protein_id"]).alias("protein_id"), "q")
    v = _dealt(v.join(plan, [*keys]), "vs", "protein_id").select("family_id", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("x"), F.col("at").alias("y"), F.lit(1).cast("byte").alias("row"), "dim", F.lit(None).cast(kinds["query_id"]).alias("query_id"), "protein_id", F.col("v").alias("q"))
    tasks = None if head is None else max(1, 4 * sum({r["family_id"]: r["qs"] * r["vs"] for r in head}.values()))
    group = ("family_id", "x", "y")
    met = apart(q.unionByName(v), *group, most=tasks).sortWithinPartitions(*group, "row", "dim", "protein_id")
    found = met.groupBy(*group).applyInArrow(_top(k, hamming, exclude_self, block, HELD), f"family_id {kinds['family_id']}, query_id {kinds['query_id']}, protein_id {kinds['protein_id']}, score double, rank int")
    if head is not None and all(r["vs"] == 1 for r in head):
        return found
    order = Window.partitionBy("query_id", "family_id").orderBy("score" if hamming else F.desc("score"), "protein_id")
    # tasks have left the best only, so rows are sorted where they meet and not before as well
    return found.repartition("query_id", "family_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top_of_all(k: int, per_family: bool, least: float | None, projected: bool):
    def run(key, q: pa.Table, v: pa.Table) -> pa.Table:
        asked, ids, family = q.column("query_id").combine_chunks(), v.column("protein_id"), v.column("family_id")
        rows, best, score = ([np.zeros(0, dtype=t)] for t in (np.int64, np.int64, np.float64))
        if q.num_rows and v.num_rows:
            order = pc.sort_indices(v, [("family_id", "ascending"), ("protein_id", "ascending")] if per_family else [("protein_id", "ascending")])
            v = v.take(order)
            ids, family = v.column("protein_id"), v.column("family_id")
            a, b = matrix(q.column("q")), matrix(v.column("v"))
            value = dots(a, b) / (norms(a) + 1e-8)[:, None] if projected else cosines(a, b)
            cost = -value if least is None else np.where(value >= least, -value, np.inf)
            code = pc.dictionary_encode(family, null_encoding="encode").combine_chunks().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)] if per_family else [0, len(code)]
            for i, j in zip(cuts, cuts[1:]):  # ids ascend, so a stable sort gives ties to the smaller id
                own = np.argsort(cost[:, i:j], axis=1, kind="stable")[:, :k]
                c = np.take_along_axis(cost[:, i:j], own, 1).ravel()
                real = np.isfinite(c)
                rows.append(np.repeat(np.arange(len(asked)), own.shape[1])[real])
                best.append(own.ravel()[real] + i)
                score.append(-c[real])
        rows, best, score = (np.concatenate(x) for x in (rows, best, score))
        at = pa.array(best)
        return pa.table({"query_id": asked.take(pa.array(rows)), "family_id": family.combine_chunks().take(at), "protein_id": ids.combine_chunks().take(at), "score": pa.array(score)})

    return run


def top_of_all(queries: DataFrame, rows: DataFrame, k: int, per_family: bool, least: float | None = None, projected: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` best of each query (query_id, q) among all rows (protein_id, family_id, v), or among those of each family:
    query_id, family_id, protein_id, score and rank, ties to the smaller id.

    The score is the cosine, or with ``projected`` the dot product with the query at unit length; scores under ``least`` do
    not count. Blocks of queries meet blocks of rows, whatever their families, and a task keeps the best of each only.
    """
    ship(rows.sparkSession)
    q = queries.where("q is not null").select("query_id", "q", F.size("q").alias("dim"))
    v = rows.where("v is not null").select("protein_id", "family_id", "v", F.size("v").alias("dim"))
    plan = known(sized(q, "dim", block=block).withColumnRenamed("blocks", "qs").join(sized(v, "dim", block=block).withColumnRenamed("blocks", "vs"), "dim"))
    q = _dealt(q.join(plan, "dim"), "qs", "query_id").select("dim", F.col("at").alias("x"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("y"), "query_id", "q")
    v = _dealt(v.join(plan, "dim"), "vs", "protein_id").select(F.col("dim").alias("v_dim"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("v_x"), F.col("at").alias("v_y"), F.col("protein_id").alias("protein_id"), F.col("family_id").alias("family_id"), F.col("v").alias("v"))
    kinds = dict(q.dtypes) | dict(v.dtypes)
    found = q.groupBy("dim", "x", "y").cogroup(v.groupBy("v_dim", "v_x", "v_y")).applyInArrow(_top_of_all(k, per_family, least, projected), f"query_id {kinds['query_id']}, family_id {kinds['family_id']}, protein_id {kinds['protein_id']}, score double")
    order = Window.partitionBy("query_id", *(["family_id"] if per_family else [])).orderBy(F.desc("score"), "protein_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pairs(least: float | None, balls: bool = False):
    """The wanted pairs of two blocks, tile by tile. With ``balls`` rows have the number of their ball (``bid``), and only balls
    that can reach each other are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        t = t.sort_by([("bid", "ascending"), ("protein_id", "ascending")] if balls else "protein_id")
        side = t.column("at").to_numpy()
        left = t if x == y else t.filter(pa.array(side == x))
        right = t if x == y else t.filter(pa.array(side == y))
        if not left.num_rows or not right.num_rows:
            return
        group, a, b = t.column("family_id").combine_chunks(), left.column("protein_id").combine_chunks(), right.column("protein_id").combine_chunks()
        pair = _Cosines(matrix(left.column("v")), matrix(right.column("v")))
        if balls:
            tiles = _reached(left.column("bid").to_numpy(), right.column("bid").to_numpy(), pair, least)
        else:
            tiles = ((i, np.arange(j, min(j + ACROSS, len(b)))) for i in range(0, len(a), TILE) for j in range(0, len(b), ACROSS))
            tiles = ((slice(i, min(i + TILE, len(a))), columns) for i, columns in tiles)
        for rows, columns in tiles:
            if x == y:
                columns = columns[columns > rows.start]
            if not len(columns):
                continue
            if least is None:
                value = cosines(pair.a[rows], pair.b[columns])
                wanted = np.ones(value.shape, dtype=bool)
            else:
                wanted = pair.near(rows, columns) >= least - pair.slack
            if x == y:
                wanted &= columns[None] > np.arange(rows.start, rows.stop)[:, None]
            i, j = np.nonzero(wanted)
            score = value[i, j] if least is None else pair.exact(i + rows.start, columns[j])
            i, j = i + rows.start, columns[j]
            if least is not None:
                keep = score >= least
                i, j, score = i[keep], j[keep], score[keep]
            if len(i):
                src, dst = a.take(pa.array(i)), b.take(pa.array(j))
                low = pc.less(src, dst)
                out = pa.table({"graph": group.take(pa.array(np.zeros(len(i), dtype=np.int64))), "src": pc.if_else(low, src, dst), "dst": pc.if_else(low, dst, src), "weight": pa.array(score)})
                yield from out.filter(pc.not_equal(src, dst)).to_batches()

    return run


def _reached(left: np.ndarray, right: np.ndarray, pair: _Cosines, least: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of each ball of the left side, and those of the right side whose balls are in reach of it."""
    cuts = [np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) for x in (left, right)]
    a, b = ([_around(m[i:j]) for i, j in zip(c, c[1:])] for m, c in ((pair.a, cuts[0]), (pair.b, cuts[1])))
    cosine = np.stack([c for c, _ in a]) @ np.stack([c for c, _ in b]).T
    gap = np.arccos(np.clip(cosine, -1, 1)) - np.array([r for _, r in a])[:, None] - np.array([r for _, r in b])[None]
    reach = np.cos(np.maximum(0, gap - 1e-6)) >= least
    reach |= ~np.isfinite(gap)
    of = np.repeat(np.arange(len(b)), np.diff(cuts[1]))
    for n, (i, j) in enumerate(zip(cuts[0], cuts[0][1:])):
        columns = np.flatnonzero(reach[n][of])
        for s in range(i, j, TILE):
            for c in range(0, len(columns), ACROSS):
                yield slice(s, min(s + TILE, j)), columns[c : c + ACROSS]


def pairs(rows: DataFrame, least: float | None = None, block: int = LARGE) -> DataFrame:
    """Cosines of all pairs src < dst within a family, or of those of at least ``least``: graph, src, dst, weight.

    A row is sent once for each block of its family: small families have up to ``SPREAD`` blocks of ``block`` rows, so that their
    pairs are several tasks' work, and large ones have blocks of up to ``WIDE`` times as many rows, of ``HELD`` bytes. Vectors are
    moved in the type that they have.
    """
    ship(rows.sparkSession)
    v = rows.where("v is not null and family_id is not null").select("protein_id", "family_id", "v", F.size("v").alias("dim"))
    return _met(v, "protein_id", block, _pairs(least))


def _met(v: DataFrame, ident: str, block: int, run, *more: str) -> DataFrame:
    """``run`` on every pair of the blocks to which rows are dealt by ``ident``."""
    keys = ("family_id", "dim")
    wide = F.greatest(F.lit(block), F.least(F.lit(WIDE * block), F.floor(HELD / 8 / F.greatest("dim", F.lit(1)))))
    blocks = F.greatest(F.ceil(F.count("*") / wide), F.least(F.ceil(F.count("*") / block), F.lit(SPREAD)))
    sizes = v.groupBy(*keys).agg(blocks.cast("int").alias("blocks"))
    head = _listed(sizes)
    tasks = None if head is None else max(1, 4 * sum(r["blocks"] * (r["blocks"] + 1) // 2 for r in head))
    v = _dealt(v.join(sizes if head is None else _sent(sizes, head), [*keys]), "blocks", ident)
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select("family_id", "dim", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", "protein_id", "v", *more)
    kinds, group = dict(v.dtypes), ("family_id", "dim", "x", "y")
    return apart(v, *group, most=tasks).groupBy(*group).applyInArrow(run, f"graph {kinds['family_id']}, src {kinds['protein_id']}, dst {kinds['protein_id']}, weight double")


def _around(v: np.ndarray) -> tuple[np.ndarray, float]:
    """The unit mean of directions and the widest angle from it to any of them."""
    v = v / norms(v)[:, None]
    mean = v.sum(axis=0)
    size = float(np.sqrt(mean @ mean))
    center = mean / size if size > 0 else v[0]
    return center, float(np.arccos(np.clip(v @ center, -1, 1)).max())


def _ball(t: pa.Table) -> pa.Table:
    center, radius = _around(matrix(t.column("v")))
    return pa.table({"family_id": t.column("family_id").slice(0, 1), "dim": t.column("dim").slice(0, 1), "bid": t.column("bid").slice(0, 1), "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})


def near_pairs(rows: DataFrame, least: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``pairs`` of at least ``least`` (over 0), and per family how many pairs of blocks there are and how many were compared.

    Rows are dealt to blocks by their nearest pivot, a row in ``block`` being one by a hash of its id, so that blocks are
    narrow where vectors lie close. No cosine of two blocks is larger than that of the angle between their means less both
    radii, so pairs of blocks that cannot reach ``least`` are not compared. Whole blocks are dealt to parts of about ``LARGE``
    rows, and rows are moved for pairs of parts, so a row moves no more often for smaller blocks. Vectors without a direction
    are in no pair.
    """
    if least <= 0:
        raise ValueError("pairs of any angle are in reach of a threshold that is not over 0")
    ship(rows.sparkSession)
    work = Scratch(rows.sparkSession, "near")
    keys = ("family_id", "dim")
    v = rows.where("v is not null and family_id is not null").where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0)
    v = v.select("protein_id", "family_id", "v", F.size("v").alias("dim"), F.xxhash64("protein_id").alias("hash"))
    sizes = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("hash").alias("first"))
    marked = v.join(sizes, [*keys]).where(((F.col("hash") / 2.0**64 + 0.5) * F.col("n") <= F.ceil(F.col("n") / block)) | (F.col("hash") == F.col("first")))
    pivots = work.table(marked.select("protein_id", "family_id", "v"), "pivots")
    cells = work.table(top(v.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q")), pivots, 1).select(F.col("query_id").alias("protein_id"), "family_id", F.col("protein_id").alias("cell")), "cells")
    many = cells.groupBy("family_id", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = cells.join(many, ["family_id", "cell"]).select("family_id", "protein_id", F.xxhash64("family_id", "cell", F.pmod(F.xxhash64("protein_id"), F.col("parts"))).alias("bid"))
    placed = work.table(v.drop("hash").join(dealt, ["family_id", "protein_id"]), "placed")
    kinds = dict(placed.dtypes)
    balls = placed.groupBy(*keys, "bid").applyInArrow(_ball, f"family_id {kinds['family_id']}, dim int, bid long, center array<double>, radius double")
    other = balls.select(*(F.col(c).alias(c) for c in keys), F.col("bid").alias("y"), F.col("center").alias("far"), F.col("radius").alias("far_radius"))
    met = balls.withColumnRenamed("bid", "x").join(other, [*keys]).where("x <= y")
    cosine = F.aggregate(F.zip_with("center", "far", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius") - F.col("far_radius")
    reach = (F.col("x") == F.col("y")) | (F.cos(F.greatest(F.lit(0.0), gap - 1e-6)) >= least)
    judged = met.select(*keys, reach.alias("reach"))  # for the report alone
    found = _met(placed, "bid", LARGE, _pairs(least, balls=True), "bid")
    report = judged.groupBy("family_id").agg(F.count("*").alias("block_pairs"), F.count_if("reach").alias("compared"))
    return found, report
