"""Similarity graphs: nodes (graph, id) and undirected edges (graph, src, dst, weight) with src < dst.

Every graph is one group of proteins (a family or a search result). Edges are joins and ranking windows, and so are the
measures of ``networks``, in tasks for graphs that fit them; layouts, trimming and Ward clustering take one graph or group into a task.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, apart, ship
from . import blocks
from . import graphs_in_tasks as T
from .networks import centralities, communities, eigenvector, path_lengths, path_sketch  # noqa: F401  graph measures of any size


def pair_scores(rows: DataFrame) -> DataFrame:
    """Cosine of all pairs src < dst within each group (family_id): the base of every graph."""
    return blocks.pairs(rows)


def edges_over(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The pairs of at least ``threshold``, without the others ever leaving a task."""
    return blocks.pairs(rows, threshold)


def nearest(rows: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` nearest of each node of its group: graph, src, dst, weight, rank; only those leave a task."""
    asked = rows.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    near = blocks.top(asked, rows, k, exclude_self=True)
    return near.select(F.col("family_id").alias("graph"), F.col("query_id").alias("src"), F.col("protein_id").alias("dst"), F.col("score").alias("weight"), "rank")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()


def knn(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` nearest of each node: graph, src, dst, weight, rank."""
    order = Window.partitionBy("graph", "src").orderBy(F.desc("weight"), "dst")
    return both_ways(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual_knn(pairs: DataFrame, k: int = 8, threshold: float = 0.1) -> DataFrame:
    """Edges whose ends are each among the other's ``k`` nearest."""
    return mutual(knn(pairs, k), threshold)


def mutual(near: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The edges that both directions of a table of neighbours give."""
    near = near.where(F.col("weight") >= threshold)
    return near.groupBy("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"), F.count("*").alias("n")).where("n = 2").drop("n")


def hybrid(pairs: DataFrame, k: int = 8, threshold: float = 0.1) -> DataFrame:
    return either(knn(pairs, k), threshold)


def either(near: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The edges that some direction of a table of neighbours gives."""
    return undirected(near.where(F.col("weight") >= threshold).drop("rank"))


def threshold_edges(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    return pairs.where(F.col("weight") >= threshold)


def robust(pairs: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Top ``k`` of each node among neighbours at the threshold; a node without any keeps its top ``k`` all the same."""
    return robust_of(knn(pairs, k), threshold)


def robust_of(near: DataFrame, threshold: float = 0.5) -> DataFrame:
    # ranks fall with the weight, so a node's eligible neighbours come first; the first decides whether there are any
    first = F.max("weight").over(Window.partitionBy("src", "graph"))
    return undirected(near.withColumn("first", first).where((F.col("weight") >= threshold) | (F.col("first") < threshold)).drop("rank", "first"))


def build(rows: DataFrame, method: str = "mutual_knn", k: int = 8, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each family's graph by the named method."""
    methods = {"mutual_knn": lambda: mutual(nearest(rows, k), threshold), "threshold": lambda: edges_over(rows, threshold), "hybrid": lambda: either(nearest(rows, k), threshold), "robust": lambda: robust_of(nearest(rows, k), threshold)}
    if method not in methods:
        raise ValueError(f"unknown network method {method!r}; known: {', '.join(methods)}")
    return rows.select(F.col("family_id").alias("graph"), F.col("protein_id").alias("id")), methods[method]()


def properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, density, average degree, mean clustering, components, and of the largest component its size,
    average path and diameter (null where a graph has no edges)."""
    parts = components(nodes, edges).groupBy("graph").agg(F.countDistinct("component").alias("n_components"))
    mean = clustering(nodes, edges).groupBy("graph").agg(F.avg("clustering").alias("avg_clustering"))
    return density(nodes, edges).join(mean, "graph").join(parts, "graph").join(path_lengths(edges), "graph", "left")


def members(matches: DataFrame, rows: DataFrame, least: int = 50) -> DataFrame:
    """Rows of each query's graph: (family_id: the query, protein_id, v) of its matches among ``rows``; a query of which no match
    is among them gets the first ``least`` rows by id instead."""
    found = matches.select(F.col("query_id").alias("family_id"), "protein_id").join(rows.select("protein_id", "v"), "protein_id").select("family_id", "protein_id", "v")
    lone = matches.select(F.col("query_id").alias("family_id")).distinct().join(found.select("family_id").distinct(), "family_id", "left_anti")
    first = rows.select("protein_id", "v").orderBy("protein_id").limit(least)
    return found.unionByName(lone.crossJoin(F.broadcast(first)).select("family_id", "protein_id", "v"))


def lowered(threshold: float) -> float:
    """The last of ``threshold`` * 0.9**m that ends at or below 0.01."""
    while threshold > 0.01:
        threshold *= 0.9
    return threshold


def expand(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, threshold: float = 0.1, least: int = 5) -> DataFrame:
    """Graphs of fewer than ``least`` nodes also get all pairs down to the ``lowered`` threshold."""
    small = nodes.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") < least).select("graph")
    return edges.unionByName(pairs.where(F.col("weight") >= lowered(threshold)).join(small, "graph", "left_semi")).distinct()


def expand_rows(edges: DataFrame, rows: DataFrame, threshold: float = 0.1, least: int = 5) -> DataFrame:
    """``expand`` from vectors (family_id, protein_id, v): only those of small graphs are compared."""
    small = rows.groupBy("family_id").agg(F.count("*").alias("n")).where(F.col("n") < least).select("family_id")
    return edges.unionByName(edges_over(rows.join(small, "family_id", "left_semi"), lowered(threshold))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, 0 for lone ones."""
    d = edges.select("graph", F.explode(F.array("src", "dst")).alias("id")).groupBy("graph", "id").agg(F.count("*").alias("degree"))
    return nodes.join(d, ["graph", "id"], "left").select("graph", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, density and average degree."""
    n = nodes.groupBy("graph").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("graph").agg(F.count("*").alias("n_edges"))
    out = n.join(e, "graph", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    full = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return out.withColumn("density", F.when(full > 0, 2.0 * F.col("n_edges") / full).otherwise(0.0)).withColumn("avg_degree", 2.0 * F.col("n_edges") / F.col("n_nodes"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles at each node: for every edge the common entries of its ends' lists of neighbours.

    Edges point from the end of lower degree to the other (of equal degrees to the larger id), so no list is longer than
    the square root of twice the edges, a hub's list is short, and no row stands for a pair of a hub's neighbours.
    """
    e = edges.where("src <> dst").select("graph", "src", "dst")
    degree = both_ways(e.withColumn("weight", F.lit(0.0))).groupBy("graph", F.col("src").alias("id")).agg(F.count("*").alias("d"))
    of = lambda end: degree.select("graph", F.col("id").alias(end), F.col("d").alias(f"d_{end}"))
    known = e.join(of("src"), ["graph", "src"]).join(of("dst"), ["graph", "dst"])
    up = F.struct("d_src", "src") < F.struct(F.col("d_dst").alias("d_src"), F.col("dst").alias("src"))
    pointed = known.select("graph", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    lists = pointed.groupBy("graph", "a").agg(F.collect_set("b").alias("next"))
    both = pointed.join(lists, ["graph", "a"]).join(lists.select("graph", F.col("a").alias("b"), F.col("next").alias("far")), ["graph", "b"])
    found = both.select("graph", "a", "b", F.explode(F.array_intersect("next", "far")).alias("c"))
    return found.select("graph", F.explode(F.array("a", "b", "c")).alias("id")).groupBy("graph", "id").agg(F.count("*").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node."""
    out = degrees(nodes, edges).join(triangles(edges), ["graph", "id"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    d = F.col("degree")
    return out.withColumn("clustering", F.when(d > 1, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(0.0))


def trim_to_query(nodes: DataFrame, edges: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Nodes kept of graphs with more than ``most``: the query and its neighbours, then the others of highest degree."""
    d = degrees(nodes, edges).join(queries.select("graph", "query_id"), "graph")
    near = both_ways(edges).join(queries.select("graph", F.col("query_id").alias("src")), ["graph", "src"], "left_semi").select("graph", F.col("dst").alias("id")).distinct().withColumn("near", F.lit(1))
    d = d.join(near, ["graph", "id"], "left").withColumn("tier", F.when(F.col("id") == F.col("query_id"), 2).otherwise(F.coalesce("near", F.lit(0))))
    order = Window.partitionBy("graph").orderBy(F.desc("tier"), F.desc("degree"), "id")
    # a limit on the place alone lets tasks cut a large graph before its rows meet
    others = d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where("tier = 0").drop("place")
    return d.where("tier > 0").unionByName(others).select("graph", "id", "degree", "tier")


def valid_nodes(nodes: DataFrame, col: str = "id") -> DataFrame:
    """Nodes whose id is neither null nor blank nor a written NaN."""
    text = F.trim(F.col(col).cast("string"))
    return nodes.where(F.col(col).isNotNull() & (text != "") & (F.lower(text) != "nan"))


def modularity(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph the number of communities (graph, id, component), their modularity over unweighted edges and the edges."""
    of = lambda side: parts.select("graph", F.col("id").alias(side), F.col("component").alias(f"{side}_part"))
    known = edges.join(of("src"), ["graph", "src"]).join(of("dst"), ["graph", "dst"])
    inside = known.where("src_part = dst_part").groupBy("graph", F.col("src_part").alias("component")).agg(F.count("*").alias("inner"))
    ends = known.select("graph", F.explode(F.array("src_part", "dst_part")).alias("component")).groupBy("graph", "component").agg(F.count("*").alias("ends"))
    m = edges.groupBy("graph").agg(F.count("*").alias("n_edges"))
    each = ends.join(inside, ["graph", "component"], "left").join(m, "graph")
    share = F.coalesce("inner", F.lit(0)) / F.col("n_edges") - F.pow(F.col("ends") / (2 * F.col("n_edges")), F.lit(2))
    scored = each.groupBy("graph").agg(F.sum(share).alias("modularity"))
    count = parts.groupBy("graph").agg(F.countDistinct("component").alias("n_communities"))
    return count.join(scored, "graph", "left").join(m, "graph", "left").select("graph", "n_communities", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def node_payload(nodes: DataFrame, edges: DataFrame, parts: DataFrame, queries: DataFrame, similarity: DataFrame, metadata: DataFrame) -> DataFrame:
    """What a plot shows of each node: id, six fields of metadata, component and its size, degree, whether it is the query and
    the similarity to it; with its class (query, connected to it, other), colour, symbol and size.

    ``queries`` is (graph, query_id), ``similarity`` (graph, id, similarity), ``metadata`` (id, name, organism, ec, function,
    family, reviewed).
    """
    sizes = parts.groupBy("graph", "component").agg(F.count("*").alias("component_size"))
    near = both_ways(edges).join(queries.select("graph", F.col("query_id").alias("src")), ["graph", "src"], "left_semi").select("graph", F.col("dst").alias("id")).distinct().withColumn("near", F.lit(True))
    out = degrees(nodes, edges).join(parts, ["graph", "id"], "left").join(sizes, ["graph", "component"], "left").join(queries, "graph", "left")
    out = out.join(near, ["graph", "id"], "left").join(similarity, ["graph", "id"], "left").join(metadata.withColumn("known", F.lit(True)), "id", "left")
    is_query = F.coalesce(F.col("id") == F.col("query_id"), F.lit(False))
    kind = F.when(is_query, "query").when(F.col("near"), "connected").otherwise("other")
    name = F.when(is_query, "Query Protein").when(F.col("known").isNull(), F.concat(F.lit("Protein "), F.col("id").cast("string"))).otherwise(F.col("name"))
    function = F.when(is_query, "Query protein - no metadata available").when(F.col("known").isNull(), "No metadata available").otherwise(F.col("function"))
    fields = [F.when(is_query, "N/A").otherwise(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A"))).alias(c) for c in ("organism", "ec", "family", "reviewed")]
    style = [F.when(kind == "query", q).when(kind == "connected", c).otherwise(o).alias(n) for n, q, c, o in (("color", "red", "red", "#CCCCCC"), ("symbol", "star", "circle", "circle"), ("marker_size", 12, 8, 6))]
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    return out.select("graph", "id", shown(name).alias("name"), shown(function).alias("function"), *fields, "component", F.coalesce("component_size", F.lit(1)).alias("component_size"), "degree", is_query.alias("is_query"), F.when(is_query, 1.0).otherwise(F.col("similarity")).alias("similarity"), kind.alias("class"), *style)


#: The share of its energy that the last step of a layout by rows takes off at most.
SETTLED = 1e-5
#: Nodes of a graph that is laid out in memory (a few matrices of nodes x nodes, some 1 GB), rows of a group that is clustered
#: (memory in proportion to the rows, time to their square) and rows up to which that is done by a table of all distances.
WHOLE, CLUSTERED, TABLE = 5_000, 1_000_000, 2_000


def _adjacency(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    if len(ids) > WHOLE:
        raise ValueError(f"a graph of {len(ids)} nodes is too large for one task; the limit is {WHOLE}")
    a = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, pdf["src"].to_numpy()), np.searchsorted(ids, pdf["dst"].to_numpy())
    real = i != j
    a[i[real], j[real]] = a[j[real], i[real]] = pdf["weight"].to_numpy()[real]
    return ids, a


def _distances(a: np.ndarray) -> np.ndarray:
    """Lengths of the shortest paths between all nodes, from all at once along the edges, until none gets shorter."""
    n = len(a)
    frm, to = np.nonzero(a.T != 0)[::-1]
    length = np.maximum(0.1, 1 - a[frm, to])
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    if not len(to):
        return d
    starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
    ends, width = to[starts], max(1, (16 << 20) // len(to))
    for s in range(0, n, width):
        part = d[:, s : s + width].copy()
        while True:
            step = part[frm]
            step += length[:, None]
            new = np.minimum(part[ends], np.minimum.reduceat(step, starts, axis=0))
            if np.array_equal(new, part[ends]):
                break
            part[ends] = new
        d[:, s : s + width] = part
    return d


def _layout(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places in the plane whose distances come near to the weighted path lengths (Kamada and Kawai's energy), by majorisation."""
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    if len(ids) > WHOLE:
        return _placed(pdf["graph"].iloc[0], ids, _places_by_rows(pdf, ids))
    ids, a = _adjacency(pdf)
    n = len(ids)
    d = _distances(a)
    far = d[np.isfinite(d)].max(initial=1.0)
    d[~np.isfinite(d)] = 2 * far
    w = np.divide(1.0, d**2, out=np.zeros(d.shape), where=d > 0)
    angle = 2 * np.pi * np.arange(n) / max(1, n)
    x = far * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    pull = np.multiply(w, d, out=d)
    # all nodes pull at each other, so only the even vector is lost, and the inverse without it is the pseudoinverse
    v = np.diag(w.sum(axis=1)) - w
    del w
    back = np.linalg.inv(v + 1 / n) - 1 / n
    del v
    rows = max(1, (1 << 15) // max(1, n))  # that stay in the cache
    for _ in range(1000):
        b = np.empty_like(x)
        for s in range(0, n, rows):
            part = x[s : s + rows]
            gap = part[:, 0, None] - x[None, :, 0]
            other = part[:, 1, None] - x[None, :, 1]
            np.multiply(gap, gap, out=gap)
            gap += np.multiply(other, other, out=other)
            np.sqrt(gap, out=gap)
            other.fill(0)
            np.divide(pull[s : s + rows], gap, out=other, where=gap > 1e-12)
            b[s : s + rows] = other.sum(axis=1)[:, None] * part - other @ x
        new = back @ b
        done = np.abs(new - x).max(initial=0) < 1e-7
        x = new
        if done:
            break
    return _placed(pdf["graph"].iloc[0], ids, x)


def _placed(graph, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    x = x - x.mean(axis=0)
    x /= np.abs(x).max(initial=0) or 1
    return pd.DataFrame({"graph": graph, "id": ids, "x": x[:, 0], "y": x[:, 1]})


def _places_by_rows(pdf: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """Places of nodes by the energy of all pairs, of which a task holds a few rows at a time.

    Path lengths of all pairs go to a file of the task's own temporary folder, in single precision, and a step reads them once. A step
    moves each node to the best place by its own majorised energy; as twice the diagonal is over the whole matrix of weights, no
    step adds energy. It ends when a step takes off less than ``SETTLED`` of it.
    """
    i, j = (np.searchsorted(ids, pdf[c].to_numpy()) for c in ("src", "dst"))
    real = (i != j) & (pdf["weight"].to_numpy() != 0)
    length = np.maximum(0.1, 1 - pdf["weight"].to_numpy()[real])
    lone = np.setdiff1d(np.arange(len(ids)), np.concatenate([i[real], j[real]]))  # they keep their place by a link of no use
    near = T.Near(T.Links(pa.table({"src": np.concatenate([i[real], lone]), "dst": np.concatenate([j[real], lone]), "w": np.concatenate([length, np.full(len(lone), np.inf)])})))
    n, far = len(ids), 0.0
    rows = max(1, (1 << 17) // n)
    parts = [(s, min(s + rows, n)) for s in range(0, n, rows)]
    with tempfile.TemporaryFile() as file:

        def read(s: int, e: int) -> np.ndarray:
            file.seek(4 * n * s)
            return np.frombuffer(bytearray(file.read(4 * n * (e - s))), dtype=np.float32).reshape(e - s, n)

        for s in range(0, n, 64):
            d = near.distances(np.arange(s, min(s + 64, n)))
            far = max(far, d[np.isfinite(d)].max(initial=0))
            file.write(np.ascontiguousarray(d.T, dtype=np.float32))
        far = far or 1.0
        total = np.empty(n)
        for s, e in parts:  # from here on the file holds the pulls: weights times lengths
            pull = read(s, e)
            pull[np.isinf(pull)] = 2 * far
            np.divide(1, pull, out=pull, where=pull > 0)
            file.seek(4 * n * s)
            file.write(pull)
            total[s:e] = np.square(pull).sum(axis=1, dtype=np.float64)
        angle = 2 * np.pi * near.order / n
        x, before = far * np.stack([np.cos(angle), np.sin(angle)], axis=1), np.inf
        for _ in range(1000):
            at, aim, mean = x.astype(np.float32), np.empty_like(x), np.empty_like(x)
            across, up = np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])
            for s, e in parts:
                pull, a, b = read(s, e), across[s:e, None] - across, up[s:e, None] - up
                gap = a * a
                gap += b * b
                np.sqrt(gap, out=gap)
                np.maximum(gap, 1e-12, out=gap)
                np.divide(pull, gap, out=gap)
                aim[s:e, 0], aim[s:e, 1] = np.einsum("ij,ij->i", gap, a), np.einsum("ij,ij->i", gap, b)
                mean[s:e] = np.multiply(pull, pull, out=pull) @ at
            held = total[:, None] * x - mean
            energy = n * (n - 1) - 4 * (x * aim).sum() + 2 * (x * held).sum()
            if before - energy <= SETTLED * abs(energy):
                break
            x, before = x + (aim - held) / total[:, None], energy
    out = np.empty_like(x)
    out[near.order] = x
    return out


def layout(edges: DataFrame) -> DataFrame:
    """Places (graph, id, x, y) from -1 to 1 of all nodes with edges; an edge's length is max(0.1, 1 - weight). A graph is one
    task's work, in memory or, of more than ``WHOLE`` nodes, row by row from a file of 4 bytes for each pair of nodes."""
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)
    return apart(edges.select("graph", "src", "dst", "weight"), "graph").groupBy("graph").applyInPandas(_layout, f"graph {kind['graph']}, id {kind['src']}, x double, y double")


def _trim(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        ids = np.unique(np.concatenate([src, dst]))
        n, i, j = len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst)
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        real = np.tile(pdf["weight"].to_numpy() != 0, 2) & (i != j)
        pair = np.unique((i * n + j)[real])
        near, cuts = (pair % n).tolist(), np.searchsorted(pair // n, np.arange(n + 1)).tolist()
        degree = np.diff(cuts).tolist()
        heap = [d * n + v for v, d in enumerate(degree)]  # the least degree, then the smallest id
        heapq.heapify(heap)
        alive, left = np.ones(n, dtype=bool), n
        while left > most:
            d, v = divmod(heapq.heappop(heap), n)
            if not alive[v] or d != degree[v]:
                continue
            alive[v], left = False, left - 1
            for u in near[cuts[v] : cuts[v + 1]]:
                if alive[u]:
                    degree[u] -= 1
                    heapq.heappush(heap, degree[u] * n + u)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "id": ids[alive]})

    return run


def trim(edges: DataFrame, most: int = 100) -> DataFrame:
    """Nodes left when nodes of the least degree go one by one until at most ``most`` remain. As each removal decides the next,
    a graph is one task's work, which holds its links and takes time in proportion to them."""
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)
    return apart(edges.select("graph", "src", "dst", "weight"), "graph").groupBy("graph").applyInPandas(_trim(most), f"graph {kind['graph']}, id {kind['src']}")


def _roots(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(graph, id, root): every end of an edge with the id it comes to by going on to the smallest neighbour that is smaller."""
    low = both_ways(edges).groupBy("graph", F.col("src").alias("id")).agg(F.min("dst").alias("dst"))
    hook = work.table(low.select("graph", "id", F.least("id", "dst").alias("root")), f"{name}-0")
    step = 0
    while True:  # ways double, so a path of n nodes takes log n steps
        further = hook.select("graph", F.col("id").alias("root"), F.col("root").alias("next"))
        step += 1
        far = work.table(hook.join(further, ["graph", "root"]).select("graph", "id", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), f"{name}-{step}")
        hook = far.select("graph", "id", "root")
        if far.where("moved").isEmpty():
            return hook


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, component): the smallest id that edges lead to.

    Each round hooks nodes to roots and relabels the edges by them; edges inside a component vanish and the others join at
    least every second root to another, so the edge table shrinks until it is empty.
    """
    work = Scratch(nodes.sparkSession, "components")
    left = work.table(edges.where("src <> dst").select("graph", "src", "dst", F.lit(0.0).alias("weight")), "edges-0")
    labels, hook, i = None, _roots(left, work, "roots-0"), 0
    while True:
        i += 1
        if labels is None:
            labels = hook
        else:
            labels = labels.join(hook.select("graph", F.col("id").alias("root"), F.col("root").alias("next")), ["graph", "root"], "left")
            labels = work.table(labels.select("graph", "id", F.coalesce("next", "root").alias("root")), f"labels-{i}")
        a = hook.select("graph", F.col("id").alias("src"), F.col("root").alias("a"))
        b = hook.select("graph", F.col("id").alias("dst"), F.col("root").alias("b"))
        left = left.join(a, ["graph", "src"]).join(b, ["graph", "dst"]).where("a <> b")
        left = work.table(left.select("graph", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight").distinct(), f"edges-{i}")
        if left.isEmpty():
            return nodes.join(labels, ["graph", "id"], "left").select("graph", "id", F.coalesce("root", "id").alias("component"))
        hook = _roots(left, work, f"roots-{i}")


def ward(points: np.ndarray, clusters: int) -> np.ndarray:
    """Agglomerative clustering by Ward's criterion (Lance-Williams updates); labels from 0 in the order of first members."""
    if not len(points):
        return np.zeros(0, dtype=int)
    if len(points) > TABLE:
        return ward_by_chains(points, clusters)
    size = (points * points).sum(axis=1)
    return ward_from_distances(np.sqrt(np.maximum(0, size[:, None] + size[None] - 2 * points @ points.T)), clusters)


def ward_from_distances(dist: np.ndarray, clusters: int) -> np.ndarray:
    n = len(dist)
    d, size, label = dist.astype(float) ** 2, np.ones(n), np.arange(n)
    alive = np.ones(n, dtype=bool)
    np.fill_diagonal(d, np.inf)
    for _ in range(max(0, n - clusters)):
        i, j = divmod(int(np.where(alive[:, None] & alive[None], d, np.inf).argmin()), n)
        i, j = min(i, j), max(i, j)
        k = alive.copy()
        k[[i, j]] = False
        total = size[i] + size[j] + size[k]
        d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / total
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def ward_by_chains(points: np.ndarray, clusters: int) -> np.ndarray:
    """``ward`` by chains of nearest neighbours: Ward's distance follows from sizes and centres, so there is no table of
    distances. A chain goes on to the nearest cluster until two are nearest to each other and merge; those merges in the order
    of their distances are the ones of the greedy rule. Equal points merge first."""
    n = len(points)
    center, first, equal, size = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
    equal = equal.ravel()
    if len(center) < clusters:
        center, first, equal, size = points, np.arange(n), np.arange(n), np.ones(n)
    center, size, name = center - center.mean(axis=0), size.astype(float), np.arange(len(center))
    square = (center * center).sum(axis=1)
    merges, chain, gone = [], [], 0
    while len(merges) < len(first) - 1:
        if gone * 2 > len(name):  # those that are gone leave the arrays
            alive = size > 0
            place = np.cumsum(alive) - 1
            chain = [(int(place[c]), d) for c, d in chain]
            center, size, square, name, gone = center[alive], size[alive], square[alive], name[alive], 0
        if not chain:
            chain = [(int(np.argmax(size > 0)), np.inf)]
        a, before = chain[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.maximum(0, square + square[a] - 2 * (center @ center[a])) * (size * size[a] / (size + size[a]))
        far[size == 0] = np.inf
        far[a] = np.inf
        b = int(far.argmin())
        if far[b] < before * (1 - 1e-12):
            chain.append((b, float(far[b])))
            continue
        b = chain[-2][0]
        del chain[-2:]
        merges.append((before, int(name[a]), int(name[b])))
        total = size[a] + size[b]
        center[b] = (size[a] * center[a] + size[b] * center[b]) / total
        square[b], size[b], size[a], gone = center[b] @ center[b], total, 0.0, gone + 1
    root = list(range(len(first)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, len(first) - clusters)]:
        root[find(a)] = find(b)
    label = np.array([find(x) for x in range(len(first))])[equal]
    least = np.full(len(first), n)
    np.minimum.at(least, label, np.arange(n))
    return np.unique(least[label], return_inverse=True)[1]


def match_clusters(rows: DataFrame, clusters: int = 5) -> DataFrame:
    """Ward clusters of each group's vectors: graph, id, cluster; groups of one row get none, and groups of more than
    ``CLUSTERED`` rows, which would take one task days, are refused before any row is gathered."""
    most = rows.groupBy("family_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    if most > CLUSTERED:
        raise ValueError(f"a group of {most} rows is too large for one task; the limit is {CLUSTERED}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("protein_id")
        if len(pdf) < 2:
            return pd.DataFrame({"graph": [], "id": [], "cluster": []})
        return pd.DataFrame({"graph": pdf["family_id"], "id": pdf["protein_id"], "cluster": ward(np.stack(pdf["v"].to_numpy()), min(clusters, len(pdf)))})

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)
    return apart(rows, "family_id").groupBy("family_id").applyInPandas(run, f"graph {kind['family_id']}, id {kind['protein_id']}, cluster int")
