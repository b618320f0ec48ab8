"""Graph measures against dense and brute-force versions."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from helixframe import service
from helixframe.operators import graph as G
from helixframe.operators import networks as N

EDGES = "graph string, src long, dst long, weight double"


def dense(pairs):
    """Per node betweenness, closeness, eigenvector and eccentricity, and all distances, from matrices."""
    ids = sorted({v for p in pairs for v in p})
    n, at = len(ids), {v: i for i, v in enumerate(ids)}
    a = np.zeros((n, n))
    for x, y in pairs:
        a[at[x], at[y]] = a[at[y], at[x]] = x != y
    dist, paths, front = np.where(np.eye(n) > 0, 0.0, np.inf), np.eye(n), np.eye(n)
    for step in range(1, n):
        front = np.where(np.isinf(dist), front @ a, 0.0)
        dist[front > 0] = step
        paths += front
    between = np.zeros(n)
    for v in range(n):
        on = np.isfinite(dist) & (dist[:, v, None] + dist[None, v, :] == dist)
        on[v, :] = on[:, v] = False
        np.fill_diagonal(on, False)
        between[v] = np.where(on, paths[:, v, None] * paths[None, v, :] / np.maximum(paths, 1), 0).sum() / max(1, (n - 1) * (n - 2))
    near = np.where(np.isfinite(dist), dist, 0)
    seen = (near > 0).sum(axis=1)
    close = np.divide(seen * seen, near.sum(axis=1) * max(1, n - 1), out=np.zeros(n), where=seen > 0)
    main = np.abs(np.linalg.eigh(a)[1][:, -1])
    return ids, between, close, main, near.max(axis=1), dist


def random_graph(seed, n, degree):
    rng = np.random.default_rng(seed)
    return sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, n, size=(n * degree // 2, 2)) if p[0] != p[1]})


def frame(spark, **graphs):
    return spark.createDataFrame([(g, x, y, 1.0) for g, pairs in graphs.items() for x, y in pairs], EDGES).repartition(3)


def test_centralities_and_paths_are_the_dense_ones(spark):
    graphs = {"random": random_graph(1, 80, 5), "path": [(i, i + 1) for i in range(9)], "star": [(7, i) for i in range(8, 15)], "two": [(1, 2), (2, 3), (1, 3), (10, 11)], "twice": [(1, 2), (2, 1), (1, 2), (2, 2), (2, 3)]}
    edges = frame(spark, **graphs)
    got = defaultdict(dict)
    for r in N.centralities(edges).collect():
        got[r["graph"]][r["id"]] = r
    # blocks of sources change nothing
    blocks = {(r["graph"], r["id"]): r["betweenness"] for r in N.centralities(frame(spark, random=graphs["random"]), state_rows=2500).collect()}
    for g, pairs in graphs.items():
        ids, between, close, main, far, dist = dense(pairs)
        assert sorted(got[g]) == ids
        for i, v in enumerate(ids):
            r = got[g][v]
            assert (r["betweenness"], r["closeness"], r["eccentricity"]) == (pytest.approx(between[i]), pytest.approx(close[i]), far[i])
            assert r["eigenvector"] == pytest.approx(main[i], abs=1e-5)
            assert g != "random" or blocks[g, v] == pytest.approx(between[i])
        path = {r["graph"]: r for r in N.path_lengths(edges).collect()}[g] if g != "random" else N.path_lengths(frame(spark, random=pairs), state_rows=2000).head()
        parts = np.isfinite(dist).sum(axis=1)
        inner = dist[np.ix_(np.isfinite(dist[parts.argmax()]), np.isfinite(dist[parts.argmax()]))]
        assert (path["largest"], path["avg_path"], path["diameter"]) == (len(inner), pytest.approx(inner.sum() / max(1, len(inner) * (len(inner) - 1))), inner.max())


def test_centralities_compute_edges_once(spark):
    """What finds the edges runs once."""
    pairs, seen = random_graph(6, 200, 6), spark.sparkContext.accumulator(0)

    def counted(parts):
        for t in parts:
            seen.add(len(t))
            yield t

    got = N.centralities(frame(spark, g=pairs).mapInPandas(counted, EDGES)).collect()
    assert len(got) == len({v for p in pairs for v in p}) and seen.value == len(pairs)


def test_pivots_estimate_graphs_of_any_size(spark):
    """More nodes than a task would take whole; the pivots' rows only."""
    n = G.WHOLE + 1000
    pairs = random_graph(4, n, 8)
    edges = frame(spark, big=pairs)
    pivots = spark.createDataFrame([("big", i) for i in range(0, n, n // 4)], "graph string, id long")
    got = N.centralities(edges, pivots).agg({"closeness": "avg", "betweenness": "sum", "*": "count", "eccentricity": "max"}).head()
    ids = {v for p in pairs for v in p}
    assert got["count(1)"] == len(ids)
    path = N.path_sketch(edges).head()
    # in a connected graph betweenness sums up to the mean of inner nodes on a path, closeness is near one over the mean path
    assert got["sum(betweenness)"] * (len(ids) - 2) / len(ids) == pytest.approx(path["avg_path"] - 1, rel=0.1)
    assert got["avg(closeness)"] == pytest.approx(1 / path["avg_path"], rel=0.1)
    assert got["max(eccentricity)"] - 1 <= path["diameter"] <= 2 * got["max(eccentricity)"]


def test_sketched_paths_are_near_the_exact_ones(spark):
    lg, pairs = 9, {"a": random_graph(2, 300, 6), "path": [(i, i + 1) for i in range(12)]}
    edges = frame(spark, **pairs)
    exact = {r["graph"]: r for r in N.path_lengths(edges).collect()}
    for r in N.path_sketch(edges, lg).collect():
        dist = dense(pairs[r["graph"]])[-1]
        real = np.sort(dist[np.isfinite(dist) & (dist > 0)])
        assert r["avg_path"] == pytest.approx(real.mean(), rel=4 * 1.04 / 2 ** (lg / 2))
        assert r["diameter"] <= exact[r["graph"]]["diameter"]
        assert abs(r["effective_diameter"] - np.quantile(real, 0.9)) <= 1.5


def modularity(pairs, label):
    m, inner, ends = len(pairs), defaultdict(int), defaultdict(int)
    for x, y in pairs:
        ends[label[x]] += 1
        ends[label[y]] += 1
        inner[label[x]] += label[x] == label[y]
    return sum(inner[c] / m - (e / (2 * m)) ** 2 for c, e in ends.items())


def test_communities(spark):
    rng = np.random.default_rng(3)
    planted = [(i, j) for i, j in combinations(range(90), 2) if rng.random() < (0.5 if i % 3 == j % 3 else 0.02)]
    cliques = [(10 * c + i, 10 * c + j) for c in range(6) for i, j in combinations(range(5), 2)] + [(10 * c, 10 * ((c + 1) % 6)) for c in range(6)]
    graphs = {"planted": planted, "cliques": cliques, "random": random_graph(5, 70, 4), "star": [(0, i) for i in range(1, 200)], "pairs": [(1, 2), (3, 4)]}
    edges = frame(spark, **graphs)
    nodes = spark.createDataFrame([(g, v) for g, pairs in graphs.items() for v in sorted({v for p in pairs for v in p})] + [("planted", 500), ("alone", 1)], "graph string, id long")
    got = defaultdict(dict)
    for r in N.communities(nodes, edges).collect():
        got[r["graph"]][r["id"]] = r["community"]
    again = {(r["graph"], r["id"]): r["community"] for r in N.communities(nodes.repartition(2), edges.repartition(1)).collect()}
    assert again == {(g, v): c for g, labels in got.items() for v, c in labels.items()}
    assert got["planted"] == {i: i % 3 for i in range(90)} | {500: 500} and got["alone"] == {1: 1}
    assert got["cliques"] == {v: v // 10 * 10 for p in cliques for v in p}
    assert set(got["star"].values()) == {0} and got["pairs"] == {1: 1, 2: 1, 3: 3, 4: 3}
    for g, pairs in graphs.items():
        label = {v: got[g][v] for p in pairs for v in p}
        assert all(got[g][c] == c == min(v for v in label if label[v] == c) for c in set(label.values()))
        q = modularity(pairs, label)
        # no two communities gain by merging, and components are no better
        for a, b in {tuple(sorted((label[x], label[y]))) for x, y in pairs if label[x] != label[y]}:
            assert modularity(pairs, {v: a if c == b else c for v, c in label.items()}) <= q + 1e-9
        parts = {r["id"]: r["component"] for r in G.components(nodes.where(f"graph = '{g}'"), edges.where(f"graph = '{g}'")).collect()}
        assert q >= modularity(pairs, parts) - 1e-12


def test_weighted_communities(spark):
    weak = [("g", 0, 1, 9.0), ("g", 2, 3, 9.0), ("g", 0, 2, 0.1), ("g", 1, 3, 0.1), ("g", 1, 0, 2.0)]
    edges = spark.createDataFrame(weak, EDGES)
    nodes = spark.createDataFrame([("g", i) for i in range(4)], "graph string, id long")
    assert {r["id"]: r["community"] for r in N.communities(nodes, edges, weighted=True).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_triangles_of_hubs(spark):
    """A star of 100,000 leaves has no triangles and makes no row for pairs of them; a clique has all of its own."""
    star = spark.range(100_000).selectExpr("'star' as graph", "-1L as src", "id as dst", "1D as weight")
    pairs = random_graph(7, 60, 12)
    edges = star.unionByName(frame(spark, clique=list(combinations(range(12), 2)), random=pairs))
    edges = edges.unionByName(spark.createDataFrame([("star", 5, 6, 1.0)], EDGES))
    got = {(r["graph"], r["id"]): r["triangles"] for r in G.triangles(edges).collect()}
    want = {("clique", i): 55 for i in range(12)} | {("star", v): 1 for v in (-1, 5, 6)}
    near = defaultdict(set)
    for x, y in pairs:
        near[x].add(y)
        near[y].add(x)
    for v in near:
        if many := sum(y in near[x] for x, y in combinations(near[v], 2)):
            want["random", v] = many
    assert got == want


def test_measures_of_no_edges(spark):
    nodes, none = spark.createDataFrame([("g", 1)], "graph string, id long"), spark.createDataFrame([], EDGES)
    assert N.centralities(none).collect() == [] and N.path_lengths(none).collect() == [] and N.path_sketch(none).collect() == []
    assert [tuple(r) for r in N.communities(nodes, none).collect()] == [("g", 1, 1)] and G.triangles(none).collect() == []


def test_one_call_gives_the_whole_analysis(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in rng.normal(size=6)]) for i in range(40)] + [(99, 5, [1.0] * 6)], "protein_id long, family_id int, v array<double>")
    out = service.analyze_network(rows, k=4)
    per = {r["graph"]: r for r in out["properties"].collect()}
    nodes = out["statistics"].collect()
    assert len(nodes) == out["nodes"].count() == 41 and set(per) == {0, 1, 5}
    for g in (0, 1):
        own = [r for r in nodes if r["graph"] == g]
        assert sum(r["degree"] for r in own) == 2 * per[g]["n_edges"] and len({r["community"] for r in own}) == per[g]["n_communities"]
        assert len({r["component"] for r in own}) == per[g]["n_components"] and per[g]["avg_clustering"] == pytest.approx(np.mean([r["clustering"] for r in own]))
        assert max(r["eccentricity"] for r in own) >= per[g]["diameter"] and sum(r["eigenvector"] ** 2 for r in own) == pytest.approx(1)
    lone = next(r for r in nodes if r["id"] == 99)
    assert (lone["degree"], lone["community"], lone["betweenness"], lone["eccentricity"]) == (0, 99, 0.0, 0)


def test_tasks_and_joins_give_the_same_measures(spark, monkeypatch):
    """Graphs that a task takes against the joins of larger ones; of the tasks no step is a job of its own."""
    pairs = random_graph(9, 120, 4) + [(200, 201), (201, 202), (300, 301)]
    edges, nodes = frame(spark, g=pairs), spark.createDataFrame([("g", v) for v in sorted({v for p in pairs for v in p})], "graph string, id long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    measures = lambda: (rows(N.communities(nodes, edges)), rows(N.path_lengths(edges)), rows(N.centralities(edges)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tasks", "tasks")
    found = measures()
    assert len(tracker.getJobIdsForGroup("tasks")) < 60
    monkeypatch.setattr(N, "IN_TASK", 0)
    assert (found[0], found[1]) == measures()[:2]
    for a, b in zip(found[2], rows(N.centralities(edges))):
        assert a[:2] == b[:2] and a[5] == b[5] and a[2:5] == pytest.approx(b[2:5], abs=1e-5)
    monkeypatch.undo()
    for name in ("REACH", "DEPEND"):
        monkeypatch.setattr(N, name, 7)
    assert rows(N.path_lengths(edges)) == found[1]
    for a, b in zip(found[2], rows(N.centralities(edges))):
        assert a[2:4] == pytest.approx(b[2:4])
