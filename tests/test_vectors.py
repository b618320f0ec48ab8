import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.operators import alignment as M
from helixframe.operators import blocks as B
from helixframe.operators import families as A
from helixframe.operators import graph as G
from helixframe.operators import index as I
from helixframe.operators import search as Q
from helixframe.session import Scratch

PAIRS = [("a", "b", 0.8), ("a", "c", 0.6), ("a", "d", 0.4), ("b", "c", 0.7), ("b", "d", 0.5), ("c", "d", 0.9)]


@pytest.fixture(scope="module")
def square(spark):
    pairs = spark.createDataFrame([("g", *p) for p in PAIRS], "graph string, src string, dst string, weight double")
    return spark.createDataFrame([("g", x) for x in "abcd"], "graph string, id string"), pairs


def edges(df):
    return {r["src"] + r["dst"] for r in df.collect()}


def test_graph_builders(square):
    _, pairs = square
    assert edges(G.mutual_knn(pairs, 2, 0.5)) == {"ab", "bc", "cd"}
    five = {"ab", "ac", "bc", "bd", "cd"}
    assert edges(G.hybrid(pairs, 2, 0.5)) == five == edges(G.robust(pairs, 2, 0.5)) == edges(G.threshold_edges(pairs, 0.5))
    assert edges(G.threshold_edges(pairs, 0.7)) == {"ab", "bc", "cd"}


def test_robust_keeps_lone_nodes(spark):
    pairs = spark.createDataFrame([("g", "a", "b", 0.9), ("g", "a", "c", 0.2), ("g", "b", "c", 0.1)], "graph string, src string, dst string, weight double")
    assert edges(G.robust(pairs, 1, 0.5)) == {"ab", "ac"}


def test_expand_and_measures(square):
    nodes, pairs = square
    base = G.mutual_knn(pairs, 2, 0.5)
    assert edges(G.expand(base, pairs, nodes, 0.5, least=5)) == {"ab", "ac", "ad", "bc", "bd", "cd"}
    assert edges(G.expand(base, pairs, nodes, 0.5, least=4)) == {"ab", "bc", "cd"}
    rows = nodes.sparkSession.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(7)], "protein_id int, family_id int, v array<double>")
    few, all_ = G.edges_over(rows, 0.99), G.pair_scores(rows)
    of_rows = nodes.sparkSession.createDataFrame([(i % 2, i) for i in range(7)], "graph int, id int")
    assert sorted(G.expand_rows(few, rows, 0.99, least=4).collect()) == sorted(G.expand(few, all_, of_rows, 0.99, least=4).collect())
    d = G.density(nodes, base).head()
    assert (d["n_nodes"], d["n_edges"], d["density"], d["avg_degree"]) == (4, 3, 0.5, 1.5)
    p = G.path_lengths(base).head()
    assert p["avg_path"] == pytest.approx(10 / 6) and p["diameter"] == 3
    assert {r["component"] for r in G.components(nodes, base).collect()} == {"a"}
    assert {r["clustering"] for r in G.clustering(nodes, base).collect()} == {0.0}
    full = {r["id"]: r["clustering"] for r in G.clustering(nodes, pairs).collect()}
    assert set(full.values()) == {1.0}
    between = {r["id"]: r["betweenness"] for r in G.centralities(base).collect()}
    assert between == {"a": 0.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0.0}


def test_trim(square, spark):
    nodes, pairs = square
    star = spark.createDataFrame([("g", "a", x, 1.0) for x in "bcde"] + [("g", "b", "c", 1.0)], "graph string, src string, dst string, weight double")
    assert {r["id"] for r in G.trim(star, 3).collect()} == {"a", "b", "c"}
    all_nodes = spark.createDataFrame([("g", x) for x in "abcde"], "graph string, id string")
    q = spark.createDataFrame([("g", "b")], "graph string, query_id string")
    assert {r["id"] for r in G.trim_to_query(all_nodes, star, q, 3).collect()} == {"a", "b", "c"}


def test_ward():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert G.ward(x, 3).tolist() == [0, 0, 1, 1, 2]
    assert len(set(G.ward(x, 1))) == 1 and len(set(G.ward(x, 5))) == 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 3, [float(v) for v in rng.normal(size=8)]) for i in range(30)]
    return spark.createDataFrame(data, "protein_id long, family_id int, v array<double>"), data


def test_families(rows):
    df, data = rows
    cents = {r["family_id"]: np.array(r["centroid"]) for r in A.centroids(df).collect()}
    for f in range(3):
        own = np.array([v for _, g, v in data if g == f])
        assert np.allclose(cents[f], own.mean(axis=0))
    med = {r["family_id"]: r["medoid_id"] for r in A.medoids(df, A.centroids(df)).collect()}
    assert med[1] == min((np.linalg.norm(np.array(v) - cents[1]), i) for i, g, v in data if g == 1)[1]
    for r in A.assign(df, A.centroids(df)).collect():
        b = np.array(data[r["protein_id"]][2]) > 0
        h = {f: int((b != (c > 0)).sum()) for f, c in cents.items()}
        assert r["hamming"] == min(h.values()) and r["assigned"] == min(f for f in h if h[f] == min(h.values())) and r["confidence"] == 1 - r["hamming"] / 8
    assert {r["assigned"] for r in A.assign(df, A.centroids(df), 1.1).collect()} == {None}


@pytest.mark.parametrize("limit", [A.CENTROID_LIMIT, 200])
def test_assignment_of_any_vectors(spark, limit):
    """Families by name, vectors of several lengths, ties, repeated rows, and rows that have no centroid to meet."""
    rng = np.random.default_rng(8)
    known = [(f"f{i:02d}", [int(x) for x in rng.integers(0, 2, size=(5, 70)[i % 2])]) for i in range(24)]
    known += [("e1", known[0][1]), (None, [1] * 5), ("none", None), ("empty", [])]
    vectors = [[float(x) for x in rng.normal(size=(5, 70)[i % 2])] for i in range(60)]
    vectors += [vectors[0], [1.0, None, float("nan"), -0.0, float("inf")], [1.0, 2.0], [], None]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "protein_id long, v array<double>, hidden string")
    cents = spark.createDataFrame(known, "family_id string, bits array<tinyint>")
    got = {r["protein_id"]: r for r in A.assign(rows, cents, limit=limit, keep=("hidden",)).collect()}
    assert len(got) == len(vectors) and {r["hidden"] for r in got.values()} == {"x"}
    for i, v in enumerate(vectors):
        b = [int(x is not None and not x <= 0) for x in v or []]
        best = min(((sum(x != y for x, y in zip(b, c)), f) for f, c in known if f and c and len(c) == len(b)), default=(None, None))
        assert (got[i]["hamming"], got[i]["assigned"]) == best
        assert got[i]["confidence"] == (None if best[0] is None else 1 - best[0] / len(b))
    signs = A.Signs(cents, limit)
    assert (signs.blocks > 1) == (limit == 200)
    assert A.assign(rows.limit(0), signs).count() == 0
    none = A.assign(rows, cents.limit(0)).collect()
    assert len(none) == len(vectors) and {r["assigned"] for r in none} == {None}


@pytest.mark.parametrize("least", [None, 0.3, 0.8])
def test_pairs_of_sequences(spark, least):
    """Blocks of sequences against every pair: empty, null, long and non-ASCII texts, repeated texts and ids."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACDE"), size=n)) for n in rng.integers(1, 30, size=40)]
    long = "".join(rng.choice(list("AC"), size=9000))
    texts += ["", "", None, texts[0], long, long[:5000] + "\u00ff\u4e2d" + long[5002:], "\u00fe\U0001f600A", "\u00fe\U0001f600C", "\x00\x00A", "\x00"]
    data = [(f"s{i:02d}", t) for i, t in enumerate(texts)] + [("s00", texts[0])]
    got = sorted(tuple(r) for r in M.pairs(spark.createDataFrame(data, "protein_id string, sequence string"), least, block=9).select("src", "dst", "la", "lb", "matches").collect())
    want = []
    for a, s in data:
        for b, t in data:
            if a < b and s is not None and t is not None:
                n, short = sum(x == y for x, y in zip(s, t)), min(len(s), len(t))
                if least is None or (n / short if short else 0.0) >= least:
                    want.append((a, b, len(s), len(t), n))
    assert got == sorted(want) and got
    assert M.pairs(spark.createDataFrame([], "protein_id string, sequence string"), least).count() == 0


def test_search(rows):
    df, data = rows
    v = {i: np.array(x) for i, _, x in data}
    got = Q.within_family(df, df, 4).where("query_id = 4").orderBy("rank").collect()
    cos = sorted(((-(v[4] @ v[j]) / np.linalg.norm(v[4]) / np.linalg.norm(v[j]), j) for j in range(1, 30, 3)))[:4]
    assert [r["protein_id"] for r in got] == [j for _, j in cos if j != 4]
    assert Q.within_family(df, df, 30, 0.5).count() <= Q.within_family(df, df, 30, 0.1).count()
    hist = {r["bin"]: r["n"] for r in Q.histogram(Q.within_family(df, df, 30), "similarity").collect()}
    assert sum(hist.values()) == Q.within_family(df, df, 30).count() and sorted(hist) == [0, 1, 2, 3, 4]


def test_sizes_of_many_groups_are_joined(rows, monkeypatch):
    df, _ = rows
    key = lambda d: sorted(map(tuple, d.collect()))
    few = key(Q.within_family(df, df, 4)), key(G.edges_over(df, 0.2)), key(Q.all_families(df, df, 2))
    for limit in ("FEW", "NAMES"):
        monkeypatch.setattr(B, limit, 0)
        assert (key(Q.within_family(df, df, 4)), key(G.edges_over(df, 0.2)), key(Q.all_families(df, df, 2))) == few
        monkeypatch.undo()


def test_blocks_change_nothing(rows):
    df, _ = rows
    cents = A.centroids(df)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(A.assign(df, cents, limit=50)) == key(A.assign(df, cents))
    q = df.where("protein_id < 7")
    asked = q.select(F.col("protein_id").alias("query_id"), F.col("v").alias("q"))
    for options in ({"k": 3, "per_family": True}, {"k": 5, "per_family": False, "least": 0.1, "projected": True}):
        assert key(B.top_of_all(asked, df, block=4, **options)) == key(B.top_of_all(asked, df, **options))


def test_searches_over_all_families(rows):
    df, data = rows
    odd = df.unionByName(df.sparkSession.createDataFrame([(90, None, data[0][2]), (91, 1, None), (92, 1, [1.0])], df.schema))
    v = {i: (f, np.array(x)) for i, f, x in data} | {90: (None, np.array(data[0][2]))}
    q = df.where("protein_id < 7")
    got = [tuple(r) for r in Q.all_families(q, odd, 3).collect()]
    want = []
    for i in range(7):
        for f in (0, 1, 2, None):
            cos = sorted((-(v[i][1] @ x) / np.linalg.norm(v[i][1]) / np.linalg.norm(x), j) for j, (g, x) in v.items() if g == f)[:3]
            want += [(i, f, j, pytest.approx(-c), n + 1) for n, (c, j) in enumerate(cos)]
    low = lambda t: (t[0], t[1] is None, t[1] or 0, t[4])
    assert sorted(got, key=low) == sorted(want, key=low)
    assert {r["family_id"] for r in Q.all_families(q, df, 3, max_families=2).collect()} == {0, 1}
    got = sorted(map(tuple, Q.global_threshold(q, df, 5, 0.2).collect()), key=lambda t: (t[0], t[3]))
    want = []
    for i in range(7):
        dot = sorted((-(v[i][1] @ x) / np.linalg.norm(v[i][1]), j) for j, (_, x) in v.items() if j < 90)
        want += [(i, j, pytest.approx(-c), n + 1) for n, (c, j) in enumerate(dot[:5]) if -c >= 0.2]
    assert got == want


def test_packed_bits(spark):
    for n in (1, 8, 63, 64, 65, 130):
        rng = np.random.default_rng(n)
        a, b = (rng.normal(size=n).tolist() for _ in range(2))
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        words = F.aggregate(F.zip_with(V.packed(V.bits(F.col("a"))), V.packed(V.bits(F.col("b"))), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        r = df.select(words.alias("w"), V.hamming(V.bits(F.col("a")), V.bits(F.col("b"))).alias("h")).head()
        assert r["w"] == r["h"] == sum((x > 0) != (y > 0) for x, y in zip(a, b))


def test_zero_vectors(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(V.normalized(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c")).head()
    assert r["n"] == [0.0, 0.0] and r["c"] == 0.0


def test_slices_and_batches(spark):
    df = spark.range(200).select(F.col("id").alias("protein_id"), F.lit(1).alias("family_id"))
    assert A.slice_rows(df, 10, 30).count() == 20
    for size, n in ((10, 20), (50, 4), (100, 2)):
        assert A.batches(df, size).select("batch").distinct().count() == n
    got = A.ordinals(df.repartition(7)).collect()
    assert all(r["ordinal"] == r["protein_id"] for r in got) and len(got) == 200


def test_ordinals_within_families(spark):
    """A family of most rows, small ones, a null one and an empty table; no window holds a family's rows."""
    rows = [(i, None if i % 50 == 0 else f"f{i % 50}" if i % 50 < 6 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "protein_id long, family_id string")
    out = A.ordinals(df.repartition(9, F.rand(5)), per="family_id")
    want, seen = {}, {}
    for i, family in rows:
        want[i] = (family, seen.get(family, 0))
        seen[family] = seen.get(family, 0) + 1
    assert {r["protein_id"]: (r["family_id"], r["ordinal"]) for r in out.collect()} == want
    assert out.columns == ["protein_id", "family_id", "ordinal"]
    assert A.ordinals(df.where("protein_id < 0"), per="family_id").collect() == []


def test_an_id_of_many_records(spark):
    a = spark.createDataFrame([("x", f"{i:04d}") for i in range(700)] + [("y", "s")], "protein_id string, sequence string")
    b = spark.createDataFrame([("x", "0000"), (None, "t"), (None, "u")], "protein_id string, sequence string")
    got = {r["protein_id"]: r["sequence"] for r in A.concatenated(a.repartition(5), b).where("protein_id is not null").collect()}
    assert got == {"x": "0000", "y": "s", "x_701": "0000"} | {f"x_{i + 1}": f"{i:04d}" for i in range(1, 700)}


def test_trimming_a_star(spark):
    """A hub with more neighbours than are wanted keeps all of them when it is the query, and the best otherwise."""
    nodes = spark.range(301).select(F.lit("g").alias("graph"), F.col("id"))
    edges = spark.range(1, 301).select(F.lit("g").alias("graph"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    ask = lambda q: sorted(r["id"] for r in G.trim_to_query(nodes, edges, spark.createDataFrame([("g", q)], "graph string, query_id long"), 20).collect())
    assert ask(0) == list(range(301))
    assert ask(7) == list(range(20))
    assert ask(250) == [*range(19), 250]


def test_blocks_of_pairs_change_nothing(spark):
    """Groups of more rows than a block, repeated vectors, other lengths and missing ones."""
    rng = np.random.default_rng(5)
    data = [(i, i % 2, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    data += [(100 + i, 0, data[4][2]) for i in range(5)] + [(200, 0, [0.0] * 6), (201, 0, [1.0, 2.0]), (202, 0, None), (203, None, data[0][2]), (204, 7, data[1][2])]
    df = spark.createDataFrame(data, "protein_id long, family_id int, v array<double>")
    key = lambda d: sorted(map(tuple, d.collect()))
    asked = df.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    for hamming in (False, True):
        assert key(B.top(asked, df, 7, hamming, block=9)) == key(B.top(asked, df, 7, hamming))
    assert key(B.pairs(df, block=9)) == key(B.pairs(df)) and key(B.pairs(df, 0.5, block=9)) == [r for r in key(B.pairs(df)) if r[3] >= 0.5]
    pairs = B.pairs(df).where("src < 200 and dst < 200")
    assert key(G.nearest(df, 6).where("src < 200 and dst < 200 and rank <= 3")) == key(G.knn(pairs, 3))
    for r in B.pairs(df).where("src < 20").collect():
        a, b = (next(v for i, _, v in data if i == x) for x in (r["src"], r["dst"]))
        if len(a) == len(b) and any(a) and any(b):
            total = 0.0
            for x, y in zip(a, b):
                total += x * y
            norm = lambda v: float(np.sqrt(sum(x * x for x in v)))
            assert r["weight"] == pytest.approx(total / (norm(a) * norm(b)), abs=1e-15)
    assert B.top(asked.limit(0), df, 3).count() == 0 and B.pairs(df.limit(0)).count() == 0
    assert {r["rank"] for r in B.top(asked.where("query_id = 204"), df, 3).collect()} == {1}


def test_pruned_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16))
    data = [(i, i % 2, [float(x) for x in centers[i % 12] + 0.15 * rng.normal(size=16)]) for i in range(600)]
    odd = [(900, 0, None), (901, 0, [0.0] * 16), (902, None, data[0][2]), (903, 1, [1.0, 2.0]), (904, 1, [1.0, 2.0]), (905, 7, data[3][2]), (906, 0, data[0][2]), (907, 0, data[0][2])]
    df = spark.createDataFrame(data + odd, "protein_id long, family_id int, v array<double>").repartition(4)
    got, report = B.near_pairs(df, 0.8, 16)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(B.pairs(df, 0.8)) and got.count() > 5000
    shares = {r["family_id"]: r["compared"] / r["block_pairs"] for r in report.collect()}
    assert shares[0] < 0.5 and shares[1] < 0.5
    with pytest.raises(ValueError):
        B.near_pairs(df, 0.0)


@pytest.mark.parametrize("order", ["ascending", "random"])
def test_components_of_long_paths(spark, order):
    ids = np.arange(3_000) if order == "ascending" else np.random.default_rng(1).permutation(3_000)
    edges = [("g", int(min(a, b)), int(max(a, b)), 1.0) for a, b in zip(ids, ids[1:])] + [("h", 1, 2, 1.0)]
    links = spark.createDataFrame(edges, "graph string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("g", i) for i in range(3_001)] + [("h", 1), ("h", 2)], "graph string, id long")
    got = {(r["graph"], r["component"]): r["count"] for r in G.components(nodes, links).groupBy("graph", "component").count().collect()}
    assert got == {("g", 0): 3_000, ("g", 3_000): 1, ("h", 1): 2}
    assert G.components(nodes, links.limit(0)).where("id = component").count() == nodes.count()


def test_family_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16)) * 3
    data = [(i, "big family" if i % 5 else "small", [float(x) for x in centers[i % 6] + rng.normal(size=16)]) for i in range(500)]
    df = spark.createDataFrame(data + [(900, None, data[0][2]), (901, "small", None)], "protein_id long, family_id string, v array<double>")
    for binary in (False, True):
        index = I.build(df, f"file://{tmp_path}/{binary}", binary)
        info = {r["family_id"]: r for r in index.info.collect()}
        assert {f: (r["num_proteins"], r["embedding_dim"]) for f, r in info.items()} == {"big family": (400, 16), "small": (100, 16)}
        assert info["big family"]["nlist"] == 10 and info["small"]["nlist"] == 2
        assert index.centers.count() == 12 and index.lists.count() == 500
        asked = df.where("protein_id % 10 = 1 and protein_id < 500")
        near = lambda d: {(r["query_id"], r["protein_id"]) for r in d.collect()}
        whole = near(index.search(asked, 5))
        again = I.FamilyIndex(spark, f"file://{tmp_path}/{binary}", binary)
        assert near(again.search(asked, 5, probe=10)) == whole
        assert again.folders == 3
        probe = again.probes_for(0.95, 5, 500)
        some = near(again.search(asked, 5, probe=probe))
        assert len(some) == len(whole) and len(some & whole) >= 0.9 * len(whole) and 1 <= probe <= 8
        # one query reads the folders of the lists it probes and no others
        one = asked.where("protein_id = 11")
        assert near(again.search(one, 5, probe=1)) <= near(again.search(one, 500)) and len(again.read) == 1
        few = again.read_lists(again.centers.where("family_id = 'small' and list = 0").select("family_id", "list"))
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", few._jdf.queryExecution().executedPlan().toString()) and 0 < few.count() < 100
        files = {r[0] for r in again.buckets.where(F.col("bucket").isin(again.read)).select(F.input_file_name()).distinct().collect()}
        assert files and all(f"bucket={again.read[0]}/" in f for f in files)
        assert near(again.search_family("small", asked.where("family_id = 'small'"), 5)) == near(again.search(asked.where("family_id = 'small'"), 5))
    assert index.family("small").count() == 100
    with pytest.raises(ValueError):
        index.family("none")


def test_open_families_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "OPEN", 2)
    df = spark.createDataFrame([(i, i % 4, [1.0, float(i)]) for i in range(40)], "protein_id long, family_id int, v array<double>")
    index = I.build(df, f"file://{tmp_path}/x")
    for f in (0, 1, 0, 2, 3):
        assert index.family(f).count() == 10
    assert list(index._open) == [2, 3]
    assert {r["index_type"] for r in index.info.collect()} == {"Flat_float"}


def test_padded(spark):
    found = spark.createDataFrame([(1, 1, 9, 0.5)], "query_id long, rank int, protein_id long, distance double")
    out = I.padded(found, spark.createDataFrame([(1,), (2,)], "query_id long"), 2).orderBy("query_id", "rank").collect()
    assert [(r["protein_id"], r["distance"]) for r in out] == [("9", 0.5), ("UNKNOWN", float("inf")), ("UNKNOWN", float("inf")), ("UNKNOWN", float("inf"))]


def test_valid_nodes_and_dimensions(spark):
    nodes = spark.createDataFrame([("a",), (None,), (" ",), ("NaN",), (" nan ",), ("nano",)], "id string")
    assert sorted(r["id"] for r in G.valid_nodes(nodes).collect()) == ["a", "nano"]
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [1.0, float("nan")])], "protein_id long, v array<double>")
    assert {r["protein_id"]: r["valid"] for r in A.has_dimension(rows, 2).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_layout(spark):
    path = [("g", i, i + 1, 0.5) for i in range(4)]
    at = {r["id"]: np.array([r["x"], r["y"]]) for r in G.layout(spark.createDataFrame(path, "graph string, src long, dst long, weight double")).collect()}
    gap = lambda i, j: np.linalg.norm(at[i] - at[j])
    assert max(np.abs(p).max() for p in at.values()) == pytest.approx(1)
    for i in range(4):  # a path of equal edges is nearly a straight line
        assert gap(i, i + 1) == pytest.approx(gap(0, 4) / 4, rel=0.03)


def test_modularity(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "c", "d", 1.0)], "graph string, src string, dst string, weight double")
    nodes = spark.createDataFrame([("g", x) for x in "abcde"] + [("h", "z")], "graph string, id string")
    got = {r["graph"]: (r["n_communities"], r["modularity"], r["n_edges"]) for r in G.modularity(G.components(nodes, edges), edges).collect()}
    assert got == {"g": (3, 0.5, 2), "h": (1, 0.0, 0)}


def test_whole_graphs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(G, "WHOLE", 2)
    monkeypatch.setattr(G, "CLUSTERED", 10)
    import pandas as pd

    with pytest.raises(ValueError):
        G._adjacency(pd.DataFrame({"src": [1, 2], "dst": [2, 3], "weight": [1.0, 1.0]}))
    rows = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(60)], "protein_id int, family_id int, v array<double>")
    with pytest.raises(ValueError):
        G.match_clusters(rows)
    assert G.match_clusters(rows.limit(10)).count() == 10


def test_bootstrap_support(spark):
    rows = [("a", "AAAAAAAAAACC"), ("b", "AAAAAAAAAACD"), ("c", "GGGGGGGGGGEE"), ("d", "GGGGGGGGGGEF"), ("e", "LLLLLLLLLLHH")]
    df = spark.createDataFrame(rows, "protein_id string, aligned string")
    for score in (None, {(x, x): 4.0 for x in "ACDEFGHL"}):
        out = M.bootstrap_support(df, 20, score=score).collect()
        assert {r["child"] for r in out} >= set("abcde") and all(r["support"] is None for r in out if r["child"] in "abcde")
        assert len(out) == 7 and max(r["support"] for r in out if r["support"] is not None) == 1.0


def test_trees_keep_additive_distances(spark):
    """Neighbour joining gives back the path lengths of a tree."""
    far = {("a", "b"): 5.0, ("a", "c"): 9.0, ("a", "d"): 9.0, ("a", "e"): 8.0, ("b", "c"): 10.0, ("b", "d"): 10.0, ("b", "e"): 9.0, ("c", "d"): 8.0, ("c", "e"): 7.0, ("d", "e"): 3.0}
    tree = M.neighbour_joining(spark.createDataFrame([(*k, v) for k, v in far.items()], "src string, dst string, distance double")).collect()
    links = {}
    for r in tree:
        links.setdefault(r["child"], {})[r["parent"]] = links.setdefault(r["parent"], {})[r["child"]] = r["length"]

    def way(a, b, seen=()):
        return 0.0 if a == b else min((d + way(n, b, (*seen, a)) for n, d in links[a].items() if n not in seen), default=float("inf"))

    assert {k: way(*k) for k in far} == pytest.approx(far)


def moved(spark, run):
    """Bytes that shuffles write while ``run`` runs."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        known = sc.statusStore().executorList(False)
        return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))

    before = total()
    run()
    return total() - before


def test_rows_are_sent_for_few_blocks(spark):
    """Narrow blocks of near pairs, and searches in one family, do not send a row to a task for each block of a thousand."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(6000, 16))
    v[3000:3100] = v[:100] * (1 + 2**-50)  # scores that differ by rounding alone
    data = [(i, 0, [float(x) for x in row]) for i, row in enumerate(v)]
    df = Scratch(spark, "few").table(spark.createDataFrame(data, "protein_id long, family_id int, v array<double>"), "rows")
    bytes_ = 6000 * 16 * 8
    noop = lambda d: d.write.format("noop").mode("overwrite").save()
    assert moved(spark, lambda: noop(B.near_pairs(df, 0.5, 16)[0])) < 12 * bytes_
    assert moved(spark, lambda: noop(B.pairs(df, 0.9))) < 4 * bytes_
    # a row goes to four blocks at most until they hold 16,384, in the type in which it is stored
    stored = Scratch(spark, "stored").table(df.withColumn("v", F.col("v").cast("array<float>")), "rows")
    assert moved(spark, lambda: noop(B.pairs(stored, 0.9, block=512))) < 5 * bytes_ / 2
    exact = B.cosines(v[:40], v)
    asked = df.where("protein_id < 40").select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    got = {(r["query_id"], r["rank"]): (r["protein_id"], r["score"]) for r in B.top(asked, df, 5).collect()}
    for i, row in enumerate(exact):
        order = sorted(range(6000), key=lambda j: (-row[j], j))[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, row[j]) for j in order]


def test_trimming_graphs_of_any_size(spark):
    """The nodes that are left, against a plain loop; and a graph of more nodes than a task's table of pairs would take."""
    rng = np.random.default_rng(2)
    pairs = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 90, size=(200, 2)) if p[0] != p[1]})
    n = G.WHOLE + 500
    edges = spark.createDataFrame([("g", a, b, 1.0) for a, b in pairs] + [("path", i, i + 1, 0.5) for i in range(n)], "graph string, src long, dst long, weight double")
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in {v for p in pairs for v in p}}
    while len(near) > 20:
        v = min(near, key=lambda v: (len(near[v]), v))
        for u in near.pop(v):
            near[u].discard(v)
    got = [tuple(r) for r in G.trim(edges, 20).collect()]
    assert {v for g, v in got if g == "g"} == set(near)
    assert sorted(v for g, v in got if g == "path") == list(range(n - 19, n + 1))


def test_ward_clusters_of_large_groups(spark):
    """Chains of neighbours against the table of distances; and a group of more rows than the table takes, with copies."""
    rng = np.random.default_rng(6)
    for n, clusters in ((2, 5), (3, 2), (60, 5), (150, 1), (150, 7)):
        x = rng.normal(size=(n, 5))
        assert G.ward_by_chains(x, clusters).tolist() == G.ward(x, clusters).tolist()
    copies = np.concatenate([x, x[::-1], x[:40]])
    assert G.ward_by_chains(copies, 5).tolist() == G.ward(copies, 5).tolist()
    assert len(set(G.ward_by_chains(np.ones((50, 2)), 5))) == 5
    rows = spark.createDataFrame([(i, 1, [float(i % 3) * 50 + float(z), 1.0]) for i, z in enumerate(rng.normal(size=2100))], "protein_id int, family_id int, v array<double>")
    assert {(r["id"] % 3, r["cluster"]) for r in G.match_clusters(rows, 3).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_distances_and_places_of_a_layout():
    """Path lengths against Floyd and Warshall's, and places whose energy no small move of a node lowers."""
    import pandas as pd

    rng = np.random.default_rng(4)
    pairs = np.unique(np.sort(rng.integers(0, 70, size=(110, 2)), axis=1), axis=0)
    pairs = np.concatenate([pairs[pairs[:, 0] != pairs[:, 1]], [[80, 81]]])
    pdf = pd.DataFrame({"graph": "g", "src": pairs[:, 0], "dst": pairs[:, 1], "weight": rng.uniform(0.1, 1, len(pairs))})
    ids, a = G._adjacency(pdf)
    d = np.where(a != 0, np.maximum(0.1, 1 - a), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(ids)):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    assert G._distances(a) == pytest.approx(d)
    d[np.isinf(d)] = 2 * d[np.isfinite(d)].max()
    out = G._layout(pdf)
    x = out[["x", "y"]].to_numpy()
    gap = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.divide(1.0, d**2, out=np.zeros(d.shape), where=d > 0)
    scale = (w * d * gap(x)).sum() / (w * gap(x) ** 2).sum()
    energy = lambda x: (w * (scale * gap(x) - d) ** 2).sum()
    for _ in range(50):
        assert energy(x + rng.normal(size=x.shape) * 1e-3) > energy(x)


def test_layout_of_a_graph_that_is_not_held_whole(monkeypatch):
    """Path lengths from a few sources, and places by rows whose energy is that of places in memory; lone nodes, too."""
    import pandas as pd

    rng = np.random.default_rng(8)
    pairs = np.unique(np.sort(rng.integers(0, 200, size=(400, 2)), axis=1), axis=0)
    pairs = np.concatenate([pairs[pairs[:, 0] != pairs[:, 1]], [[0, i] for i in range(300, 400)], [[500, 501], [600, 601]]])
    pdf = pd.DataFrame({"graph": "g", "src": pairs[:, 0], "dst": pairs[:, 1], "weight": rng.uniform(0.1, 1, len(pairs))}).drop_duplicates(["src", "dst"])
    pdf.loc[pdf["src"] == 600, "weight"] = 0.0
    ids, a = G._adjacency(pdf)
    d = G._distances(a)
    linked = pdf[pdf["weight"] != 0]
    near = G.T.Near(G.T.Links(G.pa.table({"src": linked["src"].to_numpy(), "dst": linked["dst"].to_numpy(), "w": np.maximum(0.1, 1 - linked["weight"].to_numpy())})))
    real = np.isin(ids, linked[["src", "dst"]])
    assert near.distances(np.arange(7)) == pytest.approx(d[real][:, real][np.ix_(near.order, near.order[:7])])
    d[np.isinf(d)] = 2 * d[np.isfinite(d)].max()
    w = np.divide(1.0, d**2, out=np.zeros(d.shape), where=d > 0)

    def energy(out):
        assert out["id"].tolist() == ids.tolist() and np.isfinite(out[["x", "y"]].to_numpy()).all()
        x = out[["x", "y"]].to_numpy()
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        return (w * ((w * d * gap).sum() / (w * gap**2).sum() * gap - d) ** 2).sum()

    held = energy(G._layout(pdf))
    monkeypatch.setattr(G, "WHOLE", 100)
    assert energy(G._layout(pdf)) == pytest.approx(held, rel=0.05)


def test_few_scores_are_kept_of_copies_and_long_blocks(monkeypatch):
    """A tile does not grow with the searched rows, and of many equal rows only those that can be among the best are scored."""
    r = np.random.default_rng(7)
    b = r.standard_normal((9000, 16))
    b[100:6000] = b[5]
    a, own = b[:200], np.arange(200)
    near, exact, tiles, scored = B._Cosines.near, B._Cosines.exact, [], []
    monkeypatch.setattr(B._Cosines, "near", lambda self, *of: tiles.append(near(self, *of)) or tiles[-1])
    monkeypatch.setattr(B._Cosines, "exact", lambda self, i, j: scored.append(len(i)) or exact(self, i, j))
    i, j, score = B._best(a, b, 8, own)
    assert max(t.size for t in tiles) <= B.TILE * B.ACROSS and sum(scored) < 20 * len(a)
    whole = B.cosines(a, b)
    whole[own, own] = -np.inf
    order = np.argsort(-whole, axis=1, kind="stable")[:, :8]
    assert i.tolist() == np.repeat(own, 8).tolist() and j.tolist() == order.ravel().tolist()
    assert score.tolist() == np.take_along_axis(whole, order, 1).ravel().tolist()


def test_values_that_are_nearly_equal_are_settled_as_they_come(monkeypatch):
    r = np.random.default_rng(8)
    b = r.standard_normal((9000, 16))
    b[100:6000] = b[5] * (1 + 1e-7 * r.standard_normal((5900, 16)))
    monkeypatch.setattr(B, "HELD", 8 * 1000)
    i, j, score = B._best(b[:50], b, 8)
    whole = B.cosines(b[:50], b)
    order = np.argsort(-whole, axis=1, kind="stable")[:, :8]
    assert j.tolist() == order.ravel().tolist() and score.tolist() == np.take_along_axis(whole, order, 1).ravel().tolist()


def test_blocks_of_searches_are_bounded_by_bytes(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, 0, [float(x) for x in r.standard_normal(4)]) for i in range(200)], "protein_id int, family_id int, v array<double>")
    asked = rows.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    want = sorted(B.top(asked, rows, 3).collect())
    monkeypatch.setattr(B, "HELD", 8 * 4 * 10)  # ten rows of queries, forty searched
    assert sorted(B.top(asked, rows, 3).collect()) == want


def test_searches_in_one_task_and_in_many_are_the_same(spark, monkeypatch):
    """Queries of one id and several lengths or vectors, copies, ids that are text, and rows of one group in several tasks."""
    r = np.random.default_rng(10)
    data = [(f"p{i % 190}", i % 2, [float(x) for x in r.integers(-2, 3, 4 + (i % 5 == 0))]) for i in range(200)]
    rows = spark.createDataFrame(data, "protein_id string, family_id int, v array<float>")
    asked = rows.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    for hamming in (False, True):
        want = {}
        for q, f, a in data:
            for p, g, b in data:
                if f == g and len(a) == len(b):
                    x, y = np.array([a]), np.array([b])
                    score = float(B.differing(x, y)[0, 0] if hamming else B.cosines(x, y)[0, 0])
                    want.setdefault((q, f), []).append((score if hamming else -score, p))
        want = sorted((f, q, p, s if hamming else -s, n + 1) for (q, f), found in want.items() for n, (s, p) in enumerate(sorted(found)[:6]))
        key = lambda d: sorted((r["family_id"], r["query_id"], r["protein_id"], r["score"] + 0.0, r["rank"]) for r in d.collect())
        for many in (16, 1):
            monkeypatch.setattr(B, "MANY", many)
            one, parts = B.top(asked, rows, 6, hamming), B.top(asked, rows, 6, hamming, block=7)
            assert key(one) == want and key(parts) == want
            assert ("Window" in parts._jdf.queryExecution().executedPlan().toString()) == (many == 1)


def test_norms_are_computed_once_a_row(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    out = rows.select(V.normalized(F.col("v")).alias("v"))
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r["v"] for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
