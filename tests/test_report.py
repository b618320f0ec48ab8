import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.plans import report as W
from helixframe.sources import synthetic as Y


def test_page(spark):
    df = spark.createDataFrame([("<b>", 2), (None, 1)], "name string, n int")
    html = W.page("A & B", {"One": (df, ["n"])}, rows=5)
    assert "A &amp; B" in html and "&lt;b&gt;" in html and html.index("<td></td><td>1</td>") < html.index("&lt;b&gt;")


def test_scales(spark):
    r = spark.createDataFrame([(0.5, 0.9, 0.12345)], "a double, b double, c double").select(W.chart_scale(F.col("a")), W.chart_scale(F.col("b")), W.display_score(F.col("c"))).head()
    assert tuple(r) == (60.0, 95.0, pytest.approx(0.123))
    sizes = spark.createDataFrame([("g", 0, 0), ("h", 4, 6)], "graph string, n_nodes long, n_edges long")
    assert {x["graph"]: (x["edges_per_node"], x["avg_degree"]) for x in W.edge_ratios(sizes).collect()} == {"g": (0.0, 0.0), "h": (1.5, 3.0)}


def test_figures_of_odd_tables(spark):
    """Ends of ranges, unknown families, null lengths, and empty tables."""
    fields = "protein_id string, length int, family string, confidence double, n_similar long, best_similarity double, n_nodes long, n_edges long"
    rows = [("a", 100, "x", 0.2, 1, 0.9, 4, 2), ("b", 101, "x", 1.0, 0, 0.0, 4, 2), ("c", None, "Unknown", 0.0, 0, 0.0, 0, 0), ("d", 0, "y", 0.59, 2, 0.5, 1, 0), ("e", 5000, "y", 0.6, 0, 0.0, 1, 0)]
    table = spark.createDataFrame(rows, fields)
    matches = spark.createDataFrame([("a", -0.5), ("a", 0.8), ("d", None)], "query_id string, similarity double")
    got = {(r["kind"], r["range"]): r["n"] for r in W.distributions(table, matches).collect()}
    count = lambda kind: [got[kind, x] for x in (W.T.LENGTHS if kind == "length" else W.SCORES)]
    assert (count("length"), count("confidence"), count("similarity")) == ([2, 1, 0, 0, 1], [1, 1, 1, 1, 1], [1, 0, 0, 0, 1])
    assert {k[1]: n for k, n in got.items() if k[0] == "family"} == {"x": 2, "y": 2, "Unknown": 1}
    s = W.summary(table).head()
    assert (s["proteins"], s["families"], s["avg_length"], s["avg_network_size"]) == (5, 2, pytest.approx(5201 / 4), 2.0)
    empty = W.distributions(table.limit(0), matches.limit(0)).collect()
    assert len(empty) == 15 and {r["n"] for r in empty} == {0}
    assert tuple(W.summary(table.limit(0)).head()) == (0, 0, None, None, None, None)
    sizes = spark.createDataFrame([("g", 0, 0, 0.0), ("h", 4, 6, 1.0)], "graph string, n_nodes long, n_edges long, density double")
    assert tuple(W.network_summary(sizes).head()) == (2, 1, 2.0, 3.0, 0.5)


def test_synthetic(spark):
    rows = Y.families(spark, 3, 40, 16).collect()
    v = np.array([r["embedding"] for r in rows]).reshape(3, 40, 16)
    assert rows[0]["protein_id"] == "P00000" and {r["family_id"] for r in rows} == {"family_0", "family_1", "family_2"}
    assert 0.4 < v.std(axis=1).mean() < 0.6 and v.mean(axis=1).std() > 2
    assert rows == Y.families(spark, 3, 40, 16).repartition(3).orderBy("protein_id").collect()
    seqs = Y.sequences(spark, 20)
    assert seqs.where(S.is_valid(F.col("sequence"))).count() == 20 and seqs.where("length(sequence) not between 50 and 500").count() == 0


def test_distributions_search_once(spark, monkeypatch):
    from helixframe.plans import sequence_queries as R

    within, asked = R.Q.within_family, []
    monkeypatch.setattr(R.Q, "within_family", lambda *a, **k: asked.append(a) or within(*a, **k))
    R.dashboard_distributions(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1
