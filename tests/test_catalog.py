import numpy as np
import pytest

from helixframe.operators import graph as G
from helixframe.sources import sinks
from helixframe.sources.catalog import Catalogs


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": {"c": 1}}, "list": [1, 2]}')
    c = Catalogs.read(spark, {"own": f"file://{tmp_path}/c.json"})
    assert c.get("own", "a.b.c") == 1 and c.get("own", "a.x", None) is None and c.summary() == {"own": {"a": 1, "list": 2}}
    for path in ("a.x", "a.b.c.d"):
        with pytest.raises(KeyError):
            c.get("own", path)
    with pytest.raises(ValueError):
        Catalogs({"empty": {}})


def test_built_in_catalogs():
    s = Catalogs.built_in().summary()
    assert s["amino_acids"]["amino_acids"] == 20 and s["motif_patterns"]["motif_patterns"] == 24 and s["bioinformatics_databases"]["databases"] == 73
    assert Catalogs.built_in().get("amino_acids", "amino_acids.W.molecular_weight") == 204.2


def test_stored_embeddings(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    vectors = spark.createDataFrame([("p1", [1.0, 2.0]), ("p2", [3.0, 4.0])], "protein_id string, embedding array<double>")
    sinks.save_embeddings(vectors, path)
    assert sinks.load_embeddings(spark, path)[1] is None
    sinks.save_embeddings(vectors, path, spark.createDataFrame([("p1", "x"), ("p9", "y")], "protein_id string, name string"))
    back, meta = sinks.load_embeddings(spark, path)
    assert back.count() == 2 and [tuple(r) for r in meta.collect()] == [("p1", "x")]


def test_exports(spark, tmp_path):
    t = spark.createDataFrame([(1, [2], "a")], "id long, list array<long>, name string")
    sinks.export_flat({"t": t}, f"file://{tmp_path}/flat")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/flat/csv/t").columns == ["id", "name"]
    assert spark.read.json(f"file://{tmp_path}/flat/json/t").count() == 1
    plain = t.select("id", "name")
    sinks.export_network(f"file://{tmp_path}/net", plain, plain, t, t, t, t)
    assert len([p for p in (tmp_path / "net").iterdir() if p.is_dir()]) == 6
    sinks.save_properties({"nodes": 3}, str(tmp_path / "p.json"))
    assert sinks.load_properties(str(tmp_path / "p.json")) == {"nodes": 3}


def test_graphs_of_any_layout(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="edge" attr.name="weight" attr.type="double"/>
  <graph edgedefault="undirected"><node id="a &amp; b"/>
    <node id="c"><data key="x">y</data></node>
    <edge source="a &amp; b"
          target="c"><data key="d1">text</data>
      <data key="d0">0.25</data></edge>
    <edge source="c" target="c"/>
  </graph>
</graphml>""")
    nodes, edges = sinks.read_graph(spark, f"file://{tmp_path}/g.graphml")
    assert sorted(r["id"] for r in nodes.collect()) == ["a & b", "c"]
    assert sorted(tuple(r) for r in edges.collect()) == [("a & b", "c", 0.25), ("c", "c", 1.0)]


def test_gml(spark, tmp_path):
    nodes = spark.createDataFrame([("b",), ('a"',)], "id string")
    edges = spark.createDataFrame([('a"', "b", 0.5)], "src string, dst string, weight double")
    sinks.write_gml(nodes, edges, f"file://{tmp_path}/g")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    assert sorted(lines) == sorted(["graph [", '  node [ id 0 label "a&quot;" ]', '  node [ id 1 label "b" ]', "  edge [ source 0 target 1 weight 0.5 ]", "]"])


def test_stored_centroids_and_families(spark, tmp_path):
    np.savez(tmp_path / "c.npz", family_ids=np.array(["f1", "f2"]), centroids=np.eye(2, dtype=np.float32), eigenprotein_ids=np.array(["p1", "p2"]))
    got = sinks.load_centroids(spark, f"file://{tmp_path}/c.npz").orderBy("family_id").collect()
    assert [(r["family_id"], r["centroid"], r["representative"]) for r in got] == [("f1", [1.0, 0.0], "p1"), ("f2", [0.0, 1.0], "p2")]
    rows = spark.createDataFrame([(f"p{i}", f"fam/{i % 3}", [1.0]) for i in range(9)], "protein_id string, family_id string, embedding array<double>")
    sinks.store_families(rows, f"file://{tmp_path}/families")
    assert {r["family_id"] for r in sinks.load_families(spark, f"file://{tmp_path}/families", ["fam/0", "fam/2", "none"]).collect()} == {"fam/0", "fam/2"}


def test_members_fall_back(spark):
    rows = spark.createDataFrame([(f"p{i}", [float(i)]) for i in range(5)], "protein_id string, v array<double>")
    matches = spark.createDataFrame([("q1", "p3"), ("q1", "zz"), ("q2", "zz")], "query_id string, protein_id string")
    got = {(r["family_id"], r["protein_id"]) for r in G.members(matches, rows, 2).collect()}
    assert got == {("q1", "p3"), ("q2", "p0"), ("q2", "p1")}
    with pytest.raises(ValueError):
        G.build(rows, "other")
