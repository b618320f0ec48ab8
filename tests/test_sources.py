import json

import pytest
from pyspark.sql import functions as F

from helixframe.sources import records as R
from helixframe.sources import sinks

FASTA = """>protein1|P12345|Test protein 1
MKTAYIAKQRQISFVKSHFSRQ
DILDLWIYHTQGYFPQ
>protein2|P67890|Test > protein 2
MKTGFLVKQRQISFVKSHFSRQDILDLWIYHTQGYFPQ
>empty header
"""


def read(spark, tmp_path, text, name="x.fasta"):
    (tmp_path / name).write_text(text)
    return {r["protein_id"]: r["sequence"] for r in R.read_fasta(spark, f"file://{tmp_path}").collect()}


def test_fasta(spark, tmp_path):
    got = read(spark, tmp_path, FASTA)
    assert got == {"protein1|P12345|Test": "MKTAYIAKQRQISFVKSHFSRQDILDLWIYHTQGYFPQ", "protein2|P67890|Test": "MKTGFLVKQRQISFVKSHFSRQDILDLWIYHTQGYFPQ"}
    got = read(spark, tmp_path, "stray text\n>a\nMK\n", "y.fasta")
    assert "stray" not in got and got["a"] == "MK" and len(got) == 3


def test_fasta_edge_cases(spark, tmp_path):
    assert read(spark, tmp_path, "") == {}
    assert read(spark, tmp_path, ">only a header\n") == {}


def test_objects(spark):
    features = [{"id": "f1", "type": "CDS", "protein_translation": "MK"}, {"id": "f2", "type": "gene", "protein_translation": "MK"}, {"id": "f3", "type": "CDS", "protein_translation": ""}]
    rows = spark.createDataFrame([(json.dumps({"label": "g", "features": features}),), ("broken",)], "value string")
    got = R.parse_input(spark, "Genome", rows).collect()
    assert [(r["protein_id"], r["sequence"], r["metadata"]["length"], r["metadata"]["feature_type"]) for r in got] == [("f1", "MK", "2", "CDS")]
    assert [r["protein_id"] for r in R.parse_input(spark, "GenomeSet", rows).collect()] == ["g_f1"]
    sets = spark.createDataFrame([(json.dumps({"proteins": [{"id": "a", "sequence": "MK"}]}),)], "value string")
    assert R.parse_input(spark, "ProteinSequenceSet", sets).head()["protein_id"] == "a"
    elements = spark.createDataFrame([(json.dumps({"elements": features}),)], "value string")
    assert {r["protein_id"] for r in R.parse_input(spark, "FeatureSet", elements).collect()} == {"f1", "f2"}
    assert R.parse_input(spark, "SingleProtein", "MK").head()["protein_id"] == "single_protein"
    known = spark.createDataFrame([("P1", "MK"), ("P2", "MA")], "protein_id string, sequence string")
    assert [r["protein_id"] for r in R.parse_input(spark, "Uniprot", (" P2 , P9,", known)).collect()] == ["P2"]
    with pytest.raises(ValueError):
        R.parse_input(spark, "Other", None)


def test_input_kind(spark):
    rows = spark.createDataFrame([("x.GenomeSet-1",), ("x.Genome-1",), ("x.FeatureSet",), ("y",)], "t string")
    assert [r["k"] for r in rows.select(R.input_kind(F.col("t")).alias("k")).collect()] == ["GenomeSet", "Genome", "FeatureSet", "FASTA"]


def test_family_store(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("protein_id"), F.when(F.col("id") < 40, "a b").otherwise("c/d").alias("family_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    path = f"file://{tmp_path}/families"
    sinks.store_families(rows, path)
    assert sinks.load_family(spark, path, "a b").count() == 40
    assert {r["protein_id"] for r in sinks.load_family(spark, path, "a b", 10, 30).collect()} == {f"p{i:03d}" for i in range(10, 30)}
    assert "PartitionFilters: [isnotnull(family_dir" in sinks.load_family(spark, path, "c/d")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        sinks.store_families(rows.withColumn("embedding", F.lit("x")), path)


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b",), ('q"&',), ("lone",)], "id string")
    edges = spark.createDataFrame([("a<b", 'q"&', 0.25)], "src string, dst string, weight double")
    sinks.write_graph(nodes, edges, f"file://{tmp_path}/g")
    n, e = sinks.read_graph(spark, f"file://{tmp_path}/g")
    assert {r["id"] for r in n.collect()} == {"a<b", 'q"&', "lone"}
    assert [tuple(r) for r in e.collect()] == [("a<b", 'q"&', 0.25)]


def test_export_and_pages(spark, tmp_path):
    R_ = R.single(spark, "MK")
    sinks.export_records(R_, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").head()["length"] == "2"
    sinks.save_page("<p>ä</p>", "r", str(tmp_path))
    assert sinks.load_page("r", str(tmp_path)) == "<p>ä</p>"
