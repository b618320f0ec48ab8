import pytest
from pyspark.sql import functions as F

from helixframe import service
from helixframe.functions import embedding as E
from helixframe.functions import vectors as V
from helixframe.operators import families as A
from helixframe.plans.config import PipelineConfig
from helixframe.plans.stages import REGISTRY, execution_order, get_stage, run_pipeline
from helixframe.sources import records as R
from helixframe.plans import stages
from helixframe.streaming.search import search_stream

S1 = "MKTAYIAKQRQISFVKSHFSRQDILDLWIYHTQGYFPQ"


@pytest.fixture(scope="module")
def world(spark):
    base = [(f"k{i}", "x", (S1[i % 7 :] + S1[: i % 7]) * (1 + i % 2), None) for i in range(24)]
    records = spark.createDataFrame(base, R.SCHEMA)
    vectors = E.embed(records).select("protein_id", V.doubles(F.col("embedding")).alias("v"))
    families = vectors.withColumn("family_id", F.pmod(F.xxhash64("protein_id"), F.lit(3)).cast("int")).cache()
    return records, families


def test_full_run(spark, world, tmp_path):
    records, families = world
    query = spark.createDataFrame([("q1", "x", S1, None), ("q2", "x", S1 + "AAAA", None), ("bad", "x", "B4D", None)], R.SCHEMA)
    stages = ("input_validation", "data_extraction", "embedding_generation", "family_assignment", "similarity_search", "sequence_analysis", "structure_analysis", "network_analysis", "bioinformatics_analysis", "multi_protein_analysis", "report_generation", "visualization", "data_export")
    out = run_pipeline(spark, PipelineConfig("Records", query, stages, output_dir=f"file://{tmp_path}", stage_config={"replicates": 4}), families=families)
    assert out.success, out.error
    assert out.tables["records"].count() == 2 and out.tables["validation"].head()["invalid"] == 1
    assert out.tables["assignments"].count() == 2
    assert out.tables["matches"].where("similarity < 0.1").count() == 0
    assert out.tables["analyses"].where("protein_id = 'q1'").head()["length"] == 38
    assert out.tables["structure_classes"].count() == 2 and out.tables["dashboard"].count() == 2
    assert out.tables["plot"].where("class = 'query' and symbol = 'star'").count() == 2 and out.tables["places"].count() > 0
    assert out.tables["links"].count() == 146 and out.tables["conservation"].count() == 42
    assert out.tables["coverage"].head()["uniprot"] == 1.0 and out.tables["tree"].count() == 1
    assert [r["aligned"] for r in out.tables["alignment"].orderBy("protein_id").collect()] == [S1 + "----", S1 + "AAAA"]
    assert out.tables["dashboard"].where("n_nodes > 0").count() > 0 and out.tables["totals"].head()["proteins"] == 2
    assert {r["kind"]: r["n"] for r in out.tables["distributions"].groupBy("kind").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"family": 2, "confidence": 2, "length": 2, "similarity": out.tables["matches"].count()}
    assert out.tables["summary"].head()["avg_length"] == 40.0 and out.tables["network_summary"].head()["networks"] == 2
    figures = out.tables["alignment_summary"].head()
    assert (figures["proteins"], figures["places"], figures["avg_gap_share"]) == (2, 42, pytest.approx(4 / 42 / 2))
    page = (tmp_path / "report.html").read_text()
    assert all(f"<h2>{x}</h2><table>" in page for x in ("Summary", "Distributions", "Network figures", "Alignment"))
    assert "<h2>Similar proteins</h2><table>" in page and "Conserved regions" in page
    assert all(x["success"] for x in out.steps()) and out.summary()["success_rate"] == 1.0
    assert out.tables["exported"][0] == "records" and out.summary()["stages"] == len(stages)


def test_stops_and_fails(spark, world):
    records, families = world
    out = run_pipeline(spark, PipelineConfig("Records", records, stop_after_stage="data_extraction"))
    assert out.success and list(out.seconds) == ["input_validation", "data_extraction"]
    out = run_pipeline(spark, PipelineConfig("Records", records))
    assert not out.success and "families" in out.error
    for bad in (PipelineConfig(), PipelineConfig("Records", records, similarity_threshold=2), PipelineConfig("Records", records, max_similar=0), PipelineConfig("Records", records, ("nope",))):
        with pytest.raises(ValueError):
            run_pipeline(spark, bad)
    assert not run_pipeline(spark, PipelineConfig("Other", records)).success


def test_steps_count_what_they_write(spark, world):
    @stages.stage
    class Halves(stages.Stage):
        name, needs, gives, kept = "halves", (), ("first", "second"), ("first", "second")

        def run(self, spark, tables):
            return {"first": spark.range(7).toDF("x"), "second": spark.range(3).selectExpr("raise_error('no') as x") if tables.get("bad") else spark.range(5).toDF("x")}

    try:
        for bad in (False, True):
            r = stages.get_stage("halves")(PipelineConfig()).execute(spark, {"bad": bad})
            assert r.success != bad and r.written["first"][0] == 7 and r.written["first"][1] > 100
            assert r.written.keys() == ({"first"} if bad else {"first", "second"})
            out = stages.PipelineResult(r.success, r.output, {"halves": r.seconds}, r.error, {"halves": r.written})
            assert out.steps()[0]["rows"] == (7 if bad else 12) and out.steps()[0]["success"] != bad
    finally:
        stages.REGISTRY.pop("halves")


def test_registry():
    assert execution_order(("similarity_search", "data_extraction", "input_validation")) == ["input_validation", "data_extraction", "similarity_search"]
    assert len(REGISTRY) == 14
    with pytest.raises(ValueError):
        get_stage("nope")


def test_stored_object_is_tried_again(spark):
    calls = []

    def client(ref):
        calls.append(ref)
        if len(calls) < 3:
            raise OSError("busy")
        return "Objects.Genome-1.0", '{"label": "g", "features": [{"id": "f1", "type": "CDS", "protein_translation": "MK"}]}'

    stages = ("input_validation", "workspace_object")
    config = PipelineConfig("workspace_object", "1/2", stages, workspace_client=client, stage_config={"retry_wait": 0.0})
    out = run_pipeline(spark, config)
    assert out.success and len(calls) == 3 and [r["protein_id"] for r in out.tables["object"].collect()] == ["f1"]
    config.workspace_client = lambda ref: 1 / 0
    assert not run_pipeline(spark, config).success
    config.workspace_client = lambda ref: ("Other.Thing", "{}")
    assert "hold no proteins" in run_pipeline(spark, config).error


def test_inputs_are_checked(spark, world):
    records, _ = world
    one = ("input_validation",)
    assert run_pipeline(spark, PipelineConfig("Records", records, one, max_input_size=5)).tables["warnings"] == ["more than 5 inputs"]
    assert run_pipeline(spark, PipelineConfig("fasta_file", "x", one)).tables["input"] == ("FASTA", "x")
    assert "missing" in run_pipeline(spark, PipelineConfig("FASTA", " ", one)).error


def test_config_round_trip():
    assert PipelineConfig.from_dict(PipelineConfig().to_dict()) == PipelineConfig()


def test_service(spark, world):
    records, families = world
    asked = spark.createDataFrame([(" k1 ",), ("zz",)], "protein_id string")
    assert {r["protein_id"]: r["exists"] for r in service.check_existence(asked, families).collect()} == {"k1": True, "zz": False}
    e = service.generate_embeddings(records).head()
    assert e["dim"] == 320 and e["norm"] == pytest.approx(1, abs=1e-5)
    matches, stats = service.find_top_matches(families, families, 3)
    assert stats.count() > 0 and service.status(spark)["state"] == "OK"
    assert service.assign_family(families, A.centroids(families)).count() == 24


def test_stream(spark, world, tmp_path):
    _, families = world
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    families.limit(5).select("protein_id", "v").write.parquet(src)
    stream = spark.readStream.schema("protein_id string, v array<double>").parquet(src)
    q = search_stream(stream, families, A.centroids(families), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}"), f"file://{tmp_path}/cp", 3)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/0").count() > 0
