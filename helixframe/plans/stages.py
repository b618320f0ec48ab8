"""Pipeline stages: each maps the DataFrames it needs to new ones. Tables that several later stages read are written to the
shared folder once (``kept``); all others are plans that run with an action."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import sequence as S
from ..functions import vectors as V
from ..operators import alignment as M
from ..operators import families as A
from ..operators import graph as G
from ..operators import search as Q
from ..operators import stats as T
from ..operators.align import center_star
from ..session import Scratch
from ..sources import records as R
from ..sources import sinks
from . import report as W
from .config import ORDER, PipelineConfig


@dataclass
class StageResult:
    success: bool
    output: dict[str, object] = field(default_factory=dict)
    seconds: float = 0.0
    error: str | None = None
    #: Rows and bytes of each table that the stage has written.
    written: dict[str, tuple[int, int]] = field(default_factory=dict)


class Stage(ABC):
    """One step. ``needs`` and ``gives`` name the tables it reads and adds, ``kept`` those of them that are written; ``after``
    the stages it depends on."""

    name = ""
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()
    after: tuple[str, ...] = ()

    def __init__(self, config: PipelineConfig):
        self.config = config

    @abstractmethod
    def run(self, spark: SparkSession, tables: dict[str, object]) -> dict[str, object]: ...

    def before(self, tables: dict) -> dict:
        return tables

    def done(self, result: StageResult) -> StageResult:
        return result

    def execute(self, spark: SparkSession, tables: dict[str, object]) -> StageResult:
        began = time.monotonic()
        if missing := [n for n in self.needs if n not in tables]:
            return StageResult(False, error=f"{self.name} needs {', '.join(missing)}")
        written: dict[str, tuple[int, int]] = {}
        try:
            output = self.run(spark, self.before(tables))
            work = Scratch(spark, self.name) if self.kept else None
            for n in self.kept:
                if n in output:
                    output[n], *written[n] = work.measured(output[n], n)
            result = StageResult(True, output)
        except Exception as e:  # a failed stage ends the run with its message
            result = StageResult(False, error=f"{self.name}: {e}")
        result.written = {n: tuple(v) for n, v in written.items()}
        result.seconds = time.monotonic() - began
        return self.done(result)


REGISTRY: dict[str, type[Stage]] = {}


def stage(cls: type[Stage]) -> type[Stage]:
    REGISTRY[cls.name] = cls
    return cls


def get_stage(name: str) -> type[Stage]:
    if name not in REGISTRY:
        raise ValueError(f"unknown stage {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


@stage
class InputValidation(Stage):
    """Checks the type against the known ones and the required inputs; inputs over ``max_input_size`` get a warning."""

    name, gives = "input_validation", ("input", "warnings")

    def run(self, spark, tables):
        kind, data = self.config.input_type, self.config.input_data
        if kind not in (*R.FORMATS, *R.ALIASES, "Records"):
            raise ValueError(f"unsupported input type {kind!r}")
        if missing := [n for n, v in (("input_type", kind), ("input_data", data)) if v is None or isinstance(v, str) and not v.strip()]:
            raise ValueError(f"missing inputs: {', '.join(missing)}")
        most, warnings = self.config.max_input_size, []
        if most and isinstance(data, DataFrame) and data.limit(most + 1).count() > most:
            warnings.append(f"more than {most} inputs")
        return {"input": (R.ALIASES.get(kind, kind), data), "warnings": warnings}


@stage
class DataExtraction(Stage):
    name, needs, gives, after = "data_extraction", ("input",), ("records", "validation"), ("input_validation",)

    def run(self, spark, tables):
        kind, data = tables["input"]
        records = data if kind == "Records" else R.parse_input(spark, kind, data)
        if self.config.max_proteins is not None:
            records = records.orderBy("protein_id").limit(self.config.max_proteins)
        return {"records": R.valid_records(records), "validation": T.validation(records, S.is_valid(F.col("sequence")))}


@stage
class WorkspaceObject(Stage):
    """Stored objects as records. ``workspace_client`` is a function from a reference to (type name, JSON text), tried three
    times; without one the input data are the objects."""

    name, needs, gives, after = "workspace_object", ("input",), ("object", "object_info"), ("input_validation",)

    def run(self, spark, tables):
        kind, data = tables["input"]
        client = self.config.workspace_client
        if client is None:
            return {"object": R.parse_input(spark, kind, data), "object_info": {"type": kind}}
        type_name, text = R.fetch_object(client, data, wait=self.config.stage_config.get("retry_wait", 1.0))
        found = spark.range(1).select(R.input_kind(F.lit(type_name))).head()[0]
        if found == "FASTA":
            raise ValueError(f"objects of type {type_name!r} hold no proteins")
        return {"object": R.parse_input(spark, found, spark.createDataFrame([(text,)], "value string")), "object_info": {"ref": data, "type": type_name, "format": found}}


@stage
class EmbeddingGeneration(Stage):
    name, needs, gives, after = "embedding_generation", ("records",), ("vectors",), ("data_extraction",)

    kept = ("vectors",)

    def run(self, spark, tables):
        make = self.config.stage_config.get("embedder", E.kmer_hash)
        return {"vectors": E.embed(tables["records"], make).select("protein_id", V.doubles(F.col("embedding")).alias("v"))}


@stage
class FamilyAssignment(Stage):
    """Needs the family table (protein_id, family_id, v) that the run was given."""

    name, needs, gives, after = "family_assignment", ("vectors", "families"), ("assignments", "centroids"), ("embedding_generation",)

    kept = ("assignments", "centroids")

    def run(self, spark, tables):
        cents = tables.get("centroids") or A.centroids(tables["families"])
        return {"centroids": cents, "assignments": A.assign(tables["vectors"], cents, self.config.min_confidence)}


@stage
class SimilaritySearch(Stage):
    name, needs, gives, after = "similarity_search", ("vectors", "assignments", "families"), ("matches", "search_stats"), ("family_assignment",)

    kept = ("matches",)

    def run(self, spark, tables):
        q = tables["vectors"].join(tables["assignments"].select("protein_id", F.col("assigned").alias("family_id")), "protein_id")
        matches = Q.within_family(q, tables["families"], min(self.config.top_k, self.config.max_similar), self.config.similarity_threshold)
        return {"matches": matches, "search_stats": Q.stats(matches)}


@stage
class SequenceAnalysis(Stage):
    name, needs, gives, after = "sequence_analysis", ("records",), ("analyses", "length_summary"), ("data_extraction",)

    def run(self, spark, tables):
        s = S.clean(F.col("sequence"))
        analyses = tables["records"].select(
            "protein_id",
            F.length(s).alias("length"),
            S.molecular_weight(s).alias("molecular_weight"),
            S.net_charge(s).alias("net_charge"),
            S.gravy(s).alias("gravy"),
            S.isoelectric_point(s).alias("isoelectric_point"),
            S.extinction(s).alias("extinction"),
            S.instability(s).alias("instability_index"),
            S.aliphatic_index(s).alias("aliphatic_index"),
            S.structure(s).alias("structure"),
            F.map_from_arrays(F.array(*map(F.lit, S.K.AMINO_ACIDS)), F.array(*S.counts(s).values())).alias("composition"),
            F.map_from_arrays(F.array(*map(F.lit, S.K.GROUPS)), F.array(*(S.group_count(s, g) for g in S.K.GROUPS))).alias("groups"),
            F.map_from_arrays(F.array(*map(F.lit, S.K.MOTIFS)), F.array(*(S.motif_count(s, m) for m in S.K.MOTIFS))).alias("motifs"),
            S.database_links(F.col("protein_id")).alias("links"),
        )
        return {"analyses": analyses, "length_summary": tables["records"].agg(F.count("*").alias("n"), F.avg(F.length("sequence")).alias("mean_length"))}


@stage
class StructureAnalysis(Stage):
    name, needs, gives, after = "structure_analysis", ("analyses",), ("structure_classes",), ("sequence_analysis",)

    def run(self, spark, tables):
        a = tables["analyses"]
        return {"structure_classes": a.select("protein_id", S.structure_class(F.col("molecular_weight"), F.col("instability_index"), F.col("isoelectric_point")).alias("class"))}


@stage
class NetworkAnalysis(Stage):
    """One graph for each query: the query, its matches, and the edges among them."""

    name, needs, gives, after = "network_analysis", ("vectors", "matches", "families"), ("nodes", "edges", "network_stats"), ("similarity_search",)

    kept = ("nodes", "edges", "network_stats")

    def run(self, spark, tables):
        hit = G.members(tables["matches"].withColumn("query_id", F.col("query_id").cast("string")), tables["families"])
        own = tables["vectors"].select(F.col("protein_id").cast("string").alias("family_id"), F.concat(F.lit("query:"), F.col("protein_id")).alias("protein_id"), "v")
        rows = hit.select("family_id", F.col("protein_id").cast("string").alias("protein_id"), "v").unionByName(own)
        nodes, edges = G.build(rows, self.config.network_method, self.config.neighbours, self.config.similarity_threshold)
        return {"nodes": nodes, "edges": edges, "network_stats": G.density(nodes, edges)}


@stage
class BioinformaticsAnalysis(Stage):
    name, needs, gives, after = "bioinformatics_analysis", ("records",), ("links", "coverage"), ("data_extraction",)

    def run(self, spark, tables):
        linked = tables["records"].select("protein_id", S.database_links(F.col("protein_id")).alias("links"))
        return {"links": linked.select("protein_id", F.explode("links").alias("database", "url")), "coverage": T.coverage(linked, sorted(S.K.DATABASES))}


@stage
class MultiProteinAnalysis(Stage):
    """Pairs, an alignment with its conserved regions, a supported tree and clusters of a set of at most ``max_aligned`` records."""

    name, needs, gives, after = "multi_protein_analysis", ("records",), ("pairs", "identities", "alignment", "conservation", "conservation_statistics", "regions", "tree", "clusters"), ("data_extraction",)

    def run(self, spark, tables):
        records, most = tables["records"], self.config.stage_config.get("max_aligned", G.WHOLE)
        n = records.limit(most + 1).count()
        if n < 2:
            raise ValueError("two proteins or more are needed")
        if n > most:
            raise ValueError(f"more than {most} proteins cannot be compared with each other")
        pairs = M.pairs(records)
        align = self.config.stage_config.get("aligner", center_star)
        alignment = Scratch(spark, "alignment").table(align(records), "alignment")
        scores = M.conservation(M.column_counts(alignment))
        figures = M.conservation_statistics(scores)
        threshold = figures.head()["threshold"]
        tree = M.bootstrap_support(alignment, self.config.stage_config.get("replicates", 100), score=self.config.stage_config.get("substitution"))
        return {"pairs": M.distance(pairs), "identities": M.identity(pairs), "alignment": alignment, "conservation": scores, "conservation_statistics": figures,
                "regions": M.regions(scores, threshold if threshold is not None else 0.0), "tree": tree, "clusters": M.ward_clusters(M.distance(pairs))}


@stage
class ReportGeneration(Stage):
    """The dashboard, its totals and distributions, figures of the networks and the alignment that the run has, and a page of
    all tables; the page goes to ``output_dir`` if it is local."""

    name, needs, gives, after = "report_generation", ("records", "assignments", "matches"), ("dashboard", "totals", "summary", "distributions", "page"), ("similarity_search", "network_analysis", "multi_protein_analysis")

    def run(self, spark, tables):
        sizes = spark.createDataFrame([], "graph string, n_nodes long, n_edges long")
        assigned = tables["assignments"].withColumn("assigned", F.col("assigned").cast("string"))
        if isinstance(tables.get("network_stats"), DataFrame):  # graphs are named by their query; the dashboard asks by family
            of = assigned.select(F.col("protein_id").alias("graph"), "assigned")
            sizes = tables["network_stats"].join(of, "graph").groupBy("assigned").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges")).withColumnRenamed("assigned", "graph")
        dashboard = T.dashboard(tables["records"].select("protein_id", F.length("sequence").alias("length")), assigned, tables["matches"], sizes)
        dashboard = Scratch(spark, "report").table(dashboard, "dashboard")  # several figures read it
        figures = {"dashboard": dashboard, "summary": W.summary(dashboard), "distributions": W.distributions(dashboard, tables["matches"])}
        if isinstance(tables.get("network_stats"), DataFrame):
            figures["network_summary"] = W.network_summary(tables["network_stats"])
        if isinstance(tables.get("alignment"), DataFrame) and isinstance(tables.get("conservation"), DataFrame):
            figures["alignment_summary"] = W.alignment_summary(tables["alignment"], tables["conservation"])
        html = W.full_page("Protein report", tables | figures)
        folder = self.config.output_dir
        if folder and folder.startswith(("/", "file://")):
            sinks.save_page(html, "report", folder.removeprefix("file://"))
        return figures | {"totals": T.dashboard_totals(dashboard), "page": html}


@stage
class Visualization(Stage):
    """What a plot of each graph shows: of each node the twelve fields of its label, its class, style and place."""

    name, needs, gives, after = "visualization", ("nodes", "edges"), ("plot", "places"), ("network_analysis",)

    def run(self, spark, tables):
        nodes, edges = tables["nodes"], tables["edges"]
        queries = nodes.where(F.col("id").startswith("query:")).select("graph", F.col("id").alias("query_id"))
        near = G.both_ways(edges).join(queries, (F.col("src") == F.col("query_id")) & (edges["graph"] == queries["graph"]), "left_semi")
        weights = near.select("graph", F.col("dst").alias("id"), F.col("weight").alias("similarity"))
        if isinstance(tables.get("matches"), DataFrame):
            weights = tables["matches"].select(F.col("query_id").cast("string").alias("graph"), F.col("protein_id").cast("string").alias("id"), "similarity")
        fields = "id string, name string, organism string, ec string, function string, family string, reviewed string"
        meta = tables.get("metadata") or spark.createDataFrame([], fields)
        plot = G.node_payload(nodes, edges, G.components(nodes, edges), queries, weights, meta)
        return {"plot": plot, "places": G.layout(edges)}


@stage
class DataExport(Stage):
    name, needs, gives, after = "data_export", ("records",), ("exported",), ("data_extraction",)

    def run(self, spark, tables):
        if not self.config.output_dir:
            raise ValueError("data_export needs output_dir")
        sinks.export_records(tables["records"], f"{self.config.output_dir}/records")
        done = ["records"]
        for name in ("assignments", "matches", "edges", "dashboard"):
            if isinstance(tables.get(name), DataFrame):
                sinks.write_json(tables[name], f"{self.config.output_dir}/{name}")
                done.append(name)
        return {"exported": done}


@dataclass
class PipelineResult:
    success: bool
    tables: dict[str, object]
    seconds: dict[str, float]
    error: str | None = None
    written: dict[str, dict[str, tuple[int, int]]] = field(default_factory=dict)

    def summary(self) -> dict[str, object]:
        n, failed = len(self.seconds), int(self.error is not None)
        return {"success": self.success, "stages": n, "total_seconds": sum(self.seconds.values()), "error": self.error, "success_rate": (n - failed) / n if n else 0.0}

    def steps(self) -> list[dict[str, object]]:
        """Of each stage its seconds, whether it succeeded, how many tables and other values it gave, and the rows and bytes of
        those that it wrote, as the writing itself counted them; a failed stage has what it wrote before."""
        last = list(self.seconds)[-1:] if self.error is not None else []
        sums = {n: [sum(x) for x in zip(*self.written.get(n, {}).values())] or [0, 0] for n in self.seconds}
        return [{"stage": n, "seconds": s, "success": n not in last, "outputs": sum(g in self.tables for g in get_stage(n).gives), "rows": sums[n][0], "bytes": sums[n][1]} for n, s in self.seconds.items()]


def execution_order(names: tuple[str, ...]) -> list[str]:
    """The named stages with dependencies first; dependencies that were not named are left out."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_:
            raise ValueError(f"stages depend on each other: {name}")
        open_.add(name)
        for dep in get_stage(name).after:
            if dep in names:
                visit(dep)
        out.append(name)

    for name in sorted(names, key=ORDER.index):
        visit(name)
    return out


def run_pipeline(spark: SparkSession, config: PipelineConfig, **tables: object) -> PipelineResult:
    """Run the configured stages; ``tables`` may give ``families``, ``centroids`` and others ready-made."""
    config.check()
    seconds: dict[str, float] = {}
    written: dict[str, dict[str, tuple[int, int]]] = {}
    for name in execution_order(config.stages):
        result = get_stage(name)(config).execute(spark, tables)
        seconds[name], written[name] = result.seconds, result.written
        if not result.success:
            return PipelineResult(False, tables, seconds, result.error, written)
        tables |= result.output
        if name == config.stop_after_stage:
            break
    return PipelineResult(True, tables, seconds, None, written)
