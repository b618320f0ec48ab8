"""The calls that a service offers, over DataFrames."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import embedding as E
from .functions import vectors as V
from .operators import families as A
from .operators import graph as G
from .operators import search as Q
from .plans.config import PipelineConfig
from .plans.stages import PipelineResult, run_pipeline
from .session import Scratch


def check_existence(ids: DataFrame, proteins: DataFrame) -> DataFrame:
    return A.existence(ids, proteins)


def generate_embeddings(records: DataFrame, make=E.kmer_hash) -> DataFrame:
    """protein_id, embedding, its norm, dimension and the sequence's length."""
    lengths = records.select("protein_id", F.length(F.trim("sequence")).alias("sequence_length"))
    vectors = E.embed(records, make)
    return vectors.join(lengths, "protein_id").select("protein_id", "embedding", V.norm(V.doubles(F.col("embedding"))).alias("norm"), F.size("embedding").alias("dim"), "sequence_length")


def assign_family(vectors: DataFrame, centroids: DataFrame, min_confidence: float | None = None) -> DataFrame:
    return A.assign(vectors, centroids, min_confidence)


def find_top_matches(queries: DataFrame, proteins: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Matches within the queries' families, and statistics of each query's."""
    matches = Q.within_family(queries, proteins, k)
    return matches, Q.stats(matches)


def analyze_network(proteins: DataFrame, method: str = "mutual_knn", k: int = 8, threshold: float = 0.1) -> dict[str, DataFrame]:
    """All that is known of the graph of each family of (protein_id, family_id, v): ``nodes`` and ``edges`` (written once), ``properties`` of
    each graph with its communities and their modularity, and ``statistics`` of each node (degree, triangles, clustering,
    component, community, centralities; nodes without edges have centralities of 0)."""
    work = Scratch(proteins.sparkSession, "network")
    nodes, edges = G.build(proteins, method, k, threshold)
    nodes, edges = work.table(nodes, "nodes"), work.table(edges, "edges")
    parts = work.table(G.communities(nodes, edges), "communities")
    quality = G.modularity(parts.withColumnRenamed("community", "component"), edges).select("graph", "n_communities", "modularity")
    central = G.centralities(edges)
    own = [c for c in central.columns if c not in ("graph", "id")]
    nodewise = G.clustering(nodes, edges).join(G.components(nodes, edges), ["graph", "id"]).join(parts, ["graph", "id"]).join(central, ["graph", "id"], "left")
    return {"nodes": nodes, "edges": edges, "properties": G.properties(nodes, edges).join(quality, "graph"), "statistics": work.table(nodewise.fillna(0, own), "statistics")}


def summarize(**tables: DataFrame) -> dict[str, object]:
    """Columns and number of rows of each table."""
    return {"count": len(tables), "columns": {name: df.columns for name, df in tables.items()}, "rows": {name: df.count() for name, df in tables.items()}}


def run(spark: SparkSession, config: PipelineConfig, **tables: DataFrame) -> PipelineResult:
    return run_pipeline(spark, config, **tables)


def status(spark: SparkSession) -> dict[str, str]:
    return {"state": "OK", "version": __version__, "spark": spark.version, "python": platform.python_version()}
