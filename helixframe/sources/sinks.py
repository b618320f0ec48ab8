"""Writing families, metadata, graphs, tables and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from .matrix import read_matrix

VECTOR_TYPES = ("array<float>", "array<double>", "array<tinyint>")


def store_families(rows: DataFrame, path: str, family_col: str = "family_id", vector_col: str = "embedding") -> None:
    """Parquet, one folder for each file-safe family; only float and bit vectors are taken."""
    kind = dict(rows.dtypes)[vector_col]
    if kind not in VECTOR_TYPES:
        raise ValueError(f"vectors of type {kind} cannot be stored; known: {', '.join(VECTOR_TYPES)}")
    safe = rows.withColumn("family_dir", S.file_safe(F.col(family_col).cast("string")))
    # rows of one family meet before they are written, in as many files as the family needs
    safe.repartition("family_dir", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(8))).write.mode("overwrite").partitionBy("family_dir").option("compression", "gzip").parquet(path)


def load_family(spark: SparkSession, path: str, family: str, start: int | None = None, end: int | None = None, order: str = "protein_id") -> DataFrame:
    """One family by partition pruning, or rows ``start`` to ``end`` (exclusive) of it in the order of ids."""
    from ..operators.families import ordinals

    safe = spark.range(1).select(S.file_safe(F.lit(family))).head()[0]
    rows = spark.read.parquet(path).where(F.col("family_dir") == safe)
    if start is None and end is None:
        return rows
    placed = ordinals(rows, by=order)
    return placed.where((F.col("ordinal") >= (start or 0)) & (F.col("ordinal") < (end if end is not None else 1 << 62)))


def load_metadata(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "protein_id") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").parquet(path)


def export_records(records: DataFrame, path: str) -> None:
    """CSV of id, sequence, source and length."""
    records.select("protein_id", "sequence", "source", F.length("sequence").alias("length")).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def graph_xml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML lines of one graph, in order: head, nodes, edges, tail."""
    spark = nodes.sparkSession
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(text).alias("value"))
    head = line(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">')
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\t", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(line(3, "</graph></graphml>")).orderBy("part", "key").select("value")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_xml(nodes, edges).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst, weight) of GraphML files of any layout; an edge's first number is its weight, 1 if it has
    none. Files are read in splits by their tags."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id string").select(F.col("_id").alias("id")).where("id is not null")
    edges = read("edge", "_source string, _target string, data array<struct<_VALUE: string, _key: string>>")
    numbers = F.filter(F.transform("data", lambda d: d["_VALUE"].try_cast("double")), lambda x: x.isNotNull())
    return nodes, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(F.get(numbers, F.lit(0)), F.lit(1.0)).alias("weight")).where("src is not null")


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One graph as GML text: nodes numbered in the order of their ids, with the ids as labels."""
    from ..operators.families import ordinals

    spark = nodes.sparkSession
    quoted = lambda c: F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    numbered = ordinals(nodes.select("id"), by="id")
    n = numbered.select(F.lit(1).alias("part"), F.col("ordinal").alias("key"), F.concat(F.lit("  node [ id "), F.col("ordinal").cast("string"), F.lit(' label "'), quoted(F.col("id")), F.lit('" ]')).alias("value"))
    number = lambda side: numbered.select(F.col("id").alias(side), F.col("ordinal").alias(f"{side}_n"))
    e = edges.join(number("src"), "src").join(number("dst"), "dst")
    e = e.select(F.lit(2).alias("part"), (F.col("src_n") * (1 << 31) + F.col("dst_n")).alias("key"), F.concat(F.lit("  edge [ source "), F.col("src_n").cast("string"), F.lit(" target "), F.col("dst_n").cast("string"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("value"))
    line = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(text).alias("value"))
    line(0, "graph [").unionByName(n).unionByName(e).unionByName(line(3, "]")).orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def load_families(spark: SparkSession, path: str, families: list[str]) -> DataFrame:
    """Several families by partition pruning; those that are not there give no rows."""
    safe = spark.createDataFrame([(f,) for f in families], "family string").select(S.file_safe(F.col("family"))).collect()
    return spark.read.parquet(path).where(F.col("family_dir").isin([r[0] for r in safe]))


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(family_id, centroid, representative): Parquet, or a NumPy archive of family_ids, centroids and eigenprotein_ids, whose members
    are read by ranges of rows and meet by row number."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path)
    part = lambda member, name, kind: read_matrix(spark, path, member).select("row", F.col("value").cast(kind).alias(name))
    rows = part("family_ids", "family_id", "string").join(part("centroids", "centroid", "array<double>"), "row")
    return rows.join(part("eigenprotein_ids", "representative", "string"), "row").drop("row")


def save_page(html: str, name: str, folder: str) -> str:
    """A small report file, written by the driver."""
    path = Path(folder) / (name if name.endswith(".html") else f"{name}.html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(html, encoding="utf-8")
    return str(path)


def load_page(name: str, folder: str) -> str:
    return (Path(folder) / (name if name.endswith(".html") else f"{name}.html")).read_text(encoding="utf-8")


def save_properties(properties: dict, path: str) -> None:
    Path(path).write_text(json.dumps(properties, indent=1, default=str), encoding="utf-8")


def load_properties(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_embeddings(vectors: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Vectors (protein_id, embedding) as Parquet, and the metadata of their ids as CSV beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
    if metadata is not None:
        metadata.join(vectors.select("protein_id"), "protein_id", "left_semi").write.mode("overwrite").option("header", True).csv(f"{path}/metadata")


def load_matrix(spark: SparkSession, path: str, ids: DataFrame | None = None, member: str | None = None) -> DataFrame:
    """Vectors (protein_id, embedding) of a NumPy file: ``ids`` gives (row, protein_id); without it the row number is the id."""
    rows = read_matrix(spark, path, member).select("row", F.col("value").alias("embedding"))
    if ids is None:
        return rows.select(F.col("row").cast("string").alias("protein_id"), "embedding")
    return rows.join(ids.select("row", "protein_id"), "row").select("protein_id", "embedding")


def load_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """What ``save_embeddings`` has written: vectors, and metadata if there are any."""
    meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    there = meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(meta)
    return spark.read.parquet(f"{path}/embeddings"), spark.read.option("header", True).csv(f"{path}/metadata") if there else None


def export_network(path: str, table: DataFrame, statistics: DataFrame, properties: DataFrame, clusters: DataFrame, payload: DataFrame, top: DataFrame) -> None:
    """The six parts of a network analysis: two CSV tables, three JSON tables, and the data of its picture."""
    for name, df in (("similarity_table", table), ("network_statistics", statistics)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    for name, df in (("network_properties", properties), ("clustering_analysis", clusters), ("top_similar_proteins", top), ("network_visualization", payload)):
        write_json(df, f"{path}/{name}")


def export_flat(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as JSON, and their columns of single values as CSV."""
    for name, df in tables.items():
        write_json(df, f"{path}/json/{name}")
        flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
        df.select(*(F.col(f"`{c}`") for c in flat)).write.mode("overwrite").option("header", True).csv(f"{path}/csv/{name}")
