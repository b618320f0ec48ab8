"""Approximate nearest neighbours: one navigable small-world graph for each shard, shard results merged.

Rows are dealt to shards by a hash of vec_id, about ``shard_rows`` to each, so any group of equal vectors spreads evenly. A
shard's graph is built over its distinct vectors and stored as flat neighbour arrays, one row of a table for each shard. A
task builds or searches one shard in memory, about 1 KB a row at 64 components; the larger the shards, the smaller the share
of them that a query visits.

Queries are put into blocks of ``block`` rows, and the blocks are joined to the shards, so tasks meet one block and one shard
at a time and neither the driver nor a broadcast holds vectors. Each shard gives its ``k`` best, measured again in double
precision on the original vectors, and the best over all shards stay, ties to the smaller vec_id. Equal vectors share a node
that keeps all their ids in order, so ties among them are exact.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither do rows with null
vec_id or of another length than the first valid vector's (by vec_id); of rows with equal vec_id the smallest vector counts;
with fewer than ``k`` candidates all are returned; of queries with equal vec_id the smallest vector counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hnsw import Hnsw
from .runtime import Scratch, pick, prepare, tidy

#: Rows of a shard.
SHARD_ROWS = 16_384
RESULT = "query_id long, vec_id long, score double"


def valid(col: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, all components finite."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def _build(m: int, ef: int):
    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("vec_id").to_pylist(), dtype=np.int64)
        vec = np.array(table.column("v").to_pylist(), dtype=np.float64)
        order = np.lexsort((*vec.T[::-1], ids))
        ids, vec = ids[order], vec[order]
        first = np.append(True, ids[1:] != ids[:-1])
        ids, vec = ids[first], vec[first]
        nodes, node = np.unique(vec, axis=0, return_inverse=True)
        node = node.ravel()
        by = np.lexsort((ids, node))
        graph = Hnsw(nodes, m, ef)
        row = {"shard": [table.column("shard")[0].as_py()], "ids": [ids[by].astype("<i8").tobytes()], "ends": [np.cumsum(np.bincount(node, minlength=len(nodes))).astype("<i8").tobytes()], "vectors": [nodes.astype("<f8").tobytes()]} | {k: [v] for k, v in graph.to_arrays().items()}
        return pa.table(row, schema=_INDEX)

    return run


_INDEX = pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in ("ids", "ends", "vectors", "graph_order", "graph_sizes", "graph_links"))])


class VectorIndex:
    """The stored shards of a table (vec_id, embedding)."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS, m: int = 24, ef_build: int = 96):
        spark = rows.sparkSession
        prepare(spark)
        self.m, self.work = m, Scratch(spark, "vectors")
        self.rows = pick(rows, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
        n, first = self.rows.agg(F.count("*"), F.min_by(F.size("embedding"), "vec_id")).head()
        self.dim = first or 0
        self.rows = self.rows.where(F.size("embedding") == self.dim).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        self.shards = max(1, -(-n // shard_rows))
        dealt = self.rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(self.shards)).cast("int"))
        schema = "shard int, " + ", ".join(f"{f.name} binary" for f in _INDEX if f.name != "shard")
        self.table = self.work.table(dealt.groupBy("shard").applyInArrow(_build(m, ef_build), schema), "index")

    def search(self, queries: DataFrame, k: int = 10, ef: int = 128, block: int = 4096) -> DataFrame:
        """The ``k`` nearest rows of each query (vec_id, v) but its own: query_id, rank, vec_id, score."""
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
        queries = self.work.table(queries, f"queries-{uuid.uuid4().hex}")
        blocks = max(1, -(-queries.count() // block))
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
        dealt = self.work.table(dealt.groupBy("block").applyInArrow(_block, "q_ids binary, q_vectors binary"), f"blocks-{uuid.uuid4().hex}")
        spread = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        met = self.table.repartition(self.shards, "shard").join(spread.repartition(self.shards, "shard").hint("merge"), "shard")
        out = met.mapInArrow(tidy(_search(self.dim, self.m, k, ef)), RESULT)
        ranked = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
        return ranked.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), "b.vec_id", "b.score")


def _block(table: pa.Table) -> pa.Table:
    ids, vec = np.array(table.column("vec_id").to_pylist(), dtype="<i8"), np.array(table.column("v").to_pylist(), dtype="<f8")
    return pa.table({"q_ids": pa.array([ids.tobytes()], pa.binary()), "q_vectors": pa.array([vec.tobytes()], pa.binary())})


def _search(dim: int, m: int, k: int, ef: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                q_ids, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_vectors"], "<f8").reshape(-1, dim)
                ids, ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
                nodes = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
                graph = Hnsw.from_arrays(nodes.astype(np.float32), m, row["graph_order"], row["graph_sizes"], row["graph_links"])
                found = graph.search(q, k + 1, ef)
                out: list[tuple[int, int, float]] = []
                for own, v, near in zip(q_ids.tolist(), q, found):
                    near = near[near >= 0]
                    d = np.sqrt(((nodes[near] - v) ** 2).sum(axis=1))
                    hits = [(s, i) for s, n in zip(d.tolist(), near.tolist()) for i in ids[ends[n - 1] if n else 0 : ends[n]][: k + 1].tolist() if i != own]
                    out += [(own, i, s) for s, i in sorted(hits)[:k]]
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest of each row whose vec_id is divisible by ``every``, among all other rows."""
    index = VectorIndex(rows)
    return index.search(index.rows.where(F.col("vec_id") % every == 0), k)
