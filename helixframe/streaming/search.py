"""Streams of queries against static family tables. Every step is stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import families as A
from ..operators import search as Q


def search_stream(queries: DataFrame, families: DataFrame, centroids: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10) -> StreamingQuery:
    """Assign and search each micro-batch of (protein_id, v) rows; ``sink`` gets the matches of every batch.

    ``families`` is read as it is when a batch runs; the bits of ``centroids`` are packed once, when the stream starts, so
    that batches leave nothing behind. A batch that is repeated after a failure gives the same rows, so a sink that overwrites
    by batch id holds each result once.
    """
    signs = A.Signs(centroids)

    def batch(rows: DataFrame, batch_id: int) -> None:
        q = A.assign(rows, signs, keep=("v",)).select("protein_id", "v", F.col("assigned").alias("family_id"))
        sink(Q.within_family(q, families, k), batch_id)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
