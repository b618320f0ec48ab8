"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def _hooked(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(id, label): every endpoint with the root it comes to by going on to the smallest neighbour as long as that is smaller."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{name}-0")
    jump = 0
    while True:  # every step doubles the way, so that a path of n ends takes log n of them
        step = hook.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jump += 1
        far = work.table(hook.join(step, "label").select("id", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), f"{name}-{jump}")
        hook = far.select("id", "label")
        if far.where("moved").isEmpty():
            return hook


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(id, label): for each endpoint of ``edges`` (a, b) the smallest id of its component.

    Each round hooks every vertex to the root of its way down and relabels the edges by roots; edges inside a label vanish.
    A root with an edge left is hooked or hooks another in the next round, so the labels at least halve and rounds end by
    themselves. All steps are sums and joins on written tables that AQE may split.
    """
    labels = _hooked(edges, work, "hook-0")
    hook, left, i = labels, edges.where("a <> b"), 0
    while True:
        i += 1
        p = hook.select(F.col("id").alias("a"), F.col("label").alias("pa"))
        q = hook.select(F.col("id").alias("b"), F.col("label").alias("pb"))
        left = left.join(p, "a").join(q, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = work.table(left, f"edges-{i}")
        if left.isEmpty():
            return labels
        hook = _hooked(left, work, f"hook-{i}")
        step = hook.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = work.table(labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), f"label-{i}")
