"""Summaries and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .families import ordinals


def _values(values: DataFrame, col: str) -> DataFrame:
    """The non-null values, computed once: they are counted, ordered and summed."""
    return Scratch(values.sparkSession, "values").table(values.select(col), "values").where(F.col(col).isNotNull())


#: Values that a selection leaves to be ordered at last, and the parts that one round divides a range into.
LAST, PARTS = 10_000, 1_000


def at_ranks(values: DataFrame, col: str, ranks: list[int]) -> list[float | None]:
    """Values at places of the ascending order (from 0), without ordering or moving the column.

    A round counts the values of a range in equal parts, by sums that combine before they shuffle, and goes on with the part
    that the rank lies in, until few values are left there or all are equal. A range of doubles is a thousand times narrower
    after each round, so a dozen rounds end any.
    """
    number = F.col(col).cast("double")
    whole = values.agg(F.min(number), F.max(number), F.count(col)).head()
    if whole[0] is not None and not math.isfinite(whole[1] - whole[0]):  # infinite values or NaN: by ranges and offsets
        got = {r["ordinal"]: r[col] for r in ordinals(values.where(F.col(col).isNotNull()), by=col).where(F.col("ordinal").isin(ranks)).collect()}
        return [got.get(r) for r in ranks]
    return [_at_rank(values, col, number, *whole, r) if whole[0] is not None and 0 <= r < whole[2] else None for r in ranks]


def _at_rank(values: DataFrame, col: str, number: Column, low: float, high: float, n: int, rank: int):
    """``rank`` is the place among the ``n`` values from ``low`` to ``high``, both included."""
    while n > LAST and low < high:
        here = values.where(number.between(low, high))
        part = F.least(F.floor((number - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")
        for r in here.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).orderBy("part").collect():  # PARTS rows at most
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    here = values.where(number.between(low, high)).select(col)
    first, last = here.agg(F.min(col), F.max(col)).head()
    if first == last:
        return first
    return here.orderBy(col).offset(rank).limit(1).head()[0]


def summary(values: DataFrame, col: str) -> DataFrame:
    """One row: n, mean, min, max and the upper median (place n // 2)."""
    values = _values(values, col)
    n = values.count()
    median = at_ranks(values, col, [n // 2])[0] if n else None
    kind = dict(values.dtypes)[col]
    return values.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max")).withColumn("median", F.lit(median).cast(kind))


def distribution(values: DataFrame, col: str) -> DataFrame:
    """One row: n, mean, interpolated median, min, max and population standard deviation."""
    values = _values(values, col)
    n = values.count()
    lo, hi = at_ranks(values, col, [(n - 1) // 2, n // 2]) if n else (None, None)
    median = None if lo is None else (lo + hi) / 2
    return values.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"), F.stddev_pop(col).alias("std")).withColumn("median", F.lit(median).cast("double"))


#: Bins of lengths, in order.
LENGTHS = ("0-100", "101-200", "201-500", "501-1000", ">1000")


def length_bin(length: Column) -> Column:
    """Right-closed bins up to 100, 200, 500 and 1000, and the rest."""
    out = F.when(length <= 100, LENGTHS[0])
    for most, name in zip((200, 500, 1000), LENGTHS[1:]):
        out = out.when(length <= most, name)
    return out.otherwise(LENGTHS[-1])


def length_histogram(values: DataFrame, col: str) -> DataFrame:
    return values.groupBy(length_bin(F.col(col)).alias("bin")).agg(F.count("*").alias("n"))


def validation(records: DataFrame, valid: Column) -> DataFrame:
    """One row: total, valid and invalid records, and the share of valid ones (null without records)."""
    ok = F.count_if(valid)
    return records.agg(F.count("*").alias("total"), ok.alias("valid"), (F.count("*") - ok).alias("invalid"), (ok / F.nullif(F.count("*"), F.lit(0))).alias("valid_rate"))


def coverage(links: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows whose map ``links`` has each key."""
    return links.agg(*(F.avg(F.map_contains_key("links", k).cast("double")).alias(k) for k in keys))


def dashboard(records: DataFrame, assignments: DataFrame, matches: DataFrame, graph_sizes: DataFrame) -> DataFrame:
    """Records with what every stage found of them; what is missing reads Unknown or 0."""
    found = matches.groupBy(F.col("query_id").alias("protein_id")).agg(F.count("*").alias("n_similar"), F.max("similarity").alias("best_similarity"))
    out = records.join(assignments.select("protein_id", "assigned", "confidence"), "protein_id", "left").join(found, "protein_id", "left")
    out = out.join(graph_sizes.select(F.col("graph").alias("assigned"), "n_nodes", "n_edges"), "assigned", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*records.columns, F.coalesce(F.col("assigned").cast("string"), F.lit("Unknown")).alias("family"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), zero("n_similar"), F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"), zero("n_nodes"), zero("n_edges"))


def dashboard_totals(table: DataFrame) -> DataFrame:
    known = F.when(F.col("family") != "Unknown", F.col("family"))
    return table.agg(F.count("*").alias("proteins"), F.countDistinct(known).alias("families"), F.avg("confidence").alias("avg_confidence"), F.sum("n_similar").alias("similar"))


def validation_errors(records: DataFrame, reason: Column, key: str = "protein_id") -> DataFrame:
    """The records with a reason against them: id and error."""
    return records.select(key, reason.alias("error")).where(F.col("error").isNotNull())
