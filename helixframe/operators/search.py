"""Similarity search inside and across families, and what is reported of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def _rank(scored: DataFrame, score: str, *per: str) -> Column:
    return F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(score), "protein_id"))


def within_family(queries: DataFrame, rows: DataFrame, k: int = 50, threshold: float | None = None, keep_self: bool = False) -> DataFrame:
    """Top ``k`` of each query among its family by cosine: query_id, protein_id, similarity, rank.

    Ranks are given before the threshold and the query itself are taken out, so they may have gaps.
    """
    asked = queries.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    out = blocks.top(asked, rows, k).select("query_id", "protein_id", F.col("score").alias("similarity"), "rank")
    if not keep_self:
        out = out.where(F.col("protein_id") != F.col("query_id"))
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("protein_id").alias("query_id"), F.col("v").alias("q"))


def all_families(queries: DataFrame, rows: DataFrame, k: int = 5, max_families: int | None = None) -> DataFrame:
    """Top ``k`` of every family for each query. With ``max_families`` only that many families are searched, in the order
    of their ids."""
    if max_families is not None:
        wanted = rows.select("family_id").distinct().orderBy("family_id").limit(max_families)
        rows = rows.join(wanted, "family_id", "left_semi").select(*rows.columns)
    out = blocks.top_of_all(_asked(queries), rows, k, per_family=True)
    return out.select("query_id", "family_id", "protein_id", F.col("score").alias("similarity"), "rank")


def global_threshold(queries: DataFrame, rows: DataFrame, k: int = 50, threshold: float = 0.1) -> DataFrame:
    """Top ``k`` over all rows by the dot product with the query scaled to unit length, at least ``threshold``."""
    out = blocks.top_of_all(_asked(queries), rows, k, per_family=False, least=threshold, projected=True)
    return out.select("query_id", "protein_id", F.col("score").alias("similarity"), "rank")


def hamming(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` of each query among its family by differing signs."""
    asked = queries.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
    return blocks.top(asked, rows, k, hamming=True).withColumn("hamming", F.col("score").cast("int")).select("query_id", "protein_id", "hamming", "rank")


def stats(matches: DataFrame) -> DataFrame:
    """Per query: number of matches, greatest and smallest similarity."""
    return matches.groupBy("query_id").agg(F.count("*").alias("n_matches"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"))


def histogram(values: DataFrame, col: str, bins: int = 5) -> DataFrame:
    """Left-closed bins of equal width over [0, 1]; smaller and larger values go to the outer bins, empty bins stay."""
    spark = values.sparkSession
    place = F.least(F.greatest(F.floor(F.col(col) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = values.where(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def similarity_table(matches: DataFrame, metadata: DataFrame, *columns: str) -> DataFrame:
    """Matches with metadata; what is missing reads N/A, a missing name ``Protein <id>``."""
    out = matches.join(metadata, "protein_id", "left")
    filled = [F.coalesce(F.col(c).cast("string"), F.concat(F.lit("Protein "), F.col("protein_id").cast("string")) if c == "name" else F.lit("N/A")).alias(c) for c in columns]
    return out.select(*matches.columns, *filled)


def top_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best rows overall."""
    return matches.orderBy(F.desc("similarity"), "query_id", "protein_id").limit(n)


def filtered(queries: DataFrame, rows: DataFrame, metadata: DataFrame, condition: Column, k: int = 10) -> DataFrame:
    """Search among the rows whose metadata meet a condition; the condition comes before the ranking."""
    allowed = rows.join(metadata.where(condition).select("protein_id"), "protein_id", "left_semi")
    return within_family(queries, allowed, k)


def status(queries: DataFrame, matches: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each query (query_id): its family, status ``success`` or ``no_family``, and its matches' number and
    greatest, smallest and mean similarity (0 without matches)."""
    family = assigned.select(F.col("protein_id").alias("query_id"), F.col("assigned").alias("family_id"))
    found = matches.groupBy("query_id").agg(F.count("*").alias("total_found"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"), F.avg("similarity").alias("avg_similarity"))
    out = queries.select("query_id").join(family, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c, v: F.when(F.col("family_id").isNotNull(), F.coalesce(c, F.lit(v))).otherwise(F.lit(v)).alias(c)
    state = F.when(F.col("family_id").isNull(), "no_family").otherwise("success")
    return out.select("query_id", "family_id", state.alias("status"), zero("total_found", 0), zero("max_similarity", 0.0), zero("min_similarity", 0.0), zero("avg_similarity", 0.0))


def status_totals(states: DataFrame) -> DataFrame:
    """One row: searches, successful and failed ones, and the mean similarity over all matches."""
    ok = F.count_if(F.col("status") == "success")
    mean = F.sum(F.col("avg_similarity") * F.col("total_found")) / F.nullif(F.sum("total_found"), F.lit(0))
    return states.agg(F.count("*").alias("total_searches"), ok.alias("successful_searches"), (F.count("*") - ok).alias("failed_searches"), F.coalesce(mean, F.lit(0.0)).alias("average_similarity"))


def family_coverage(states: DataFrame) -> DataFrame:
    """Successful searches of each family."""
    return states.where("status = 'success'").groupBy("family_id").agg(F.count("*").alias("n"))


def listed(matches: DataFrame) -> DataFrame:
    """Places from 1, without gaps, in each query's list of matches."""
    return matches.drop("rank").withColumn("rank", _rank(matches, "similarity", "query_id"))
