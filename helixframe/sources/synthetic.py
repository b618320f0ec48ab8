"""Synthetic families for trials: members scattered around a centre of their family, sequences and metadata of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALPHABET


def protein_id(n) -> F.Column:
    return F.concat(F.lit("P"), F.lpad(n.cast("string"), 5, "0"))


def families(spark: SparkSession, n_families: int = 20, members: int = 2000, dim: int = 320, spread: float = 0.5, seed: int = 42) -> DataFrame:
    """(protein_id, family_id, embedding): normal centres of deviation 5, members of deviation ``spread`` around them.

    Values come from hashes of their place, so any partition makes the same rows.
    """

    def normal(*keys) -> F.Column:
        unit = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))

    rows = spark.range(n_families * members).withColumn("f", (F.col("id") / members).cast("long"))
    value = lambda i: (5 * normal(F.col("f"), i, F.lit("centre")) + spread * normal(F.col("id"), i, F.lit("member"))).cast("float")
    return rows.select(protein_id(F.col("id")).alias("protein_id"), F.concat(F.lit("family_"), F.col("f")).alias("family_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"))


def sequences(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(protein_id, sequence) of 50 to 500 residues."""
    length = 50 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(451))
    letter = lambda i: F.substr(F.lit(ALPHABET), (1 + F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(ALPHABET)))).cast("int"), F.lit(1))
    return spark.range(n).select(protein_id(F.col("id")).alias("protein_id"), F.concat_ws("", F.transform(F.sequence(F.lit(1).cast("long"), length), letter)).alias("sequence"))
