"""Column expressions over vectors held as arrays. Sums run in array order, so equal inputs give equal bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    scale = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.coalesce(dot(a, b) / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    # the norm is a value of the outer lambda, as what stands in the inner one is computed for each component
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def bits(v: Column) -> Column:
    """1 where a component is over 0, else 0."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0).cast("tinyint"))


def packed(b: Column) -> Column:
    """Bits as 64-bit words, the first bit highest, padded with zeros."""
    size = F.size(b)
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.coalesce(F.get(b, w * 64 + i), F.lit(0)).cast("long"))
    )
    return F.transform(F.sequence(F.lit(0), F.ceil(size / 64).cast("int") - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two bit arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def distance_similarity(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(d))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
