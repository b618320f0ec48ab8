"""Helpers that the text operators share: package shipping, shared scratch space, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ship

#: Largest side, in bytes, that an operator has broadcast by itself. None is: every join has one plan at every size of the input,
#: and what Spark broadcasts by its own limit is Spark's choice. Callers who know their sizes may give operators another limit.
BROADCAST_LIMIT = 0

#: Rows and bytes of an Arrow batch of texts; both bound what a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the session's Arrow batches for texts (smaller bounds stay)."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        size = int(now[:-1] if now[-1:] in "bB" else now) if now.lstrip("-").rstrip("bB").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT, items: str | None = None, item_bytes: int = 0) -> bool:
    """Whether a table that is already computed may be broadcast: ``row_bytes`` a row, and ``item_bytes`` for each entry of
    its array column ``items``, come to at most ``limit``."""
    if limit <= 0:
        return False
    many = F.sum(F.size(items)) if items else F.lit(0)
    n, m = df.agg(F.count("*"), F.coalesce(many, F.lit(0))).head()
    return n * row_bytes + m * item_bytes <= limit


def checked_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_LIMIT, items: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Join with ``small`` (a computed table) broadcast if its size allows it, else by a shuffle that AQE may split."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes, limit, items, item_bytes) else small, on, how)


def narrowed(big: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``big`` without rows whose key is not in ``ids`` (a computed table of distinct 8-byte keys), if that list may be
    broadcast; else ``big`` as it is. An exact join by the same key follows in either case."""
    return big.join(F.broadcast(ids), key, "left_semi") if small_enough(ids, 24, limit) else big


def tidy(run):
    """An Arrow function that gives freed memory back when its task ends, as workers live on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        with contextlib.suppress(Exception):
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns of any name cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def crc32_of_id(col: Column) -> Column:
    """Unsigned CRC-32 of the decimal digits of an integer column."""
    return F.crc32(col.cast("string").cast("binary"))
