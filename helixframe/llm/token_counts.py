"""Token counts through a digest cache.

Texts are keyed by the SHA-256 of their normalised content and tokenizers by the SHA-256 of their file. Stored counts are
joined to the input's distinct digests; only digests without a stored count are encoded, once each, and appended.

The normalisation never changes a count: for tokenizers that drop white space, runs of ASCII white space become one blank
and the ends are trimmed; for all others the text stands as it is.

Cases: a null text counts as an empty one (0 bytes, 0 tokens); rows with equal ids or texts each get their own result row,
and their text is encoded once; texts of any length are encoded whole;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, pick, prepare, tidy
from .tokens import stream

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def content_digest(text: Column, kind: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    if kind == "words":
        text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestCache:
    """Counts by (content digest, tokenizer digest): immutable Parquet appends, a folder for each tokenizer. A cache of the
    same path, in this or another session, goes on with what is stored there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, tokenizer: str | None = None) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        # a digest appended twice, by two writers at once, has equal counts
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        if tokenizer is not None:
            rows = rows.where(F.col("tokenizer") == tokenizer)
        return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").partitionBy("tokenizer").parquet(self.path)


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = stream(path)
        for b in batches:
            counts = [len(ids) for ids in tokens.ids_batch(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, cache: DigestCache | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row of ``docs``.

    Without ``cache`` a new one is begun in the shared folder. Text is moved once, to meet the list of missing digests.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokens = stream(tokenizer)
    work = Scratch(spark, "token-counts")
    cache = cache or DigestCache(spark, f"{work.path}/cache")
    docs = pick(docs, "doc_id", "text")
    keyed = docs.select("doc_id", "text", content_digest(F.col("text"), tokens.kind).alias("content"))
    digests = work.table(keyed.select("doc_id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    owners = digests.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id")))["doc_id"].alias("owner"), F.count("*").alias("rows"))
    looked = work.table(owners.join(cache.read(tokens.version).select("content", "n_tokens"), "content", "left"), "looked")
    missing = looked.where("n_tokens is null").select(F.col("content").alias("c"), "owner", "rows")
    same = (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    misses = keyed.join(missing, same, "left_semi")
    doubled = work.table(digests.join(missing.where("rows > 1"), same, "left_semi").groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "doubled")
    if not doubled.isEmpty():  # rows of one text that share a doc_id
        misses = misses.join(doubled, "content", "left_anti").unionByName(misses.join(doubled, "content", "left_semi").dropDuplicates(["content"]))
    counted = work.table(misses.select("content", "text").mapInArrow(tidy(_count(tokenizer, tokens.version)), CACHE_SCHEMA), "counted")
    cache.append(counted)
    known = looked.where("n_tokens is not null").select("content", "n_tokens").unionByName(counted.select("content", "n_tokens"))
    out = digests.join(known, "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
