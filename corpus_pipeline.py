"""The corpus pipeline: five stages over the documents, each reading what the one before has written.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. ``run`` applies
them in order, each stage's rows written as Parquet in the shared folder and read again as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, jaccard_join, language_id, packing, substring_dedup
from helixframe.llm.queries import END_ID, tokenizer_path
from helixframe.llm.runtime import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned; null texts, texts without letters and texts of which hardly an
    n-gram is where any learned language has it go."""
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id; rows without an id stay."""
    return jaccard_join.one_of_each(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty words or more that a document of smaller id has; emptied documents go."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training windows, mixed by source."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", no_repeated_passages),
    ("decontamination", no_benchmark_items),
    ("packing", packed),
]

#: The language profiles, the tokenizer and the edit search cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            work.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
