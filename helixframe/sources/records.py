"""Reading protein records: FASTA, CSV, JSON objects, single sequences; writing them again.

Records are (protein_id, source, sequence, metadata map).
"""

from __future__ import annotations

import logging
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import sequence as S
from ..session import Scratch, ship

_log = logging.getLogger(__name__)

SCHEMA = "protein_id string, source string, sequence string, metadata map<string,string>"
FORMATS = ("FASTA", "Uniprot", "ProteinSequenceSet", "Genome", "FeatureSet", "GenomeSet", "SingleProtein")

#: Other names of input types.
ALIASES = {"fasta": "FASTA", "fasta_file": "FASTA", "uniprot_identifiers": "Uniprot", "protein_sequence_set": "ProteinSequenceSet", "genome_reference": "Genome", "single_protein": "SingleProtein", "feature_set": "FeatureSet", "genome_set": "GenomeSet", "workspace_object": "Genome"}

_FEATURE = "struct<id:string,type:string,protein_translation:string,location:string,function:string>"
_GENOME = f"label string, features array<{_FEATURE}>"


def record(protein_id: Column, source: str, sequence: Column, **metadata: Column) -> list[Column]:
    extra = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return [protein_id.alias("protein_id"), F.lit(source).alias("source"), sequence.alias("sequence"), F.create_map(F.lit("length"), F.length(sequence).cast("string"), *extra).alias("metadata")]


def parse_fasta(chunks: Column) -> tuple[Column, Column]:
    """Id and sequence of one chunk: a header line without its mark and the lines after it."""
    head = F.regexp_extract(chunks, r"^[^\r\n]*", 0)
    body = F.substr(chunks, F.length(head) + 1)
    return F.regexp_extract(head, r"^\s*(\S+)", 1), F.regexp_replace(body, r"\s", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, split at every line that begins with ``>``; records without residues and text before the first
    header are left out. Files are splittable, so one file may be of any size."""
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = text.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("n"))
    # a file's first chunk still has its mark, unless it is text before any header
    first = rows.where("at = 0").groupBy("file").agg(F.min("n").alias("n"))
    marked = rows.where(F.col("value").startswith(">")).select(F.substr(F.col("value"), F.lit(2)).alias("value"))
    plain = rows.where(~F.col("value").startswith(">")).join(first, ["file", "n"], "left_anti").select("value")
    ident, seq = parse_fasta(F.col("value"))
    return marked.unionByName(plain).select(*record(ident, "FASTA", seq)).where("sequence <> ''")


def _download(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8")


def read_fasta_url(spark: SparkSession, url: str, timeout: float = 30.0, get: Callable[[str, float], str] = _download) -> DataFrame:
    """Records of a FASTA file behind a URL. The driver fetches it, so it is for files of a size that the driver holds."""
    path = Scratch(spark, "fasta-url").path
    spark.createDataFrame([(get(url, timeout).lstrip(">"),)], "value string").select(F.concat(F.lit(">"), "value").alias("value")).coalesce(1).write.text(path)
    return read_fasta(spark, path)


def fetch_uniprot(ids: DataFrame, base: str, timeout: float = 60.0, get: Callable[[str, float], str] = _download) -> DataFrame:
    """Records of (protein_id), each fetched as ``base``/<id>.fasta by the task that holds the id. The record's id is the second
    field of its header; ids that cannot be fetched are left out, with a warning in the task's log."""
    ship(ids.sparkSession)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for one in pdf["protein_id"]:
                try:
                    head, _, body = get(f"{base.rstrip('/')}/{one}.fasta", timeout).lstrip(">").partition("\n")
                    name = head.split()[0] if head.split() else one
                    name = name.split("|")[1] if name.count("|") else name
                    if seq := "".join(body.split()):
                        rows.append((name, "Uniprot", seq, {"length": str(len(seq))}))
                except Exception as e:  # the next ids are still fetched
                    _log.warning("could not fetch %s: %s", one, e)
            yield pd.DataFrame(rows, columns=["protein_id", "source", "sequence", "metadata"])

    return ids.select("protein_id").mapInPandas(run, SCHEMA)


def fetch_object(get: Callable[[str], str], ref: str, tries: int = 3, wait: float = 1.0) -> str:
    """A stored object's JSON text by its reference, tried several times with growing pauses."""
    for n in range(tries):
        try:
            return get(ref)
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("tries must be positive")


def embedded_fasta(spark: SparkSession, path: str, make=E.kmer_hash) -> DataFrame:
    """Vectors (protein_id, embedding) of the records of FASTA files."""
    return E.embed(valid_records(read_fasta(spark, path)), make)


def fasta_text(records: DataFrame) -> DataFrame:
    return records.select(F.concat(F.lit(">"), F.col("protein_id"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(records: DataFrame, path: str) -> None:
    fasta_text(records).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """CSV with a header, or JSON lines, of protein_id, sequence, description."""
    schema = "protein_id string, sequence string, description string"
    rows = spark.read.schema(schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(schema).json(path)
    return rows.select(*record(F.col("protein_id"), kind.upper(), F.col("sequence"), description=F.col("description")))


def from_uniprot_text(ids: Column) -> Column:
    """The ids of a comma-separated list."""
    return F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")


def uniprot_of_header(header: Column) -> Column:
    """The second field of a header with bars, else the whole."""
    return F.when(F.instr(header, "|") > 0, F.split_part(header, F.lit("|"), F.lit(2))).otherwise(header)


def sequence_set(objects: Column) -> Column:
    return F.from_json(objects, "proteins array<struct<id:string,sequence:string>>")["proteins"]


def from_sequence_sets(rows: DataFrame, col: str = "value") -> DataFrame:
    return rows.select(F.explode(sequence_set(F.col(col))).alias("p")).select(*record(F.col("p.id"), "ProteinSequenceSet", F.col("p.sequence"))).where("sequence <> ''")


def from_genomes(rows: DataFrame, col: str = "value", prefix: bool = False) -> DataFrame:
    """Coding features with a translation; ids get the genome's label in front with ``prefix``. Broken objects are skipped."""
    g = rows.select(F.from_json(F.col(col), _GENOME).alias("g")).select("g.label", F.explode("g.features").alias("f"))
    ident = F.concat_ws("_", "label", "f.id") if prefix else F.col("f.id")
    out = g.where("f.type = 'CDS' AND f.protein_translation <> ''")
    return out.select(*record(ident, "GenomeSet" if prefix else "Genome", F.col("f.protein_translation"), feature_type=F.col("f.type"), location=F.col("f.location"), function=F.col("f.function")))


def from_feature_sets(rows: DataFrame, col: str = "value") -> DataFrame:
    e = rows.select(F.explode(F.from_json(F.col(col), f"elements array<{_FEATURE}>")["elements"]).alias("f")).where("f.protein_translation <> ''")
    return e.select(*record(F.col("f.id"), "FeatureSet", F.col("f.protein_translation"), feature_type=F.col("f.type")))


def single(spark: SparkSession, sequence: str) -> DataFrame:
    return spark.range(1).select(*record(F.lit("single_protein"), "SingleProtein", F.lit(sequence)))


def parse_input(spark: SparkSession, kind: str, data) -> DataFrame:
    """Records of any of ``FORMATS``: a path for FASTA, a DataFrame of JSON texts (or a path to them) for objects, an id list or
    a DataFrame of known records for Uniprot, a sequence for SingleProtein."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported input type {kind!r}; known: {', '.join(FORMATS)}")
    if kind == "FASTA":
        return read_fasta(spark, data)
    if kind == "SingleProtein":
        return single(spark, data)
    if kind == "Uniprot":
        ids, known = data
        wanted = spark.range(1).select(F.explode(from_uniprot_text(F.lit(ids))).alias("protein_id"))
        return known.join(F.broadcast(wanted), "protein_id", "left_semi")
    rows = data if isinstance(data, DataFrame) else spark.read.text(data, wholetext=True)
    readers = {"ProteinSequenceSet": from_sequence_sets, "Genome": from_genomes, "FeatureSet": from_feature_sets}
    return readers[kind](rows) if kind in readers else from_genomes(rows, prefix=True)


def valid_records(records: DataFrame) -> DataFrame:
    return records.where(S.is_valid(F.col("sequence")))


def input_kind(workspace_type: Column) -> Column:
    """Input format of a stored object's type name; the longer name is tried first."""
    out = F.when(F.instr(workspace_type, "GenomeSet") > 0, "GenomeSet")
    for name in ("Genome", "FeatureSet", "ProteinSequenceSet"):
        out = out.when(F.instr(workspace_type, name) > 0, name)
    return out.otherwise("FASTA")
