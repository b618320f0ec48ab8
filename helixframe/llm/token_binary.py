"""Token ids in a binary file format: canonical length-limited Huffman coding.

Ids are counted over the whole table; one code of at most 17 bits an id serves all files. A file is a sequence of blocks,
each of which can be decoded by itself:

    block       := "HFB1" | u32 n_docs | u32 n_ids | u32 n_checkpoints | doc_id[i64 n_docs] | n_tokens[u32 n_docs]
                   | bit offset of every checkpoint [u64] | bit string, each document from a whole byte on
    checkpoint  := the bit at which id 0, CHECKPOINT, 2 * CHECKPOINT, ... of a document begins

Decoding reads a table of 2**17 entries and runs all stretches between checkpoints side by side. Blocks are stored as rows of
Parquet files, in ascending order of doc_id: (file, block, ids before the block in its file, payload); the code's lengths
and the number of ids of each file are stored beside them. Documents are first coded one by one where they are, so that
what moves into doc_id order is their codes.

Cases: a null text is an empty one, it has the end id only; rows of equal doc_id are written one after the other, of equal
ids in the order of their codes; null doc_ids come first; a long text makes a block of its own; an empty table gives empty files and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import canonical_codes, code_lengths, decode, decoding_table, encode_many
from .runtime import Scratch, pick, prepare, tidy
from .tokens import stream

MAGIC = b"HFB1"
CHECKPOINT = 256
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
_NO_ID = -(1 << 63)
_BLOCK, _CODE = "file int, block int, before long, n_ids long, payload binary", "id int, length int"


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = stream(path)
        tail = np.array([end_id], dtype=tokens.dtype).tobytes()
        for b in batches:
            out = [ids.tobytes() + tail for ids in tokens.ids_batch(b.column(b.schema.names.index("text")).to_pylist())]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in names), pa.array(out, pa.binary())], names=[*names, "ids"])

    return run


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, work: Scratch, name: str, *keep: str) -> tuple[DataFrame, str]:
    """A table of each row's ids with the end id, and the NumPy type in which they are stored."""
    prepare(docs.sparkSession)
    kind = stream(tokenizer).dtype
    rows = pick(docs, "doc_id", "text", *keep).withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), "ids binary"])
    return work.table(rows.mapInArrow(tidy(_tokenise(tokenizer, end_id)), schema), name), kind


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column, one after the other, without a copy."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and len(column) else np.zeros(0, dtype=kind)


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            ids = _flat(b.column("ids"), kind)
            for i in range(0, len(ids), 1 << 20):
                n = np.bincount(ids[i : i + (1 << 20)])
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    return run


def _compress(kind: str, lengths):
    """Code documents one by one: bits | bit string | bit offset of every CHECKPOINT-th id but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths.value)
        for b in batches:
            n = np.array(pc.binary_length(b.column("ids")).to_pylist(), dtype=np.int64) // int(kind[-1])
            parts = np.split(_flat(b.column("ids"), kind), np.cumsum(n)[:-1]) if len(n) else []
            coded, at = [], 0
            while at < len(parts):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 1 << 19, "right")) + at)
                coded += encode_many(parts[at:stop], codes, lengths.value, CHECKPOINT)
                at = stop
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.binary())], names=["doc_id", "n", "coded"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put coded documents, in their order, together into blocks; a longer document makes a block of its own."""
    docs: list[int] = []
    sizes: list[int] = []
    marks: list[np.ndarray] = []
    bodies: list[bytes] = []
    file, block, before, size, at = 0, 0, 0, 0, 0

    def close():
        places = np.concatenate(marks)
        payload = b"".join([MAGIC, struct.pack("<III", len(docs), size, len(places)), np.array(docs, dtype="<i8").tobytes(), np.array(sizes, dtype="<u4").tobytes(), places.astype("<u8").tobytes(), *bodies])
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "before", "n_ids", "payload"])

    for b in batches:
        for doc, part, n, coded in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file", "n", "coded"))):
            file = part
            body = (struct.unpack_from("<Q", coded)[0] + 7) // 8
            docs.append(_NO_ID if doc is None else doc)
            sizes.append(n)
            marks.append(8 * at + np.concatenate([[0], np.frombuffer(coded, dtype="<u8", offset=8 + body).astype(np.int64)]))
            bodies.append(coded[8 : 8 + body])
            size, at = size + n, at + body
            if size >= BLOCK_IDS:
                yield close()
                block, before, size, at = block + 1, before + size, 0, 0
                for held in (docs, sizes, marks, bodies):
                    held.clear()
    if docs:
        yield close()


def read_block(payload: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n_ids, n_marks = struct.unpack_from("<III", payload, 4)
    docs = np.frombuffer(payload, dtype="<i8", count=n_docs, offset=16)
    n = np.frombuffer(payload, dtype="<u4", count=n_docs, offset=16 + 8 * n_docs).astype(np.int64)
    marks = np.frombuffer(payload, dtype="<u8", count=n_marks, offset=16 + 12 * n_docs).astype(np.int64)
    many = -(-n // CHECKPOINT)
    each = np.full(n_marks, CHECKPOINT, dtype=np.int64)
    each[np.cumsum(many) - 1] = n - CHECKPOINT * (many - 1)
    return docs, n, decode(np.frombuffer(payload, dtype=np.uint8, offset=16 + 12 * n_docs + 8 * n_marks), marks, each, table)


class TokenFiles:
    """Files written at ``path``: the blocks, and the code that reads them. Any session can open them again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema(_BLOCK).parquet(f"{path}/files")
        code = spark.read.schema(_CODE).parquet(f"{path}/code").collect()  # at most one row an id
        self.lengths = np.zeros(max([0, *(r["id"] for r in code)]) + 1, dtype=np.uint8)
        for r in code:
            self.lengths[r["id"]] = r["length"]

    def read(self) -> DataFrame:
        """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""
        spark = self.spark
        prepare(spark)
        sizes = sorted((r["file"], r["n"]) for r in self.rows.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
        before, total = {}, 0
        for file, n in sizes:
            before[file], total = total, total + n
        shared = spark.sparkContext.broadcast((self.lengths, before))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths, base = shared.value
            table = decoding_table(lengths)
            for b in batches:
                for file, at, payload in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), b.column("payload")):
                    docs, n, ids = read_block(payload.as_py(), table)
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
                    crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NO_ID), pa.array(base[file] + at + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.rows.select("file", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> TokenFiles:
    """Encode every text of (doc_id, text), append ``end_id``, and write all ids in ascending order of doc_id.

    Files at ``path`` are kept, and ``TokenFiles(spark, path)`` opens them; without it they live in the shared folder until
    the session ends.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "token-files")
    ids, kind = token_ids(docs, tokenizer, end_id, work, "ids")
    counted = ids.select("ids").mapInArrow(_counts(kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row an id
    counts = np.zeros(max([end_id, *(r["id"] for r in counted)]) + 1, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)
    # written, so that finding the ranges of doc_id does not code everything twice
    coded = work.table(ids.mapInArrow(tidy(_compress(kind, shared)), "doc_id long, n long, coded binary"), "coded")
    work.drop("ids")
    placed = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "coded").withColumn("file", F.spark_partition_id())
    path = path or work.path
    placed.mapInArrow(_blocks, _BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{path}/files")
    code = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths) if n], _CODE)
    code.coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    work.drop("coded")
    return TokenFiles(spark, path)
