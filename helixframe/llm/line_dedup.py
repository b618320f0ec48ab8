"""Line deduplication by sharded minimal perfect hashes.

A line's key is the line without the characters 0x20 and 0x09 to 0x0D at its ends, A to Z in lower case. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold are repeated: all their lines go but those of the
document of the largest doc_id.

1. Documents are read once; each leaves the 128-bit hashes of its long lines. The Arrow batch it was read in is its block.
2. Hashes are counted by document in two sums that combine before they shuffle, so that a line of many documents is as
   cheap as any other.
3. The distinct hashes of a shard (about ``SHARD_KEYS``) get a minimal perfect hash: levels of bit sets in which a key that
   is alone in its place settles, and keys that collide go on to the next level; a key's slot is the rank of its bit. By
   slot a shard has a 32-bit fingerprint and a count of one byte, and the last doc_id of repeated keys only. A distinct line
   costs some 9 bytes, whatever its length. ``LineIndex`` keeps the shards as rows of a table, which other sessions open.
4. Blocks probe the arrays: a block sends each shard its distinct hashes, packed, and gets the repeated ones back; a shard's
   task holds one shard and streams the blocks' requests. A line that a third of all documents have is one request a block,
   and no line is joined with another.
5. Documents that lose lines meet their texts again by doc_id and a hash of the text.

All hashes that the index's own documents probe are in the perfect hash, so fingerprints never decide for them; for other
documents a line that the index does not have passes as another with a chance of 2**-32. Lines are equal if their 128-bit
hashes are.

Cases: a null text is an empty one, and an empty one is one empty line; rows without doc_id stay whole and count nowhere;
rows of equal doc_id are one document for the counts, and each loses its own lines; of a line that a document has several times all stay or
all go; long texts and lines are taken whole; an empty table gives an empty result; columns of other names are ignored, or
kept by ``drop_repeated_lines``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, pick, prepare, tidy
from .text import mix

#: Distinct lines of a shard, about, and the fewest shards; bits of a level for each key that is left.
SHARD_KEYS, FEWEST_SHARDS, GAMMA = 1 << 16, 256, 1.5
_LINES = "block long, doc_id long, key long, at binary, hashes array<struct<a:long,b:long>>"
_SHARD = "shard long, sizes array<int>, bits binary, fingerprints binary, counts binary, hot binary, last binary"
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_HIT = np.dtype([("a", "<i8"), ("b", "<i8"), ("last", "<i8")])


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: the six ASCII blanks, and A to Z only


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: bit sets of all levels behind each other, slots by rank."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix(a ^ mix(b + seed)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """Keys are pairs of unsigned 64-bit numbers, all different."""
        sizes, levels = [], []
        while len(a):
            if len(sizes) == 200:
                raise ValueError("the keys are not distinct")
            size = -(-int(GAMMA * len(a) + 8) // 8) * 8
            place = cls._place(a, b, len(sizes), size)
            many = np.bincount(place, minlength=size)
            sizes.append(size)
            levels.append(many == 1)
            left = many[place] > 1
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; keys of another set get any slot, or -1."""
        out, left, base = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            place = self._place(a[left], b[left], level, size) + base
            here = self.bits[place]
            out[left[here]] = self.ranks[place[here]]
            left = left[~here]
            base += size
        return out


class Shard:
    """A shard's perfect hash and its arrays by slot."""

    def __init__(self, row: dict):
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)
        self.hash = PerfectHash(list(row["sizes"]), bits)
        self.fingerprints, self.counts, self.hot, self.last = (np.frombuffer(row[n], dtype=t) for n, t in (("fingerprints", "<u4"), ("counts", "u1"), ("hot", "<u4"), ("last", "<i8")))

    @staticmethod
    def build(shard: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, last: np.ndarray, min_docs: int) -> tuple:
        a, b = a.view(np.uint64), b.view(np.uint64)
        perfect = PerfectHash.build(a, b)
        order = np.argsort(perfect.slots(a, b))
        counts = np.minimum(n[order], 255).astype("u1")
        hot = np.flatnonzero(counts >= min_docs).astype("<u4")
        prints = (b[order] >> np.uint64(32)).astype("<u4")
        return shard, perfect.sizes, np.packbits(perfect.bits).tobytes(), prints.tobytes(), counts.tobytes(), hot.tobytes(), last[order][hot].astype("<i8").tobytes()

    def repeated(self, pairs: np.ndarray, min_docs: int) -> np.ndarray:
        """Those of the pairs that are repeated, with the last doc_id that holds each."""
        a, b = pairs["a"].view(np.uint64), pairs["b"].view(np.uint64)
        slot = self.hash.slots(a, b)
        yes = np.flatnonzero(slot >= 0)
        yes = yes[(self.counts[slot[yes]] >= min_docs) & (self.fingerprints[slot[yes]] == (b[yes] >> np.uint64(32)).astype("<u4"))]
        out = np.zeros(len(yes), dtype=_HIT)
        out["a"], out["b"], out["last"] = pairs["a"][yes], pairs["b"][yes], self.last[np.searchsorted(self.hot, slot[yes])]
        return out


def _mark(min_chars: int):
    """The hashes of each document's long lines, and which lines they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            at, ends, raw = [], [0], bytearray()
            for text in b.column("text"):
                own = []
                for i, line in enumerate(split_lines(text.as_py())):
                    key = line_key(line)
                    if _long(key, min_chars):
                        own.append(i)
                        raw += xxhash.xxh3_128_digest(key)
                at.append(np.array(own, dtype="<i4").tobytes())
                ends.append(len(raw) >> 4)
            pairs = np.frombuffer(bytes(raw), dtype=_PAIR)
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs["a"]), pa.array(pairs["b"])], names=["a", "b"]))
            block = pa.array(np.full(b.num_rows, (TaskContext.get().partitionId() << 32) + k))
            yield pa.RecordBatch.from_arrays([block, b.column("doc_id"), b.column("key"), pa.array(at, pa.binary()), hashes], names=["block", "doc_id", "key", "at", "hashes"])

    return run


def _pairs(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten()
    out = np.zeros(len(flat), dtype=_PAIR)
    out["a"], out["b"] = flat.field("a").to_numpy(), flat.field("b").to_numpy()
    return out


def _build(min_docs: int):
    """Rows (shard, a, b, n, last) in the order of shards become one row a shard."""
    names = [f.split()[0] for f in _SHARD.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            row = Shard.build(now, *(np.concatenate(c) for c in zip(*held)), min_docs)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            shard, *cols = (b.column(c).to_numpy() for c in ("shard", "a", "b", "n", "last"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and shard[i] != now:
                    yield done()
                    held = []
                now = int(shard[i])
                held.append([c[i:j] for c in cols])
        if held:
            yield done()

    return run


def _ask(shards: int):
    """Requests: of each block its distinct hashes, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = _pairs(b.column("hashes"))
            block = np.repeat(b.column("block").to_numpy(), pc.list_value_length(b.column("hashes")).to_numpy())
            shard = np.mod(pairs["a"], shards)
            order = np.lexsort((pairs["b"], pairs["a"], shard, block))
            pairs, block, shard = pairs[order], block[order], shard[order]
            new = np.ones(len(pairs), dtype=bool)
            new[1:] = (pairs[1:] != pairs[:-1]) | (block[1:] != block[:-1])
            pairs, block, shard = pairs[new], block[new], shard[new]
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (shard[1:] != shard[:-1])])) if len(pairs) else np.zeros(0, dtype=np.int64)
            ends = [*first.tolist(), len(pairs)]
            sent = [pairs[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(block[first]), pa.array(sent, pa.binary())], names=["shard", "block", "pairs"])

    return run


def _answer(min_docs: int):
    """Requests in the order of shards, each shard's arrays first: what of each block is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        fields = ("sizes", "bits", "fingerprints", "counts", "hot", "last")
        for b in batches:
            which, own, blocks, sent = (b.column(c).to_pylist() for c in ("shard", "own", "block", "pairs"))
            out = []
            for i, (w, o, block, pairs) in enumerate(zip(which, own, blocks, sent)):
                if o:
                    now, shard = w, Shard({f: b.column(f)[i].as_py() for f in fields})
                elif w == now:
                    hits = shard.repeated(np.frombuffer(pairs, dtype=_PAIR), min_docs)
                    if len(hits):
                        out.append((block, hits.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["block", "hits"])

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of blocks, each block's answers first: the lines that each document loses."""
    now, last = None, {}
    for b in batches:
        out = []
        for block, hits, doc, key, at, hashes in zip(b.column("block").to_pylist(), b.column("hits"), b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("at"), b.column("hashes")):
            if block != now:
                now, last = block, {}
            if hits.is_valid:
                raw = hits.as_py()
                last.update((raw[i : i + 16], raw[i + 16 : i + 24]) for i in range(0, len(raw), 24))
            elif last:
                flat = hashes.values
                raw = np.empty(len(flat), dtype=_PAIR)
                raw["a"], raw["b"] = flat.field("a").to_numpy(), flat.field("b").to_numpy()
                raw, own = raw.tobytes(), np.int64(doc).tobytes()
                gone = [i for i in range(len(raw) >> 4) if last.get(raw[16 * i : 16 * i + 16], own) != own]
                if gone:
                    out.append((doc, key, np.frombuffer(at.as_py(), dtype="<i4")[gone].tobytes()))
        cols = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "key", "dropped"])


class LineIndex:
    """How often lines occur, as shards of a perfect hash in a table at ``path``, or in the shared folder until the session ends.

    ``add`` makes the index of a table's lines, and ``dropped`` says which lines documents lose by it. The index of a path
    that has one is opened again.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, path: str | None = None):
        if not 1 <= min_docs <= 255:
            raise ValueError("min_docs is 1 to 255, as counts have a byte")
        prepare(spark)
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.work = Scratch(spark, "lines")
        self.path = path or f"{self.work.path}/index"
        self.shards = 0
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.shards = self.rows().agg(F.max("shard")).head()[0] + 1

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_SHARD).parquet(self.path)

    def lines(self, docs: DataFrame, name: str = "lines") -> DataFrame:
        """The hashes of the long lines of documents that have a doc_id, written once."""
        rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
        return self.work.table(rows.mapInArrow(tidy(_mark(self.min_chars)), _LINES).where(F.size("hashes") > 0), name)

    def add(self, lines: DataFrame) -> None:
        total = lines.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).head()[0]
        self.shards = max(FEWEST_SHARDS, -(-total // SHARD_KEYS))
        each = lines.select("doc_id", F.explode("hashes").alias("x")).select("x.a", "x.b", "doc_id").distinct()
        counted = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        counted = counted.withColumn("shard", F.pmod("a", F.lit(self.shards)))
        own = counted.repartition("shard").sortWithinPartitions("shard").select("shard", "a", "b", "n", "last").mapInArrow(tidy(_build(self.min_docs)), _SHARD)
        # the last shard is there even if it has no line, as it tells how many there are
        end = self.spark.range(1).select(F.lit(self.shards - 1).cast("long").alias("shard"), *(F.lit(b"").alias(c) if c != "sizes" else F.array().cast("array<int>").alias(c) for c in self.spark.createDataFrame([], _SHARD).columns[1:]))
        own.unionByName(end).write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(doc_id, key, dropped): for each document that loses lines their numbers, and a hash of its text."""
        asked = lines.select("block", "hashes").mapInArrow(tidy(_ask(self.shards)), "shard long, block long, pairs binary")
        arrays = self.rows().where(F.size("sizes") > 0).select(F.lit(True).alias("own"), "*")
        both = arrays.unionByName(asked.withColumn("own", F.lit(False)), allowMissingColumns=True)
        both = both.repartition("shard").sortWithinPartitions("shard", F.desc("own"))
        hits = both.mapInArrow(tidy(_answer(self.min_docs)), "block long, hits binary")
        rows = hits.unionByName(lines, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("hits").isNull())
        out = rows.select("block", "hits", "doc_id", "key", "at", "hashes").mapInArrow(tidy(_decide), "doc_id long, key long, dropped binary")
        return out.groupBy("doc_id", "key").agg(F.first("dropped").alias("dropped"))  # equal rows lose the same lines


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in have:
            name += "_"
        out.append(name)
    return out


def _kept(text: str | None, dropped: bytes | None) -> tuple[int, int, bytes]:
    """How many lines a text has, how many go, and the others joined."""
    lines = split_lines(text)
    gone = set(np.frombuffer(dropped or b"", dtype="<i4").tolist())
    return len(lines), len(gone), b"\n".join([x for i, x in enumerate(lines) if i not in gone])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_kept(t.as_py(), d.as_py()) for t, d in zip(b.column("text"), b.column("dropped"))]
        cols = [[r[0] for r in rows], [r[1] for r in rows], [hashlib.sha256(r[2]).hexdigest() for r in rows]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _texts(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != column]
            dropped = b.column(b.schema.names.index(column))
            texts = [_kept(t.as_py(), d.as_py())[2].decode("utf-8", "surrogatepass") if d.is_valid else t.as_py() for t, d in zip(b.column(b.schema.names.index("text")), dropped)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(b.schema.names.index(n)) for n in names], names=names)

    return run


def _with_dropped(docs: DataFrame, min_chars: int, min_docs: int, path: str | None, column: str, key: str) -> DataFrame:
    """``docs`` with the lines that each row loses."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs, path)
    lines = index.lines(docs)
    if not index.shards:
        index.add(lines)
    gone = index.work.table(index.dropped(lines), "dropped")
    index.work.drop("lines")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("dropped").alias(column))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(gone.hint("merge"), (keyed["doc_id"].cast("long") == gone["_id"]) & (keyed[key] == gone["_key"]), "left").select(*(keyed[f"`{c}`"] for c in docs.columns), gone[column])


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, path: str | None = None) -> DataFrame:
    """Per document doc_id, n_lines, n_dropped and kept_sha256 (of the kept lines joined by line feeds)."""
    docs = pick(docs, "doc_id", "text")
    joined = _with_dropped(docs, min_chars, min_docs, path, "dropped", "key")
    return joined.mapInArrow(tidy(_digests), f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, path: str | None = None) -> DataFrame:
    """``docs``, with all columns, without the repeated lines; texts that lose none stay as they are. With ``path`` the lines
    are judged by the index there, or by their own, which is then written there."""
    column, key = _free_names(docs, "_dropped", "_text_key")
    joined = _with_dropped(docs, min_chars, min_docs, path, column, key)
    return joined.mapInArrow(tidy(_texts(column)), docs.schema)
