"""Substring deduplication by a log-structured fingerprint index.

A window is ``window`` consecutive words. Windows are fingerprinted by their minimizer: of the hashes of their ``gram``-word
runs the smallest, the leftmost of equals. Equal windows have equal minimizers, and neighbouring windows mostly share one, so
a text leaves one fingerprint for each run of windows with the same minimizer, about one in twenty words.

The index is a list of immutable runs, each a table sorted by fingerprint that names, for every distinct stretch of text
(the run of windows of one minimizer), the first document that has it. A batch of documents is merge-joined with all runs:

1. fingerprints that only one document has, here and in the runs, need nothing more;
2. stretches that are equal as a whole (the same digest) are settled together: all but the first document's go;
3. where a fingerprint has several different stretches, the words are fetched again, from the batch and from the indexed
   documents, and every window of the first occurrence of each stretch is compared by its 128-bit digest (verification).

What the batch adds becomes a new run, and once ``fanout`` runs exist they are compacted into one. An index with a path
outlives its session: a manifest there names the live runs, and another ``FingerprintIndex`` of that path goes on with them.

A batch's documents are compared by doc_id: of equal windows the one in the smallest doc_id stays, so batches must come in
ascending ranges of doc_id. Windows are judged on the input, not on what is left.

Cases: a null text has no words; long texts are cut into words and windows whole, in blocks of bounded memory; a row with null doc_id is returned whole and takes no part; windows of rows with equal
doc_id do not remove each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import BROADCAST_LIMIT, Scratch, narrowed, pick, prepare, small_enough, tidy
from .text import Words

#: Batches in which a whole table is taken in, and the number of runs that are compacted into one.
BATCHES, FANOUT = 3, 2
_STRETCH = "a long, c long, doc_id long, h int, s int, e int"


def _key(text: str | None) -> int:
    """A short check value that tells rows of one doc_id apart."""
    return xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 31)


def stretches(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one minimizer: its hash, the first and the last window's first word."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = words.grams(gram)
    width = window - gram + 1
    at = np.empty(n, dtype=np.int64)
    for i in range(0, n, 1 << 16):  # blocks, so that long texts take bounded memory
        part = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + width - 1], width)
        at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return grams[at[first]].view(np.int64), first, np.append(first[1:] - 1, n - 1)


def _fingerprint(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[np.zeros(0, dtype=t)] for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                words = Words(text)
                a, s, e = stretches(words, window, gram)
                if not len(a):
                    continue
                c = np.fromiter((xxhash.xxh3_64_intdigest(words.run(i, j)) for i, j in zip(s.tolist(), (e + window - 1).tolist())), dtype=np.uint64, count=len(a))
                for col, v in zip(out, (a, c.view(np.int64), np.full(len(a), doc), np.full(len(a), _key(text), dtype=np.int32), s.astype(np.int32), e.astype(np.int32))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "c", "doc_id", "h", "s", "e"])

    return run


def _expand(window: int):
    """Every window of the named stretches, with a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, h, text, spans in zip(*(b.column(n).to_pylist() for n in ("doc_id", "h", "text", "spans"))):
                if _key(text) != h:
                    continue
                words = Words(text)
                for s, e, new in sorted({(x["s"], x["e"], x["fresh"]) for x in spans}):
                    for i in range(s, e + 1):
                        d = xxhash.xxh3_128_digest(words.run(i, i + window - 1))
                        for col, v in zip(cols, (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, h, i, new)):
                            col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["w1", "w2", "doc_id", "h", "s", "fresh"])

    return run


class FingerprintIndex:
    """The index: immutable sorted runs at ``path``, or in the shared folder until the session ends."""

    def __init__(self, spark: SparkSession, window: int = 50, gram: int = 8, fanout: int = 4, broadcast_limit: int = BROADCAST_LIMIT, path: str | None = None):
        prepare(spark)
        self.spark, self.window, self.gram, self.fanout, self.limit = spark, window, gram, fanout, broadcast_limit
        self.work = Scratch(spark, "fingerprints")
        self.path = path or f"{self.work.path}/index"
        self.compactions, self._made, self._open = 0, 0, []
        self.version, self.runs = self._manifest()

    def _files(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _manifest(self) -> tuple[int, list[str]]:
        """The number of the last manifest that was written to its end, and the runs that it names."""
        fs, at = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in sorted(names) if n.startswith("manifest-") and fs.exists(self._files(f"{n}/_SUCCESS")[1])]
        if not done:
            return 0, []
        rows = self.spark.read.schema("run string, window int, gram int").parquet(f"{self.path}/{done[-1]}").collect()
        if any((r["window"], r["gram"]) != (self.window, self.gram) for r in rows):
            raise ValueError("the index was made with other windows")
        return int(done[-1].split("-")[1]), sorted(r["run"] for r in rows)

    def _commit(self, runs: list[str]) -> None:
        """Name the live runs in a new manifest; what only older ones name goes."""
        last, gone = self.version, set(self.runs) - set(runs)
        self.version, self.runs = last + 1, runs
        rows = self.spark.createDataFrame([(r, self.window, self.gram) for r in runs], "run string, window int, gram int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self.version:06d}")
        for name in (*gone, f"manifest-{last:06d}"):
            fs, at = self._files(name)
            fs.delete(at, True)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{self.version:06d}-{uuid.uuid4().hex[:8]}"
        rows.repartitionByRange("a").sortWithinPartitions("a", "c").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _name(self, kind: str) -> str:
        self._made += 1
        name = f"{kind}-{self._made:04d}"
        if kind != "found":
            self._open.append(name)
        return name

    def history(self) -> DataFrame:
        """All stretches of all runs."""
        out = self.spark.createDataFrame([], _STRETCH)
        for name in self.runs:
            out = out.unionByName(self.spark.read.schema(_STRETCH).parquet(f"{self.path}/{name}"))
        return out

    def _append(self, rows: DataFrame) -> None:
        self._commit([*self.runs, self._write(rows)])
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """All runs merged into one; of equal stretches the one of the smallest doc_id stays."""
        if len(self.runs) < 2:
            return
        best = self.history().groupBy("a", "c").agg(F.min(F.struct("doc_id", "h", "s", "e")).alias("m")).select("a", "c", "m.*")
        self.compactions += 1
        self._commit([self._write(best)])

    def drop(self) -> None:
        """Delete the index."""
        fs, at = self._files()
        fs.delete(at, True)
        self.version, self.runs = 0, []

    def batch(self, docs: DataFrame, indexed: DataFrame | None, keep: bool = True) -> DataFrame:
        """Ranges of windows (doc_id, h, s, e) of ``docs`` that a smaller doc_id has, in the batch or in the index.

        ``indexed`` gives the text of the documents that the runs name. With ``keep`` the batch joins the index.
        """
        work, w = self.work, self.window
        docs = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
        rows = work.table(docs.mapInArrow(tidy(_fingerprint(w, self.gram)), _STRETCH), self._name("fingerprints"))
        past = self.history()

        # fingerprints that more than one document has, here or before
        here = rows.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        if self.runs:
            before = past.groupBy("a").agg(F.lit(True).alias("old"))
            here = here.hint("merge").join(before, "a", "left").where(F.col("old") | (F.col("lo") < F.col("hi")))
        else:
            here = here.where("lo < hi")
        shared = work.table(here.select("a"), self._name("shared"))
        merged = shared.hint("merge")  # the same plan at every size
        hot = work.table(rows.join(merged, "a", "left_semi"), self._name("hot"))
        old = work.table(past.join(merged, "a", "left_semi"), self._name("old"))

        # stretches that are equal as a whole
        first = hot.select("a", "c", "doc_id").unionByName(old.select("a", "c", "doc_id")).groupBy("a", "c").agg(F.min("doc_id").alias("first"))
        first = work.table(first, self._name("first"))
        judged = work.table(hot.join(first.hint("merge"), ["a", "c"]), self._name("judged"))
        whole = judged.where("doc_id > first").select("doc_id", "h", "s", "e")
        own = judged.where("doc_id = first").drop("first")

        # fingerprints with several different stretches: window by window
        several = work.table(first.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), self._name("several"))
        spans = own.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False))).join(several.hint("merge"), "a", "left_semi")
        spans = work.table(spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e", "fresh")).alias("spans")), self._name("spans"))
        texts = docs if indexed is None else docs.unionByName(pick(indexed, "doc_id", "text").where(F.col("doc_id").isNotNull()))
        named = work.table(spans.select("doc_id").distinct(), self._name("named"))
        texts = narrowed(texts, named, "doc_id", self.limit).join(spans.hint("merge"), "doc_id").select("doc_id", "h", "text", "spans")
        windows = work.table(texts.mapInArrow(tidy(_expand(w)), "w1 long, w2 long, doc_id long, h int, s int, fresh boolean"), self._name("windows"))
        ends = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        ends = work.table(ends, self._name("ends"))
        single = windows.where("fresh").join(ends.hint("merge"), ["w1", "w2"]).where("doc_id > first").select("doc_id", "h", "s", F.col("s").alias("e"))

        if keep:
            alone = rows.join(merged, "a", "left_anti")
            self._append(alone.unionByName(own).select("a", "c", "doc_id", "h", "s", "e"))
        found = work.table(whole.unionByName(single), self._name("found"))
        for name in self._open:
            work.drop(name)
        self._open.clear()
        return found


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "_ranges"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _cut(text: str | None, spans: list[dict] | None, window: int) -> tuple[Words, bytes, int]:
    """The words of a text, the kept ones joined, and how many go."""
    words = Words(text)
    h = _key(text) if spans else 0
    own = [x for x in spans or () if x["h"] == h]
    if not own:
        return words, words.joined, 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, [x["s"] for x in own], 1)
    np.add.at(edge, [x["e"] + window for x in own], -1)
    stay = np.cumsum(edge[:-1]) == 0
    parts = words.list()
    return words, b" ".join([parts[i] for i in np.flatnonzero(stay).tolist()]), int(len(words) - stay.sum())


def _digests(window: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests = [], [], []
            for text, spans in zip(b.column("text"), b.column(column).to_pylist()):
                words, left, gone = _cut(text.as_py(), spans, window)
                n_words.append(len(words))
                n_removed.append(gone)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(window: int, drop_emptied: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("text")
            kept, stay = [], []
            for text, spans in zip(b.column(at), b.column(b.schema.names.index(column)).to_pylist()):
                text = text.as_py()
                _, left, gone = _cut(text, spans, window)
                kept.append(left.decode("utf-8", "surrogatepass") if gone else text)
                stay.append(not (drop_emptied and gone and not left))
            names = [n for n in b.schema.names if n != column]
            out = [pa.array(kept, pa.string()) if n == "text" else b.column(b.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(stay, pa.bool_()))

    return run


def removed_ranges(docs: DataFrame, window: int = 50, gram: int = 8, batches: int = BATCHES, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row (doc_id, hs) for each document that loses words: its ranges of windows, found batch by batch."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, gram, FANOUT, broadcast_limit)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).head()["q"] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    found = spark.createDataFrame([], "doc_id long, h int, s int, e int")
    col = F.col("doc_id")
    for i in range(len(edges) - 1):
        part, past = docs, None
        if edges[i] is not None:
            part, past = part.where(col > edges[i]), docs.where(col <= edges[i])
        if edges[i + 1] is not None:
            part = part.where(col <= edges[i + 1])
        found = found.unionByName(index.batch(part, past, keep=i + 2 < len(edges)))
    out = index.work.table(found.groupBy("doc_id").agg(F.collect_set(F.struct("h", "s", "e")).alias("hs")), "ranges")
    index.drop()
    return out


def _with_ranges(docs: DataFrame, ranges: DataFrame, broadcast_limit: int, column: str) -> DataFrame:
    """``docs`` with the ranges of each row that loses words; the texts of other rows are not moved if the list of ids is small."""
    ranges = ranges.withColumnRenamed("hs", column)
    ids = ranges.select("doc_id")
    if not small_enough(ids, 24, broadcast_limit):
        return docs.join(ranges, "doc_id", "left")
    hit = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(ranges, "doc_id")
    rest = docs.join(F.broadcast(ids), "doc_id", "left_anti").withColumn(column, F.lit(None).cast("array<struct<h:int,s:int,e:int>>"))
    return hit.unionByName(rest)


def substring_dedup(docs: DataFrame, window: int = 50, batches: int = BATCHES, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per document doc_id, n_words, n_removed and kept_sha256 (of the kept words with single blanks between)."""
    docs = pick(docs, "doc_id", "text")
    ranges = removed_ranges(docs, window, batches=batches, broadcast_limit=broadcast_limit)
    joined = _with_ranges(docs, ranges, broadcast_limit, "_ranges")
    return joined.mapInArrow(tidy(_digests(window, "_ranges")), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50, batches: int = BATCHES, drop_emptied: bool = True, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs``, with all columns, without the repeated words: texts that lose none stay as they are, the others are their
    kept words with single blanks between. Documents of which nothing is left go with ``drop_emptied``."""
    ranges = removed_ranges(pick(docs, "doc_id", "text"), window, batches=batches, broadcast_limit=broadcast_limit)
    column = _free_name(docs)
    joined = _with_ranges(docs, ranges, broadcast_limit, column)
    return joined.select(*(F.col(f"`{n}`") for n in docs.columns), column).mapInArrow(tidy(_texts(window, drop_emptied, column)), docs.schema)
