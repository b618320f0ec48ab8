"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents in the order of doc_id. Rounds visit the queues in turn. In each round a
queue's deficit counter grows by its quantum, its share of the target proportions of a window of ``size`` tokens; the queue
gives as many tokens as the counter holds whole ones, and what is left of the counter is carried on to the next round. A
queue that runs empty leaves the round, so the others fill its part. Windows are cut from the stream of the rounds every
``size`` tokens, wherever that falls in a round; so deficits pass over windows, and every window holds the target proportions
of the queues that still have tokens to within a few tokens. Inside a window each queue's tokens stand together.

Tokens may be cut apart freely, so that the counters have a closed form: after r rounds queue i has given
min(total_i, floor(r * quantum_i)) tokens. Any partition finds by itself what any window takes from any queue
(``Schedule.upto``), in whole numbers, so that deficits pass over partitions alike. Every window but the last is full; the
last is padded, unless it happens to be a power of two long.

Ids are range-partitioned by source and doc_id once, at any size of the input; the driver sees the number of tokens of each
source in each partition, that is one row for each partition and source together, as ranges of sources do not overlap.

Cases: a null text is an empty one and has the end id only; null sources are one queue; null doc_ids come first; rows of
equal doc_id and source stand in the order of a hash of their ids, equal rows one after the other; long texts run over many
windows; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, prepare, tidy
from .token_binary import token_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
#: Deficits are counted in so many parts of a token.
UNIT = 1024


class Schedule:
    """How many tokens of each queue the first rounds and the first windows take."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, size: int):
        self.size, self.totals, self.total = size, totals.astype(np.int64), int(totals.sum())
        on = weights > 0
        self.quantum, self.begin = np.ones(len(totals), dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
        for these, shares in ((on, weights), (~on, totals)):  # queues without a share are served when the others are empty
            if these.any():
                part = shares[these] / (shares[these].sum() or 1)
                self.quantum[these] = np.maximum(1, np.rint(part * size * UNIT))
                self.begin[these] = 0 if these is on else self.ends()[on].max(initial=0)
        self.rounds = int(self.ends().max(initial=0))

    def ends(self) -> np.ndarray:
        """The round after which each queue is empty."""
        return self.begin - -self.totals * UNIT // self.quantum

    def given(self, r: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given after r rounds."""
        return np.minimum(self.totals, np.maximum(r[:, None] - self.begin, 0) * self.quantum // UNIT)

    def window(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The window that takes token x of queue s."""
        r = self.begin[s] - -(x + 1) * UNIT // self.quantum[s]
        ahead = np.where(np.arange(len(self.totals)) < s[:, None], self.given(r), self.given(r - 1))
        ahead[np.arange(len(s)), s] = x
        return ahead.sum(axis=1) // self.size

    def upto(self, k: np.ndarray) -> np.ndarray:
        """Tokens that the first k windows take from each queue."""
        goal = np.minimum(k * self.size, self.total)
        lo, hi = np.zeros(len(k), dtype=np.int64), np.full(len(k), max(1, self.rounds), dtype=np.int64)
        below, above = np.zeros(len(k), dtype=np.int64), np.full(len(k), self.total, dtype=np.int64)
        halve = False
        while len(open_ := np.flatnonzero(hi - lo > 1)):  # the last round that is over by then
            a, b = lo[open_], hi[open_]
            step = (b - a) * (0.5 if halve else (goal[open_] - below[open_]) / np.maximum(1, above[open_] - below[open_]))
            r = np.clip(a + step.astype(np.int64), a + 1, b - 1)
            got = self.given(r).sum(axis=1)
            under = got <= goal[open_]
            lo[open_[under]], below[open_[under]] = r[under], got[under]
            hi[open_[~under]], above[open_[~under]] = r[~under], got[~under]
            halve = not halve
        q = self.given(lo)
        more = self.given(lo + 1) - q
        return q + np.clip((goal - below)[:, None] - np.cumsum(more, axis=1) + more, 0, more)

    def cut(self, x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that hold tokens x to x + n - 1 of queue s: document, first token, length, window, offset."""
        a, b = self.window(x, s), self.window(x + n - 1, s)
        many = b - a + 1
        doc = np.repeat(np.arange(len(x)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + a[doc]
        ks, at = np.unique(np.concatenate([k, k + 1]), return_inverse=True)
        q = self.upto(ks)
        lo, hi, own = q[at[: len(k)]], q[at[len(k) :]], s[doc]
        row = np.arange(len(doc))
        ahead = np.where(np.arange(q.shape[1])[None, :] < own[:, None], hi - lo, 0).sum(axis=1)
        first = np.maximum(x[doc], lo[row, own])
        last = np.minimum((x + n)[doc], hi[row, own])
        keep = last > first
        return doc[keep], (first - x[doc])[keep], (last - first)[keep], k[keep], (ahead + first - lo[row, own])[keep]


def _place(width: int):
    """The first place of each row's tokens among those of its queue in this partition; rows come in the order of source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, so_far = None, 0
        for b in batches:
            n, local = [], []
            for source, size in zip(b.column("source").to_pylist(), b.column("size").to_pylist()):
                if source != now:
                    now, so_far = source, 0
                n.append(size // width)
                local.append(so_far)
                so_far += n[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "ids", "part")), pa.array(n, pa.int64()), pa.array(local, pa.int64())], names=["doc_id", "source", "ids", "part", "n", "local"])

    return run


def _pieces(plan, kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base, totals, weights = plan.value
        schedule, index = Schedule(totals, weights, size), {n: i for i, n in enumerate(names)}
        step = max(1, min(512, 2_000_000 // max(1, len(names))))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                source, place, local, n = (part.column(c).to_pylist() for c in ("source", "part", "local", "n"))
                x = np.array([base[p, s] + at for p, s, at in zip(place, source, local)], dtype=np.int64)
                n = np.array(n, dtype=np.int64)
                doc, start, length, window, offset = schedule.cut(x, n, np.array([index[v] for v in source]))
                raw = [np.frombuffer(v.as_buffer(), dtype=kind).astype("<u4").tobytes() for v in part.column("ids")]
                crc = [zlib.crc32(raw[d][4 * f : 4 * (f + m)]) for d, f, m in zip(doc.tolist(), start.tolist(), length.tolist())]
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(offset), part.column("source").take(own)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents of (doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and source. ``targets`` gives the share of each source, and sources it does not name come last. Without it a source's
    share is its share of all tokens, the only one that every window can hold when all tokens are packed once."""
    spark = docs.sparkSession
    prepare(spark)
    work = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"))
    ids, kind = token_ids(docs, tokenizer, end_id, work, "ids", "source")
    keyed = ids.withColumn("hash", F.xxhash64("ids")).withColumn("size", F.octet_length("ids"))
    order = ("source", "doc_id", "hash")
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = work.table(placed.mapInArrow(tidy(_place(int(kind[-1]))), "doc_id long, source string, ids binary, part int, n long, local long"), "placed")
    work.drop("ids")

    base, totals = {}, Counter()
    for part, source, n in sorted(placed.groupBy("part", "source").agg(F.sum("n")).collect(), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        base[part, source] = totals[source]
        totals[source] += n
    names = sorted(totals, key=lambda v: (v is not None, v or ""))
    shares = np.array([(targets.get(v, 0) if targets else totals[v]) for v in names], dtype=np.float64)
    plan = spark.sparkContext.broadcast((names, base, np.array([totals[v] for v in names], dtype=np.int64), shares))
    return placed.mapInArrow(tidy(_pieces(plan, kind, size)), PIECES)
