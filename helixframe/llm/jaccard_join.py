"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of ``k``-word shingles. Equal sets form one class first, so copies meet once. Each class gets
``bands`` x ``rows`` min-hashes; ``rows`` and ``bands`` are chosen so that a pair at the threshold meets in some band with
the target recall (``plan_bands``). Classes are shuffled on their band hashes; bands that only repeat an earlier band's
meeting are left out. Buckets of more than ``block`` classes, or ``_BLOCK_BYTES`` of shingles, are dealt out as pairs of
blocks, so that no task holds more than two blocks of any bucket. In each task all pairs that first meet in this band are verified on their full shingle sets by
blocked matrix products; counts of links and a spanning forest leave the task, never the pairs.

Result, one row per document: doc_id, class_id (the smallest doc_id of its linked group), n_links (other documents within
the threshold, copies counted) and n_texts (different shingle sets within it).

Shingles stand as 64-bit hashes of their words' hashes, each of them spread by a mixing that is not linear; two different
shingles of two texts with 1,000 each agree by chance once in 10**13 such pairs of texts.

Cases: texts of fewer than ``k`` words are one shingle of all their words; long texts count whole; null texts and texts without words link to
nothing; rows of equal doc_id are documents of their own but share an id; rows with null doc_id keep a null class and no
links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import BROADCAST_LIMIT, Scratch, checked_join, prepare, tidy
from .text import mix, shingles

#: Classes of a block.
BLOCK = 1024
#: A pair counts as dissimilar at this similarity, and its meeting costs as much as so many min-hashes.
_DISSIMILAR, _MEETING = 0.3, 500
#: Columns of a dense slice in verification, and bytes of shingle hashes of a block.
_SLICE, _BLOCK_BYTES = 2048, 2 << 20


def plan_bands(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and rows: of all row counts with the fewest bands that let a pair at ``threshold`` meet with probability
    ``recall`` the one of least cost, min-hashes and the meetings of dissimilar pairs together."""

    def cost(rows: int) -> float:
        return bands(rows) * rows + _MEETING * (1 - (1 - _DISSIMILAR**rows) ** bands(rows))

    def bands(rows: int) -> int:
        return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(threshold, 1 - 1e-12) ** rows))))

    best = min(range(1, 17), key=cost)
    return bands(best), best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sh: np.ndarray, mult: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band."""
    low = np.empty(len(mult), dtype=np.uint64)
    for i, m in enumerate(mult):
        low[i] = (sh * m).min()
    low = mix(low).reshape(bands, -1)
    out = np.zeros(bands, dtype=np.uint64)
    for j in range(low.shape[1]):
        out = mix(out ^ low[:, j])
    return out.view(np.int64)


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers(bands * rows)
        for b in batches:
            d1, d2, sigs, sizes = [], [], [], []
            for text in b.column("text"):
                sh = shingles(text.as_py(), k)
                sizes.append(len(sh))
                if not len(sh):
                    d1.append(None)
                    d2.append(None)
                    sigs.append(None)
                    continue
                d = xxhash.xxh3_128_digest(sh.tobytes())
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                sigs.append(signature(sh, mult, bands))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["doc_id", "key", "d1", "d2", "sig", "m"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, d1, d2 = [], [], []
            for text in b.column("text"):
                sh = shingles(text.as_py(), k)
                d = xxhash.xxh3_128_digest(sh.tobytes())
                out.append(sh.tobytes())
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "d1", "d2", "sh"])

    return run


def overlaps(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of each of the first ``cut`` sets with each set (all sets, if ``cut`` is their number)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    common = counts[inverse] > 1
    owner, column = owner[common], rank[inverse[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((cut, len(sets)), dtype=np.float32)
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, _SLICE):
        lo, hi = np.searchsorted(column, [at, at + _SLICE])
        m = np.zeros((len(sets), _SLICE), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[:cut] @ m.T
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        band, x, y = (table.column(n)[0].as_py() for n in ("band", "x", "y"))
        side = np.array(table.column("side").to_pylist())
        order = np.argsort(side != x, kind="stable") if x != y else np.arange(len(side))
        cut = int((side == x).sum())
        ids = np.array(table.column("doc_id").to_pylist(), dtype=np.int64)[order]
        copies = np.array(table.column("copies").to_pylist(), dtype=np.int64)[order]
        sigs = np.array(table.column("sig").to_pylist(), dtype=np.int64)[order]
        sets = table.column("sh").to_pylist()
        sets = [np.frombuffer(sets[i], dtype=np.uint64) for i in order]
        n = len(ids)
        pair = np.ones((cut, n), dtype=bool)
        if x == y:
            pair &= np.triu(np.ones((n, n), dtype=bool), 1)
        else:
            pair[:, :cut] = False
        for t in range(band):  # pairs that met in an earlier band are judged there
            pair &= sigs[:cut, t, None] != sigs[None, :, t]
        links = np.zeros(n, dtype=np.int64)
        texts = np.zeros(n, dtype=np.int64)
        root = np.arange(n)
        if pair.any():
            size = np.array([len(s) for s in sets], dtype=np.float64)
            met = overlaps(sets, cut).astype(np.float64)
            near = pair & (met >= threshold * (size[:cut, None] + size[None, :] - met) - 1e-9)
            links[:cut] += near @ copies
            links += copies[:cut] @ near
            texts[:cut] += near.sum(axis=1)
            texts += near.sum(axis=0)

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(*np.nonzero(near)):
                i, j = find(i), find(j)
                if i != j:
                    i, j = (i, j) if ids[i] <= ids[j] else (j, i)
                    root[j] = i
            root = np.array([find(i) for i in range(n)])
        hit = texts > 0
        return pa.table({"doc_id": pa.array(ids[hit]), "links": pa.array(links[hit]), "texts": pa.array(texts[hit]), "root": pa.array(ids[root[hit]])})

    return run


def text_key() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text", F.octet_length("text"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995, block: int = BLOCK, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Class and number of links of each document; see the module's text."""
    return classified(docs, threshold, k, recall, block, broadcast_limit).select("doc_id", "class_id", "n_links", "n_texts")


def one_of_each(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs``, with all columns, with one row of each linked group: the one of the smallest doc_id, of several rows of that
    id the one of the smallest text key, of equal ones any. A group is all that links lead to, so a document may go whose
    only link is to another one that goes. Rows without a doc_id or without words stay."""
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "one-of-each")
    rows = classified(docs, threshold, k, recall, BLOCK, broadcast_limit).where("class_id is not null and worded")
    rows = work.table(rows.groupBy("class_id", "doc_id", "key").agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    judged = rows.join(first, "class_id").select("doc_id", "key", "n", (F.struct("doc_id", "key") == F.col("first")).alias("stays"))
    judged = work.table(judged.where("not stays or n > 1"), "judged")
    gone = work.table(judged.where("not stays").select("doc_id", "key").distinct(), "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    doc, key = f"doc-{work.path[-32:]}", f"key-{work.path[-32:]}"
    keyed = docs.select(*names, F.col("doc_id").cast("long").alias(doc), text_key().alias(key))
    on = (F.col(f"`{doc}`") == F.col(f"`{doc}-`")) & (F.col(f"`{key}`") == F.col(f"`{key}-`"))
    as_key = lambda t: t.select(F.col("doc_id").alias(f"{doc}-"), F.col("key").alias(f"{key}-"))
    out = checked_join(keyed, as_key(gone), on, "left_anti", 32, broadcast_limit)
    again = judged.where("stays").select("doc_id", "key")
    if not again.isEmpty():  # equal rows with the id that stays
        again = work.table(again, "again")
        copies = checked_join(out, as_key(again), on, "left_semi", 32, broadcast_limit).dropDuplicates([doc, key])
        out = checked_join(out, as_key(again), on, "left_anti", 32, broadcast_limit).unionByName(copies)
    return out.select(*names)


def classified(docs: DataFrame, threshold: float, k: int, recall: float, block: int, broadcast_limit: int) -> DataFrame:
    """The rows of ``jaccard_join``, with the key of each text and whether it has words."""
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = plan_bands(threshold, recall)
    work = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    known = docs.where(F.col("doc_id").isNotNull()).drop("key")
    sketch = work.table(docs.mapInArrow(tidy(_sketch(k, bands, rows)), "doc_id long, key long, d1 long, d2 long, sig array<long>, m int"), "sketch")
    real = sketch.where("doc_id is not null and d1 is not null")

    # one class for each set of shingles, named by its smallest document
    sizes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    sizes = work.table(sizes, "classes")
    reps = real.join(sizes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    reps = work.table(reps.select("doc_id", "d1", "d2", "copies", "sig", "m"), "reps")

    # buckets with two members or more
    bucket = reps.select("doc_id", "d1", "d2", "m", F.posexplode("sig").alias("band", "bucket"))
    full = work.table(bucket.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum(F.col("m").cast("long") * 8).alias("bytes")).where("n > 1"), "full")
    member = work.table(bucket.drop("m").join(full, ["band", "bucket"]), "members")
    member = member.join(reps.select("doc_id", "d1", "d2", "copies", "sig"), ["doc_id", "d1", "d2"])
    # a bucket whose members all meet in one earlier band has nothing new
    same = [(F.min(F.col("sig")[i]) == F.max(F.col("sig")[i])).alias(f"s{i}") for i in range(bands - 1)]
    told = member.groupBy("band", "bucket").agg(*same)
    again = F.lit(False)
    for i in range(bands - 1):
        again |= (F.col("band") > i) & F.col(f"s{i}")
    fresh = work.table(told.where(~again).select("band", "bucket"), "fresh")
    member = work.table(member.join(fresh, ["band", "bucket"]), "fresh-members")

    # large buckets as pairs of blocks
    blocks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / _BLOCK_BYTES))).cast("int")
    side = F.pmod(F.xxhash64("doc_id", "d1"), F.col("blocks")).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("side", side)
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("doc_id", "d1", "d2", "copies", "sig", "band", "bucket", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))

    # the shingle sets of the members, from their texts
    wanted = work.table(member.select("doc_id").distinct(), "wanted")
    texts = checked_join(known, wanted, "doc_id", "left_semi", 24, broadcast_limit)
    sets = texts.mapInArrow(tidy(_sets(k)), "doc_id long, d1 long, d2 long, sh binary").join(reps.select("doc_id", "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    sets = work.table(sets.dropDuplicates(["doc_id", "d1", "d2"]), "sets")
    loaded = member.join(sets, ["doc_id", "d1", "d2"]).select("band", "bucket", "x", "y", "side", "doc_id", "copies", "sig", "sh")
    linked = loaded.groupBy("band", "bucket", "x", "y").applyInArrow(_verify(threshold), "doc_id long, links long, texts long, root long")
    linked = work.table(linked, "linked")

    totals = linked.groupBy("doc_id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    labels = components(linked.where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b")).distinct(), work)
    classes = sizes.join(totals, sizes["rep"] == totals["doc_id"], "left").drop("doc_id").join(labels, F.col("rep") == F.col("id"), "left")
    classes = classes.select("d1", "d2", F.coalesce("label", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    classes = work.table(classes, "classified")
    ids = sketch.select("doc_id", "key", "d1", "d2")
    out = ids.join(classes, ["d1", "d2"], "left")
    known_id = F.col("doc_id").isNotNull()
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "key", F.col("d1").isNotNull().alias("worded"), F.when(known_id, F.coalesce("class", "doc_id")).alias("class_id"), F.when(known_id, F.coalesce("links", zero)).otherwise(zero).alias("n_links"), F.when(known_id, F.coalesce("texts", zero)).otherwise(zero).alias("n_texts"))
