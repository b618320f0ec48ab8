"""Family tables: centroids, medoids, assignment by binarized centroids, lookups and re-sharding.

Proteins are (protein_id, family_id, v), v an array of doubles; centroids are (family_id, ordinal, centroid, bits,
medoid_id). Centroids are as many as families, and are sent to executors in parts of at most ``CENTROID_LIMIT`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import vectors as V
from ..session import Scratch, ship

CENTROID_LIMIT = 64 << 20


def proteins(embeddings: DataFrame, id_col: str = "vec_id", family_col: str = "label", vector_col: str = "embedding", as_stored: bool = False) -> DataFrame:
    """Rows of a table of vectors, ``as_stored`` in their own type, which searches move as it is."""
    v = F.col(vector_col) if as_stored else V.doubles(F.col(vector_col))
    return embeddings.select(F.col(id_col).alias("protein_id"), F.col(family_col).alias("family_id"), v.alias("v"))


def family_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family_id").agg(F.count("*").alias("num_proteins"), F.max(F.size("v")).alias("embedding_dim"))


def family_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col("family_id").cast("string"), F.lit("Unknown")).alias("family")).agg(F.count("*").alias("n"))


def centroid_values(rows: DataFrame) -> DataFrame:
    """(family_id, pos, mean): means are summed map-side, a row for each family and place leaves a task."""
    return rows.select("family_id", F.posexplode("v").alias("pos", "x")).groupBy("family_id", "pos").agg(F.avg("x").alias("mean"))


def centroids(rows: DataFrame) -> DataFrame:
    means = centroid_values(rows).groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
    means = means.select("family_id", F.col("m.mean").alias("centroid"))
    return means.withColumn("bits", V.bits(F.col("centroid")))


def medoids(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """The member nearest to its family's centroid, of equals the smallest id, with its distance."""
    d = rows.join(small(cents.select("family_id", "centroid")), "family_id").select("family_id", "protein_id", V.l2(F.col("v"), F.col("centroid")).alias("d"))
    best = d.groupBy("family_id").agg(F.min(F.struct("d", "protein_id")).alias("m"))
    return best.select("family_id", F.col("m.protein_id").alias("medoid_id"), F.col("m.d").alias("distance"))


def small(cents: DataFrame) -> DataFrame:
    """Broadcast a centroid table whose size is within the limit; larger ones are left to the planner."""
    n, dim = cents.agg(F.count("*"), F.max(F.size("centroid"))).head()
    return F.broadcast(cents) if n * (dim or 0) * 9 <= CENTROID_LIMIT else cents


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words, padded with zeros."""
    packed = np.packbits(bits.astype(bool), axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The lengths of a column's bit arrays, with the places and the words of those of each; null and empty ones are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, _words(flat.reshape(len(at), dim))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, at, words in _by_length(batch.column("bits")):
            yield pa.RecordBatch.from_arrays([batch.column("family_id").take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())], ["family_id", "dim", "words"])


class Signs:
    """The bits of centroids (family_id, bits), packed and written once, in blocks of at most ``limit`` bytes.

    Centroids without a family or bits are left out. A stream makes them once and gives them to ``assign`` with every batch.
    """

    def __init__(self, cents: DataFrame, limit: int = CENTROID_LIMIT):
        self.spark = cents.sparkSession
        ship(self.spark)
        known = cents.select("family_id", "bits").where("family_id is not null and bits is not null")
        self.kind = dict(known.dtypes)["family_id"]
        packed = known.mapInArrow(_packed, f"family_id {self.kind}, dim int, words binary")
        seen = Observation()
        size = F.sum(F.octet_length("words") + F.octet_length(F.col("family_id").cast("string")) + 16)
        self.table = Scratch(self.spark, "centroids").table(packed.observe(seen, size.alias("size")), "bits")
        self.blocks = max(1, -(-(seen.get["size"] or 0) // limit))
        self._only = None

    def sent(self, i: int) -> Broadcast:
        """Block ``i`` on its way to the executors: for each length of vectors the families in order and their words. A block
        that is the only one is sent once."""
        if self._only is not None:
            return self._only
        found = self.table.where(F.pmod(F.xxhash64("family_id"), F.lit(self.blocks)) == i).toArrow().sort_by("family_id")
        sizes = found.column("dim").to_numpy()
        block = {}
        for dim in np.unique(sizes).tolist():
            own = found.filter(pa.array(sizes == dim))
            words = np.frombuffer(b"".join(own.column("words").to_pylist()), dtype=np.uint64)
            block[dim] = own.column("family_id").combine_chunks(), words.reshape(own.num_rows, -1)
        out = self.spark.sparkContext.broadcast(block)
        if self.blocks == 1:
            self._only = out
        return out


#: Differences that a task holds at a time.
_HELD = 1 << 21


def _nearer(sent: Broadcast):
    """Rows whose best family so far gives way to one of a block, if that differs in fewer places or has the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, family = batch.column("hamming"), batch.column("assigned")
            for dim, at, words in _by_length(batch.column("_bits")):
                if dim not in sent.value:
                    continue
                ids, known = sent.value[dim]
                near, least = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int32)
                step = max(1, _HELD // len(ids))
                for i in range(0, len(at), step):
                    differ = np.zeros((len(words[i : i + step]), len(ids)), dtype=np.int32)
                    for mine, theirs in zip(words[i : i + step].T, known.T):
                        differ += np.bitwise_count(mine[:, None] ^ theirs[None, :])
                    near[i : i + step] = differ.argmin(axis=1)  # ids ascend, so ties go to the smaller
                    least[i : i + step] = np.take_along_axis(differ, near[i : i + step, None], 1)[:, 0]
                new, h, there = ids.take(pa.array(near)), pa.array(least), pa.array(at)
                old_h, old = best.take(there), family.take(there)
                wins = pc.or_kleene(pc.less(h, old_h), pc.and_kleene(pc.equal(h, old_h), pc.less(new, old)))
                wins = pc.fill_null(wins, True)  # nothing so far
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[at] = wins.to_numpy(zero_copy_only=False)
                best = pc.replace_with_mask(best, pa.array(mask), h.filter(wins))
                family = pc.replace_with_mask(family, pa.array(mask), new.filter(wins))
            columns = {**{n: batch.column(n) for n in batch.schema.names}, "hamming": best, "assigned": family}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def assign(rows: DataFrame, cents: DataFrame | Signs, min_confidence: float | None = None, limit: int = CENTROID_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(protein_id, assigned, hamming, confidence, and the columns ``keep``): the family whose centroid bits differ least, ties to
    the smaller family; its columns' names are not those of ``keep``.

    Packed centroids go to the executors, and batches of rows are compared with all of them where they are: no row is shuffled,
    and there is none for a pair. Centroids of more than ``limit`` bytes make several passes with a block each; what a
    pass finds is written before the next block is sent, so that one block is held at a time. A vector meets centroids of its
    own length; one that has none, or is null or empty, is assigned to no family with null scores.
    """
    signs = cents if isinstance(cents, Signs) else Signs(cents, limit)
    out = rows.select("protein_id", *keep, V.bits(F.col("v")).alias("_bits"), F.lit(None).cast("int").alias("hamming"), F.lit(None).cast(signs.kind).alias("assigned"))
    work = Scratch(rows.sparkSession, "assigned") if signs.blocks > 1 else None
    for i in range(signs.blocks):
        sent = signs.sent(i)
        out = out.mapInArrow(_nearer(sent), out.schema)
        if work:
            out = work.table(out, f"pass-{i}")
            sent.destroy()
            if i:
                work.drop(f"pass-{i - 1}")
    conf = 1 - F.col("hamming") / F.nullif(F.size("_bits"), F.lit(0))
    family = F.col("assigned") if min_confidence is None else F.when(conf >= min_confidence, F.col("assigned"))
    return out.select("protein_id", family.alias("assigned"), "hamming", conf.alias("confidence"), *keep)


def existence(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each requested id: protein_id, exists, family_id."""
    known = rows.select(F.col("protein_id").cast("string").alias("protein_id"), "family_id", F.lit(True).alias("found"))
    return queries.select(F.trim("protein_id").alias("protein_id"), *[c for c in queries.columns if c != "protein_id"]).join(known, "protein_id", "left").withColumn("exists", F.coalesce("found", F.lit(False))).drop("found")


def ordinals(rows: DataFrame, by: str = "protein_id", per: str | None = None) -> DataFrame:
    """Places from 0 in the order of ``by``, within each ``per`` if one is given (null is a value of its own).

    Rows are range-partitioned, sorted and numbered, and each partition adds the number of rows before it, so that no task
    sees more than its own part, however many rows one value of ``per`` has. Rows of equal ``by`` get places in any order.
    """
    keys = [per, by] if per else [by]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    # written, so that the sizes are those of the very partitions that were numbered
    placed = Scratch(rows.sparkSession, "ordinals").table(placed, "placed")
    if not per:
        sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
        before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
        return placed.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
    # a row for each value of ``per`` and partition that has it: a place in the partition becomes one among the value's rows
    sizes = placed.groupBy(F.col(per).alias("_per"), F.col("_part").alias("_in")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = sizes.select("_per", "_in", (F.sum("n").over(Window.partitionBy("_per").orderBy("_in")) - F.col("n") - F.col("_first")).alias("_shift"))
    found = placed.join(before, (F.col("_part") == F.col("_in")) & F.col(per).eqNullSafe(F.col("_per")))
    return found.withColumn("ordinal", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_per", "_in", "_shift")


def slice_rows(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) of each family in the order of ids."""
    return ordinals(rows, per="family_id").where(F.col("ordinal").between(start, end - 1))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Batch number of each row within its family."""
    return ordinals(rows, per="family_id").withColumn("batch", F.floor(F.col("ordinal") / size))


def artificial_families(rows: DataFrame, size: int) -> DataFrame:
    """Families of ``size`` consecutive ids."""
    return ordinals(rows).withColumn("family", F.concat(F.lit("family_"), F.floor(F.col("ordinal") / size)))


def reshard(embeddings: DataFrame, metadata: DataFrame, family_col: str) -> DataFrame:
    """Embeddings with the file-safe family of their metadata; ids on one side only are dropped."""
    return embeddings.join(metadata.select("protein_id", F.col(family_col).cast("string").alias("family_name")), "protein_id").withColumn("family_dir", S.file_safe(F.col("family_name")))


def has_dimension(rows: DataFrame, dim: int, vector_col: str = "v") -> DataFrame:
    """Rows with ``valid``: whether their vector has ``dim`` finite components."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("valid", F.coalesce((F.size(v) == dim) & finite, F.lit(False)))


def assign_with_metadata(rows: DataFrame, cents: DataFrame, meds: DataFrame, metadata: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """``assign`` with the representative of the assigned family (its medoid) and the protein's own metadata."""
    out = assign(rows, cents, min_confidence).join(meds.select(F.col("family_id").alias("assigned"), F.col("medoid_id").alias("representative")), "assigned", "left")
    return out.select("protein_id", "assigned", "hamming", "confidence", "representative").join(metadata, "protein_id", "left")


def size_estimate(rows: DataFrame, max_gb: float = 4.0) -> DataFrame:
    """Per family the bytes of its vectors as 32-bit floats, and whether they fit ``max_gb`` or are read in batches."""
    size = F.col("num_proteins") * F.col("embedding_dim") * 4
    return family_stats(rows).select("family_id", size.alias("bytes"), F.when(size > max_gb * 2**30, "batched").otherwise("whole").alias("loading"))


def concatenated(*sources: DataFrame, key: str = "protein_id") -> DataFrame:
    """Records of several sources one after the other, an id that came before with a number behind it, so that ids are unique.

    Records of one id keep the order of their sources, and of their sequences within one.
    """
    every = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    others = [c for c in out.columns if c not in (key, "_source") and not c.startswith("_")]
    # an id may be that of many rows, so the places are not a window's
    out = ordinals(out.withColumn("_by", F.struct("_source", *others[:1])), by="_by", per=key)
    named = F.when(F.col("ordinal") == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_"), F.col("ordinal") + 1))
    return out.withColumn(key, named).drop("ordinal", "_by", "_source")
