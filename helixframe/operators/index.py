"""Family indexes: inverted lists of each family's vectors, or one flat list for small families.

An index is two tables: ``centers`` (family_id, list, center) and ``lists`` (family_id, list, protein_id, v), the latter in
folders (``bucket``) to which lists are dealt by a hash, and in each folder in the order of family and list. A search that
probes some lists of its queries' families reads only the folders of those, and of their rows moves only those of probed lists. How
many lists a family gets follows from its size (``plan``). Centres are trained on at most ``TRAIN`` rows a list, those of the
smallest hashes of their ids; every row is then put into the list of its nearest centre. A search that probes all lists is
exhaustive; ``probes_for`` measures how many have to be probed for a recall.

Float indexes hold vectors of unit length and compare by inner product, binary ones hold signs and count differing bits.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import Scratch, ship
from . import blocks

#: Rows that training needs for each list, and that it uses at most.
LEAST, TRAIN = 39, 256
#: Rounds of training.
ROUNDS = 10
#: Family indexes that are held open.
OPEN = 10
#: Lists of a folder, about, and the most folders.
FOLDER, FOLDERS = 4, 2048


def plan(rows: DataFrame, binary: bool = False, lists: int = 10) -> DataFrame:
    """(family_id, num_proteins, embedding_dim, index_type, nlist, metric) of each family.

    Float: ``lists`` lists, at most one for each ``LEAST`` rows, one flat list for fewer rows than that. Binary: one list for
    each ten rows up to a hundred lists, and one for each ``LEAST`` rows where those are too few to train them.
    """
    out = rows.groupBy("family_id").agg(F.count("*").alias("num_proteins"), F.max(F.size("v")).alias("embedding_dim"))
    n = F.col("num_proteins")
    if binary:
        wanted = F.greatest(F.least(F.lit(100), F.floor(n / 10)), F.lit(1))
        nlist = F.when(n < wanted * LEAST, F.greatest(F.lit(1), F.floor(n / LEAST))).otherwise(wanted)
        kind, metric = F.lit("IVF_binary"), "hamming"
    else:
        nlist = F.greatest(F.lit(1), F.least(F.lit(lists), F.floor(n / LEAST)))
        kind, metric = F.when(n < LEAST, "Flat_float").otherwise("IVF_float"), "cosine"
    return out.select("family_id", "num_proteins", "embedding_dim", kind.alias("index_type"), nlist.cast("int").alias("nlist"), F.lit(metric).alias("metric"))


def _train(binary: bool):
    def run(table: pa.Table) -> pa.Table:
        n = table.column("nlist")[0].as_py()
        v = blocks.matrix(table.sort_by([("place", "ascending")]).column("v"))
        centers = v[:n]
        for _ in range(ROUNDS if len(centers) > 1 else 1):
            near = (blocks.differing(v, centers) if binary else -blocks.dots(v, centers)).argmin(axis=1)
            sums = np.zeros(centers.shape)
            np.add.at(sums, near, np.where(v > 0, 1.0, -1.0) if binary else v)
            full = np.bincount(near, minlength=len(centers)) > 0
            size = blocks.norms(sums)
            moved = np.where((full & (size > 0))[:, None], sums / np.where(size > 0, size, 1)[:, None], centers)
            if np.array_equal(moved, centers):
                break
            centers = moved
        family = table.column("family_id").combine_chunks().take(pa.array(np.zeros(len(centers), dtype=np.int64)))
        return pa.table({"family_id": family, "list": pa.array(np.arange(len(centers), dtype=np.int32)), "center": pa.array(list(centers), pa.list_(pa.float64()))})

    return run


def train(rows: DataFrame, planned: DataFrame, binary: bool = False) -> DataFrame:
    """(family_id, list, center) of each family."""
    ship(rows.sparkSession)
    # twice as many rows as wanted have a hash below this share, so that the order is made of those only
    known = rows.join(planned.select("family_id", "nlist", "num_proteins"), "family_id").withColumn("hash", F.xxhash64("protein_id"))
    near = known.where((F.col("hash") / 2.0**64 + 0.5) * F.col("num_proteins") <= 2.0 * F.col("nlist") * TRAIN)
    order = Window.partitionBy("family_id").orderBy("hash", "protein_id")
    sample = near.drop("num_proteins").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("nlist") * TRAIN)
    return sample.groupBy("family_id").applyInArrow(_train(binary), f"family_id {dict(rows.dtypes)['family_id']}, list int, center array<double>")


def _nearness(binary: bool, v, center):
    """Smaller is nearer."""
    return V.hamming(V.bits(v), V.bits(center)).cast("double") if binary else -V.dot(v, center)


def build(rows: DataFrame, path: str, binary: bool = False, lists: int = 10) -> FamilyIndex:
    """Write the indexes of all families of (protein_id, family_id, v) at ``path``."""
    rows = rows.where("family_id is not null and v is not null").select("protein_id", "family_id", "v" if binary else V.normalized(F.col("v")).alias("v"))
    planned = plan(rows, binary, lists)
    planned.write.mode("overwrite").parquet(f"{path}/info")
    spark = rows.sparkSession
    planned = spark.read.parquet(f"{path}/info")
    train(rows, planned, binary).write.mode("overwrite").parquet(f"{path}/centers")
    centers = spark.read.parquet(f"{path}/centers")
    all_ = centers.groupBy("family_id").agg(F.collect_list(F.struct("list", "center")).alias("all"))  # at most a hundred a family
    best = F.array_min(F.transform("all", lambda c: F.struct(_nearness(binary, F.col("v"), c["center"]).alias("d"), c["list"].alias("list"))))
    placed = rows.join(all_, "family_id").select("family_id", best["list"].alias("list"), "protein_id", "v")
    many = planned.agg(F.coalesce(F.sum("nlist"), F.lit(0))).head()[0]
    folders = max(1, min(FOLDERS, many // FOLDER))
    # folders of a hot list are written by several tasks, each with rows of few folders
    placed = placed.withColumn("bucket", _bucket(folders)).repartitionByRange("bucket", "family_id", "list", "protein_id").sortWithinPartitions("bucket", "family_id", "list", "protein_id")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    spark.range(0, 1, 1, 1).select(F.lit(folders).alias("folders")).write.mode("overwrite").parquet(f"{path}/folders")
    return FamilyIndex(spark, path, binary)


def _bucket(folders: int):
    return F.pmod(F.xxhash64("family_id", "list"), F.lit(folders)).cast("int")


class FamilyIndex:
    """The indexes at ``path``; the lists of the families asked for last stay cached, ``OPEN`` at most."""

    def __init__(self, spark: SparkSession, path: str, binary: bool = False):
        self.spark, self.path, self.binary = spark, path, binary
        self.info, self.centers, self.buckets = (spark.read.parquet(f"{path}/{n}") for n in ("info", "centers", "lists"))
        self.lists = self.buckets.drop("bucket")
        self.folders = spark.read.parquet(f"{path}/folders").head()[0]
        #: Folders that the last search with ``probe`` read.
        self.read: list[int] = []
        self._open: OrderedDict = OrderedDict()

    def family(self, family_id) -> DataFrame:
        """The rows of one family, cached; the family used longest ago is let go."""
        if family_id in self._open:
            self._open.move_to_end(family_id)
            return self._open[family_id]
        if self.info.where(F.col("family_id") == F.lit(family_id)).isEmpty():
            raise ValueError(f"no index of family {family_id!r}")
        self._open[family_id] = self.lists.where(F.col("family_id") == F.lit(family_id)).cache()
        if len(self._open) > OPEN:
            self._open.popitem(last=False)[1].unpersist()
        return self._open[family_id]

    def _nearest_lists(self, asked: DataFrame) -> DataFrame:
        """The lists of each query's family, ``n`` from 1 for the nearest."""
        near = asked.join(self.centers, "family_id").withColumn("d", _nearness(self.binary, F.col("q"), F.col("center")))
        order = Window.partitionBy("query_id", "family_id").orderBy("d", "list")
        return near.withColumn("n", F.row_number().over(order)).select("query_id", "family_id", "q", "list", "n")

    def read_lists(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted lists (family_id, list), from the folders that hold them."""
        self.read = sorted(r[0] for r in wanted.select(_bucket(self.folders).alias("b")).distinct().collect())  # FOLDERS at most
        return self.buckets.where(F.col("bucket").isin(self.read)).join(wanted, ["family_id", "list"], "left_semi")

    def probes_for(self, recall: float = 0.9, k: int = 10, queries: int = 256) -> int:
        """The fewest probed lists that find ``recall`` of the ``k`` best rows, measured on up to about ``queries`` stored rows
        (those of the smallest hashes) against the exhaustive search."""
        n = max(1, self.info.agg(F.sum("num_proteins")).head()[0] or 0)
        some = Scratch(self.spark, "recall").table(self.lists.where((F.xxhash64("protein_id", "family_id") / 2.0**64 + 0.5) * n <= queries), "queries")
        near = self._nearest_lists(some.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q")))
        best = blocks.top(some.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q")), self.lists, k, self.binary)
        where = best.select("query_id", "family_id", "protein_id").join(self.lists.select("protein_id", "family_id", "list"), ["protein_id", "family_id"])
        met = where.join(near.drop("q"), ["query_id", "family_id", "list"]).groupBy("n").agg(F.count("*").alias("found")).orderBy("n").collect()  # a row for each list of a family
        total, found = sum(r["found"] for r in met), 0
        for r in met:
            found += r["found"]
            if found >= recall * total:
                return r["n"]
        return 1

    def search_family(self, family_id, queries: DataFrame, k: int = 50) -> DataFrame:
        """The ``k`` best rows of one family, held open, for each query (protein_id, v): query_id, protein_id, score, rank."""
        rows = self.family(family_id)
        asked = queries.select(F.col("protein_id").alias("query_id"), F.lit(family_id).cast(dict(rows.dtypes)["family_id"]).alias("family_id"), F.col("v").alias("q"))
        return blocks.top(asked, rows, k, self.binary).drop("family_id")

    def search(self, queries: DataFrame, k: int = 50, probe: int | None = None) -> DataFrame:
        """The ``k`` best rows of each query (protein_id, family_id, v) in the ``probe`` lists of its family that are nearest
        to it (all, if None): query_id, protein_id, score, rank. The score is the cosine or the number of differing signs."""
        asked = queries.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
        if probe is None:
            return blocks.top(asked, self.lists, k, self.binary).drop("family_id")
        near = Scratch(self.spark, "probes").table(self._nearest_lists(asked).where(F.col("n") <= probe), "near")
        lists = self.read_lists(near.select("family_id", "list").distinct())
        # a list is a family of its own here
        near = near.select("query_id", F.struct("family_id", "list").alias("family_id"), "q")
        rows = lists.select("protein_id", F.struct("family_id", "list").alias("family_id"), "v")
        found = blocks.top(near.withColumn("family_id", F.to_json("family_id")), rows.withColumn("family_id", F.to_json("family_id")), k, self.binary)
        best = Window.partitionBy("query_id").orderBy("score" if self.binary else F.desc("score"), "protein_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "protein_id", "score", "rank")


def padded(matches: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``matches`` (query_id, rank, protein_id, distance) with ``k`` rows for each query: what is missing reads UNKNOWN, at an
    infinite distance."""
    every = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    out = every.join(matches.select("query_id", "rank", F.col("protein_id").cast("string").alias("protein_id"), "distance"), ["query_id", "rank"], "left")
    return out.select("query_id", "rank", F.coalesce("protein_id", F.lit("UNKNOWN")).alias("protein_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))
