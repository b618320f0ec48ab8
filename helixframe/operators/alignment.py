"""Operators over several sequences: pair measures, column statistics of an alignment, clustering and trees.

An alignment is rows (protein_id, aligned) of equal length with '-' for gaps. Sequences that come unaligned are padded with
gaps on the right, as there is no aligner in the engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import graph as G


#: Sequences of a block, and letters of them that are compared at a time.
BLOCK, SLAB = 256, 4096


def _letters(texts: list[str], start: int, narrow: bool, pad: int) -> np.ndarray:
    """Letters ``start`` to ``start + SLAB`` of each text as codes, filled up with ``pad``."""
    kind, code = (np.uint8, "ascii") if narrow else (np.uint32, "utf-32-le")
    parts = [np.frombuffer(t[start : start + SLAB].encode(code), dtype=kind) for t in texts]
    out = np.full((len(parts), max(map(len, parts))), pad, dtype=kind)
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def _matching(left: list[str], right: list[str]) -> np.ndarray:
    """How many places of the common prefix agree, for all of ``left`` and ``right``."""
    n, m = (np.array([len(t) for t in side]) for side in (left, right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    narrow = all(t.isascii() for t in left) and all(t.isascii() for t in right)
    for start in range(0, min(n.max(initial=0), m.max(initial=0)), SLAB):
        i, j = np.flatnonzero(n > start), np.flatnonzero(m > start)  # sides are filled up with different codes, which never agree
        pad = 254 if narrow else 0xFFFFFFFE  # no letter's code
        a, b = _letters([left[k] for k in i], start, narrow, pad), _letters([right[k] for k in j], start, narrow, pad + 1)
        width = min(a.shape[1], b.shape[1])
        for k, row in zip(i, a[:, :width]):
            out[k, j] += (row[None, :] == b[:, :width]).sum(axis=1)
    return out


def _compared(least: float | None):
    def run(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        side = t.column("at").to_numpy()
        left = t if x == y else t.filter(pa.array(side == x))
        right = t if x == y else t.filter(pa.array(side == y))
        texts = left.column("sequence").to_pylist(), right.column("sequence").to_pylist()
        n, m = (np.array([len(s) for s in side], dtype=np.int64) for side in texts)
        found = _matching(*texts)
        wanted = np.ones(found.shape, dtype=bool)
        if least is not None:
            prefix = np.minimum(n[:, None], m[None, :])
            wanted = np.divide(found, prefix, out=np.zeros(found.shape), where=prefix > 0) >= least
        if x == y:
            wanted = np.triu(wanted, 1)
        i, j = np.nonzero(wanted)
        a, b = left.column("protein_id").combine_chunks().take(pa.array(i)), right.column("protein_id").combine_chunks().take(pa.array(j))
        low, la, lb = pc.less(a, b), pa.array(n[i], pa.int32()), pa.array(m[j], pa.int32())
        out = {"src": pc.if_else(low, a, b), "dst": pc.if_else(low, b, a), "la": pc.if_else(low, la, lb), "lb": pc.if_else(low, lb, la), "matches": pa.array(found[i, j], pa.int32())}
        return pa.table(out).filter(pc.not_equal(a, b))

    return run


def pairs(records: DataFrame, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs src < dst of a stated set of sequences, with matches over the common prefix and both lengths; with ``least`` only
    those whose matches are at least this share of the common prefix. Null sequences are in no pair.

    Sequences are dealt to blocks by a hash of their ids, and a pair of blocks is a task's work: it holds the two blocks'
    texts and ``SLAB`` letters of each as codes, and only wanted pairs leave it.
    """
    ship(records.sparkSession)
    known = records.where("protein_id is not null and sequence is not null").select("protein_id", "sequence")
    n = -(-known.count() // block)
    dealt = known.withColumn("blocks", F.lit(n)).withColumn("at", F.pmod(F.xxhash64("protein_id"), F.greatest("blocks", F.lit(1))).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select(F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", "protein_id", "sequence")
    kind = dict(known.dtypes)["protein_id"]
    return both.groupBy("x", "y").applyInArrow(_compared(least), f"src {kind}, dst {kind}, la int, lb int, matches int")


def distance(p: DataFrame) -> DataFrame:
    """Mismatches over the common prefix and the difference in length, over the greater length."""
    most, least = F.greatest("la", "lb"), F.least("la", "lb")
    return p.select("src", "dst", F.when(most == 0, 0.0).otherwise((least - F.col("matches") + most - least) / most).alias("distance"))


def identity(p: DataFrame) -> DataFrame:
    """Identity over the common prefix, similarity (matches less mismatches), and the difference in length."""
    least = F.nullif(F.least("la", "lb"), F.lit(0))
    return p.select("src", "dst", F.coalesce(F.col("matches") / least, F.lit(0.0)).alias("identity"), F.coalesce((2 * F.col("matches") - least) / least, F.lit(0.0)).alias("similarity"), F.abs(F.col("la") - F.col("lb")).alias("length_diff"))


def padded(records: DataFrame) -> DataFrame:
    most = records.agg(F.max(F.length("sequence"))).head()[0] or 0
    return records.select("protein_id", F.rpad("sequence", most, "-").alias("aligned"))


def column_counts(alignment: DataFrame) -> DataFrame:
    """(pos, residue, n): summed map-side, so the shuffle carries a row for each place, residue and task."""
    each = alignment.select(F.posexplode(F.split("aligned", "")).alias("pos", "residue"))
    return each.where("residue <> ''").groupBy("pos", "residue").agg(F.count("*").alias("n"))


def conservation(counts: DataFrame) -> DataFrame:
    """Per place: conservation 1 - H / log2(20) without gaps (0 where all are gaps), most common residue and gap share."""
    solid = F.when(F.col("residue") != "-", F.col("n"))
    totals = counts.groupBy("pos").agg(F.sum("n").alias("all"), F.coalesce(F.sum(solid), F.lit(0)).alias("solid"))
    p = F.col("n") / F.col("solid")
    joined = counts.join(totals, "pos")
    entropy = F.sum(F.when(F.col("residue") != "-", -p * F.log2(p)))
    common = F.max(F.when(F.col("residue") != "-", F.struct(F.col("n"), (-F.ascii("residue")).alias("o"), F.col("residue"))))["residue"]
    out = joined.groupBy("pos").agg(entropy.alias("h"), common.alias("common"), F.first("all").alias("n_rows"), F.first("solid").alias("n_solid"))
    return out.select("pos", F.when(F.col("n_solid") > 0, 1 - F.col("h") / F.log2(F.lit(20.0))).otherwise(0.0).alias("conservation"), "common", ((F.col("n_rows") - F.col("n_solid")) / F.col("n_rows")).alias("gap_share"))


def regions(scores: DataFrame, threshold: float) -> DataFrame:
    """Maximal runs of places with at least ``threshold``: start, end (inclusive), greatest score. Places are as many as an
    alignment has columns."""
    high = scores.where(F.col("conservation") >= threshold)
    run = F.col("pos") - F.row_number().over(Window.orderBy("pos"))
    return high.withColumn("run", run).groupBy("run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max("conservation").alias("best")).drop("run")


def elbow(inertia: DataFrame) -> DataFrame:
    """The smallest k whose drop in inertia exceeds the next one's: one row, 2 if there is none."""
    w = Window.orderBy("k")
    drop, nxt = F.lag("inertia").over(w) - F.col("inertia"), F.col("inertia") - F.lead("inertia").over(w)
    return inertia.withColumn("bend", drop > nxt).agg(F.coalesce(F.min(F.when(F.col("bend"), F.col("k"))), F.lit(2)).alias("k"))


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    if len(ids) > G.WHOLE:
        raise ValueError(f"a set of {len(ids)} sequences is too large for one task; the limit is {G.WHOLE}")
    d = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, pdf["src"].to_numpy()), np.searchsorted(ids, pdf["dst"].to_numpy())
    d[i, j] = d[j, i] = pdf["distance"].to_numpy()
    return ids, d


def _inertia(d: np.ndarray, label: np.ndarray) -> float:
    return float(sum((d[np.ix_(label == c, label == c)] ** 2).sum() / 2 for c in np.unique(label)))


def ward_clusters(distances: DataFrame) -> DataFrame:
    """Ward clusters of one stated set from its pair table: id, cluster; as many as the elbow of inertia says."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, d = _square(pdf)
        most = max(1, min(10, len(ids)) - 1)
        labels = [G.ward_from_distances(d, k) for k in range(1, most + 1)]
        inertia = [_inertia(d, x) for x in labels]
        best = next((k for k in range(2, most) if inertia[k - 2] - inertia[k - 1] > inertia[k - 1] - inertia[k]), min(2, most))
        return pd.DataFrame({"id": ids, "cluster": labels[best - 1], "k": best})

    ship(distances.sparkSession)
    return distances.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"id {dict(distances.dtypes)['src']}, cluster int, k int")


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbour joining of a table of pairs (src, dst, distance)."""
    ids, d = _square(pdf)
    names, rows, made = [str(i) for i in ids], [], 0
    while len(names) > 2:
        n = len(names)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        made += 1
        node = f"node_{made}"
        rows += [(names[i], node, li), (names[j], node, d[i, j] - li)]
        keep = [k for k in range(n) if k not in (i, j)]
        new = (d[i, keep] + d[j, keep] - d[i, j]) / 2
        d = np.block([[d[np.ix_(keep, keep)], new[:, None]], [new[None], np.zeros((1, 1))]])
        names = [names[k] for k in keep] + [node]
    if len(names) == 2:
        rows.append((names[0], names[1], d[0, 1]))
    return pd.DataFrame(rows, columns=["child", "parent", "length"])


def neighbour_joining(distances: DataFrame) -> DataFrame:
    """The neighbour-joining tree of one stated set as rows (child, parent, length); leaves are named by their ids."""

    ship(distances.sparkSession)
    return distances.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_joined, "child string, parent string, length double")


def bootstrap_columns(alignment: DataFrame, replicates: int = 100, seed: int = 7) -> DataFrame:
    """(replicate, place, pos): columns drawn with replacement, the same for the same seed."""
    n = alignment.agg(F.max(F.length("aligned"))).head()[0] or 0
    spark = alignment.sparkSession
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / max(1, n)).alias("replicate"), (F.col("id") % max(1, n)).alias("place"))
    return draws.withColumn("pos", F.pmod(F.xxhash64("replicate", "place", F.lit(seed)), F.lit(max(1, n))))


def conservation_statistics(scores: DataFrame) -> DataFrame:
    """One row over all places: mean, std (of the population), min, max, median and the 75th percentile, which is the
    threshold of conserved regions."""
    c = F.col("conservation")
    return scores.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.75)).alias("threshold"))


def _splits(tree: pd.DataFrame, leaves: frozenset) -> dict[str, frozenset]:
    """The leaves below each inner node of a tree (child, parent)."""
    below: dict[str, set] = {}
    for child, parent in list(zip(tree["child"], tree["parent"]))[:-1]:  # children come first; the last edge joins two ends
        below.setdefault(parent, {parent} & leaves).update(below.get(child, {child}))
    return {n: frozenset(s) for n, s in below.items() if n not in leaves}


def bootstrap_support(alignment: DataFrame, replicates: int = 100, seed: int = 7, score: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """The neighbour-joining tree of a stated alignment (child, parent, length) with the support of each child that is an
    inner node: the share of replicate trees, over columns drawn with replacement, that split the leaves as it does.

    Distances are 1 - s(a, b) / max(s(a, a), s(b, b)) for a table ``score`` of residue pairs such as a substitution matrix
    (pairs it does not name count 0), or the share of differing places without one. A replicate is a task's work; each of
    them gets the whole alignment, which is a stated set.
    """
    rows = [(str(r["protein_id"]), r["aligned"]) for r in alignment.orderBy("protein_id").collect()]
    spark, names = alignment.sparkSession, [n for n, _ in rows]
    letters = np.array([list(a) for _, a in rows]) if rows else np.zeros((0, 0), dtype="<U1")

    def distances(cols: np.ndarray) -> pd.DataFrame:
        part, out = letters[:, cols], []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if score is None:
                    d = float((part[i] != part[j]).mean()) if len(cols) else 0.0
                else:
                    s = [sum(score.get((a, b), score.get((b, a), 0.0)) for a, b in zip(part[x], part[y])) for x, y in ((i, j), (i, i), (j, j))]
                    d = 1 - s[0] / max(s[1], s[2]) if max(s[1], s[2]) else 0.0
                out.append((names[i], names[j], d))
        return pd.DataFrame(out, columns=["src", "dst", "distance"])

    leaves, width = frozenset(names), letters.shape[1]
    base = _joined(distances(np.arange(width))) if len(names) > 1 else pd.DataFrame({"child": [], "parent": [], "length": []})
    own = _splits(base, leaves)

    def run(frames):
        for pdf in frames:
            for r in pdf["id"]:
                cols = np.random.default_rng([seed, int(r)]).integers(0, max(1, width), size=width)
                found = set()
                for s in _splits(_joined(distances(cols)), leaves).values():
                    found |= {s, leaves - s}
                hit = [n for n, s in own.items() if s in found]
                yield pd.DataFrame({"child": hit})

    ship(spark)
    tree = spark.createDataFrame([(str(c), str(p), float(n)) for c, p, n in base.itertuples(index=False)], "child string, parent string, length double")
    if not own:
        return tree.withColumn("support", F.lit(None).cast("double"))
    hits = spark.range(0, replicates, 1, min(replicates, 32)).mapInPandas(run, "child string").groupBy("child").agg((F.count("*") / replicates).alias("support"))
    inner = spark.createDataFrame([(n, True) for n in own], "child string, inner boolean")
    out = tree.join(inner, "child", "left").join(hits, "child", "left")
    return out.select("child", "parent", "length", F.when(F.col("inner"), F.coalesce("support", F.lit(0.0))).alias("support"))
