"""Multiple alignment along a guide tree, by profiles.

Clusters of sequences begin as single sequences. In each round every cluster looks for the one whose counts of ``k``-residue
runs are most alike (``blocks.top``); clusters that choose each other are aligned and become one, many pairs at a time. The
most similar pair of all always chooses each other, so every round has one, and the merges are those of a guide tree with
average vectors.

Two clusters meet as profiles, the share of each residue in each column: global dynamic programming over the expected score
of a pair of their members, equal residues ``MATCH``, others ``MISMATCH``, a residue and a gap ``GAP``, with affine gaps: one
that is opened costs ``OPEN`` more. A task holds two profiles and their table, never a cluster's sequences. What it
gives, for each side the places of its columns in the common ones, is then applied to the members where they are.

Records may come in several sets (``family_id``), which are aligned side by side.

Cases: null sequences are empty ones, and empty ones are gaps only; of equal ids each row is aligned; a pair of profiles with
more than ``CELLS`` table cells is laid side by side from its first columns on; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship
from . import blocks

MATCH, MISMATCH, GAP, OPEN = 2.0, -1.0, -2.0, 1.0
#: Cells of a table, length of the runs that sequences are compared by, and places of their counts.
CELLS, RUN, PLACES = 20_000_000, 2, 64


def run_counts(sequence: str, k: int = RUN, places: int = PLACES) -> list[float]:
    """How many of a sequence's runs fall to each place; never all 0, so that empty sequences have a neighbour too."""
    codes = np.frombuffer(sequence.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out = np.full(places, 1e-3)
    if len(codes) >= k:
        h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(1_000_003) + codes[j : j + len(h)]
        h ^= h >> np.uint64(15)
        out += np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % places, minlength=places)
    return out.tolist()


def align_profiles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two profiles (columns x letters, shares of residues) the column of each side at each common place, or -1."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        at = np.arange(max(n, m))
        return np.where(at < n, at, -1), np.where(at < m, at, -1)
    full_a, full_b = a.sum(axis=1), b.sum(axis=1)
    met = np.outer(full_a, full_b)
    pair = (MATCH - MISMATCH) * (a @ b.T) + MISMATCH * met + GAP * (full_a[:, None] + full_b[None, :] - 2 * met)
    ramp, columns = np.concatenate([[0.0], np.cumsum(-GAP * full_b)]), np.arange(m + 1, dtype=np.int32)
    top = np.zeros((n + 1, m + 1), dtype=np.int32)  # the row in which a gap in b that ends here was opened, or -1
    side = np.full((n + 1, m + 1), -1, dtype=np.int32)  # the column in which a gap in a was opened, or -1
    best = -OPEN - ramp
    best[0] = 0
    top[0] = -1
    side[0, 1:] = 0
    down, opened = np.full(m + 1, -1e18), np.zeros(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        opened = np.where(best - OPEN > down, i - 1, opened).astype(np.int32)
        down = np.maximum(best - OPEN, down) + GAP * full_a[i - 1]
        here, top[i] = down.copy(), opened
        if m:
            step = best[:-1] + pair[i - 1]
            fits = step >= down[1:]
            here[1:][fits] = step[fits]
            top[i, 1:][fits] = -1
            # a gap in a may have been opened at any earlier place of the row
            value = here + ramp
            most = np.maximum.accumulate(value)
            first = np.maximum.accumulate(np.where(value == most, columns, 0))
            across = most[:-1] - OPEN - ramp[1:]
            more = across > here[1:]
            here[1:][more] = across[more]
            side[i, 1:][more] = first[:-1][more]
        best = here
    left, right, i, j, fresh = [], [], n, m, True
    while i or j:
        if fresh and side[i, j] >= 0:
            left += [-1] * (j - side[i, j])
            right += range(j - 1, side[i, j] - 1, -1)
            j, fresh = int(side[i, j]), False
        elif top[i, j] >= 0:
            left += range(i - 1, top[i, j] - 1, -1)
            right += [-1] * (i - top[i, j])
            i, fresh = int(top[i, j]), True
        else:
            i, j, fresh = i - 1, j - 1, True
            left.append(i)
            right.append(j)
    return np.array(left[::-1], dtype=np.int64), np.array(right[::-1], dtype=np.int64)


def _spread(profile: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), profile.shape[1]))
    out[at >= 0] = profile[at[at >= 0]]
    return out


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            letters = sorted({*r.letters, *r.letters_b})
            sides = []
            for own, flat in ((r.letters, r.profile), (r.letters_b, r.profile_b)):
                p = np.asarray(flat, dtype=np.float64).reshape(-1, max(1, len(own)))
                wide = np.zeros((len(p) if len(own) else 0, len(letters)))
                if len(own):
                    wide[:, np.searchsorted(letters, list(own))] = p
                sides.append(wide)
            n, m = r.n, r.n_b
            left, right = align_profiles(*sides)
            both = (_spread(sides[0], left) * n + _spread(sides[1], right) * m) / (n + m)
            v = (np.asarray(r.v) * n + np.asarray(r.v_b) * m) / (n + m)
            rows.append((r.family_id, r.protein_id, r.other, n + m, "".join(letters), both.ravel(), v, left.astype(np.int32), right.astype(np.int32)))
        yield pd.DataFrame(rows, columns=["family_id", "protein_id", "other", "n", "letters", "profile", "v", "left", "right"])


def _single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for family, row, seq in zip(pdf["family_id"], pdf["protein_id"], pdf["sequence"]):
            letters = sorted(set(seq))
            p = np.zeros((len(seq), len(letters)))
            p[np.arange(len(seq)), np.searchsorted(letters, list(seq)) if letters else []] = 1
            rows.append((family, row, 1, "".join(letters), p.ravel(), run_counts(seq)))
        yield pd.DataFrame(rows, columns=["family_id", "protein_id", "n", "letters", "profile", "v"])


def _place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for text, at in zip(pdf["aligned"], pdf["at"]):
            out.append(text if at is None else "".join([text[i] if i >= 0 else "-" for i in at]))
        yield pdf.drop(columns="at").assign(aligned=out)


def progressive(records: DataFrame) -> DataFrame:
    """(protein_id, aligned) of records (protein_id, sequence), or (family_id, protein_id, aligned) if they have a family_id;
    all of a set's rows have one length."""
    spark = records.sparkSession
    ship(spark)
    work = Scratch(spark, "progressive")
    grouped = "family_id" in records.columns
    set_ = F.col("family_id") if grouped else F.lit(0)
    rows = records.select(set_.alias("family_id"), F.col("protein_id").alias("id"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.monotonically_increasing_id().alias("protein_id"))
    rows = work.table(rows, "rows")
    kind = rows.schema["family_id"].dataType.simpleString()
    cluster = f"family_id {kind}, protein_id long, n long, letters string, profile array<double>, v array<double>"
    now = work.table(rows.select("family_id", "protein_id", "sequence").mapInPandas(_single, cluster), "clusters-0")
    members = rows.select("family_id", "id", "protein_id", F.col("sequence").alias("aligned"))
    member = members.schema
    n = 0
    while True:
        asked = now.select(F.col("protein_id").alias("query_id"), "family_id", F.col("v").alias("q"))
        near = work.table(blocks.top(asked, now.select("protein_id", "family_id", "v"), 1, exclude_self=True).select("query_id", "protein_id"), f"near-{n}")
        back = near.select(F.col("protein_id").alias("query_id"), F.col("query_id").alias("protein_id"))
        pairs = near.join(back, ["query_id", "protein_id"]).where("query_id < protein_id").select(F.col("query_id").alias("protein_id"), F.col("protein_id").alias("other"))
        if near.isEmpty():
            break
        n += 1
        other = now.select(F.col("protein_id").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("n", "letters", "profile", "v")))
        merged = now.join(pairs, "protein_id").join(other, "other").repartition("protein_id")
        made = work.table(merged.mapInPandas(_merge, f"family_id {kind}, protein_id long, other long, n long, letters string, profile array<double>, v array<double>, left array<int>, right array<int>"), f"merged-{n}")
        used = made.select(F.explode(F.array("protein_id", "other")).alias("protein_id"))
        now = work.table(now.join(used, "protein_id", "left_anti").unionByName(made.select("family_id", "protein_id", "n", "letters", "profile", "v")), f"clusters-{n}")
        steps = made.select(F.col("protein_id").alias("to"), F.explode(F.array(F.struct("protein_id", F.col("left").alias("at")), F.struct(F.col("other").alias("protein_id"), F.col("right").alias("at")))).alias("s")).select("s.protein_id", "s.at", "to")
        moved = members.join(steps, "protein_id", "left").select("family_id", "id", F.coalesce("to", "protein_id").alias("protein_id"), "aligned", "at")
        members = work.table(moved.mapInPandas(_place, member), f"members-{n}")
        for name in (f"clusters-{n - 1}", f"merged-{n - 1}", f"members-{n - 1}", f"near-{n - 1}"):
            work.drop(name)
    return members.select(*(["family_id"] if grouped else []), F.col("id").alias("protein_id"), "aligned")


def sum_of_pairs(alignment: DataFrame) -> DataFrame:
    """One row: the linear sum-of-pairs score of an alignment, from the counts of each column: pairs of equal residues count
    ``MATCH``, of different ones ``MISMATCH``, of a residue and a gap ``GAP``, of gaps 0."""
    each = alignment.select(F.posexplode(F.split("aligned", "")).alias("pos", "residue")).where("residue <> ''")
    counts = each.groupBy("pos", "residue").agg(F.count("*").alias("n"))
    n, solid = F.col("n"), F.col("residue") != "-"
    columns = counts.groupBy("pos").agg(F.sum(F.when(solid, n * (n - 1) / 2).otherwise(0)).alias("same"), F.sum(F.when(solid, n).otherwise(0)).alias("all"), F.sum(F.when(solid, 0).otherwise(n)).alias("gaps"))
    met = F.col("all") * (F.col("all") - 1) / 2
    return columns.agg(F.coalesce(F.sum(MATCH * F.col("same") + MISMATCH * (met - F.col("same")) + GAP * F.col("all") * F.col("gaps")), F.lit(0.0)).alias("score"))
