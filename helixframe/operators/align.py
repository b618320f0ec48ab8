"""Multiple alignment around a centre.

Every sequence is aligned with one centre sequence by global dynamic programming, where the sequence is. The gaps that any of
them opens in the centre are the alignment's gaps: per place of the centre the longest insertion counts, a sum that moves one
row for each place and task. Each sequence then writes itself into the common columns.

The centre is the longest sequence, of equals the first by id, unless one is named. A pair of more than ``CELLS`` table cells
is aligned place by place instead. Another aligner is any function from records to (protein_id, aligned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MATCH, MISMATCH, GAP = 2, -1, -2
CELLS = 50_000_000


def pairwise(center: str, seq: str) -> list[str]:
    """What of ``seq`` stands before each place of ``center`` and at it, and behind the last: before_0, at_0, ..., behind."""
    n, m = len(center), len(seq)
    if n * m > CELLS:
        return [x for i in range(n) for x in ("", seq[i : i + 1] or "-")] + [seq[n:]]
    a, b = np.frombuffer(center.encode("utf-32-le"), "<u4"), np.frombuffer(seq.encode("utf-32-le"), "<u4")
    steps = np.arange(m + 1) * GAP
    score = np.empty((n + 1, m + 1), dtype=np.int32)
    score[0] = steps
    for i in range(1, n + 1):
        best = score[i - 1] + GAP
        best[1:] = np.maximum(best[1:], score[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH))
        score[i] = np.maximum.accumulate(best - steps) + steps  # gaps in the centre, all at once
    out = [""] * (2 * n + 1)
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            out[2 * i + 1] = seq[j]
        elif i and score[i, j] == score[i - 1, j] + GAP:
            i -= 1
            out[2 * i + 1] = "-"
        else:
            j -= 1
            out[2 * i] = seq[j] + out[2 * i]
    return out


def center_star(records: DataFrame, center: str | None = None) -> DataFrame:
    """(protein_id, aligned) of records (protein_id, sequence), all of one length; null sequences count as empty."""
    rows = records.select("protein_id", F.coalesce("sequence", F.lit("")).alias("sequence"))
    if center is None:
        first = rows.agg(F.min_by("sequence", F.struct(-F.length("sequence"), "protein_id"))).head()[0]
        center = first or ""
    ship(records.sparkSession)
    kind = dict(rows.dtypes)["protein_id"]

    def inserts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = np.zeros(len(center) + 1, dtype=np.int64)
        for pdf in frames:
            for seq in pdf["sequence"]:
                most = np.maximum(most, [len(x) for x in pairwise(center, seq)[::2]])
        yield pd.DataFrame({"place": np.arange(len(most)), "n": most})

    widths = np.zeros(len(center) + 1, dtype=np.int64)
    for r in rows.mapInPandas(inserts, "place long, n long").groupBy("place").agg(F.max("n").alias("n")).collect():  # a row for each place
        widths[r["place"]] = r["n"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            aligned = []
            for seq in pdf["sequence"]:
                parts = pairwise(center, seq)
                aligned.append("".join(x.ljust(int(widths[i // 2]), "-") if i % 2 == 0 else x for i, x in enumerate(parts)))
            yield pd.DataFrame({"protein_id": pdf["protein_id"], "aligned": aligned})

    return rows.mapInPandas(write, f"protein_id {kind}, aligned string")
