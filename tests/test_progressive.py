"""Profile alignment against brute force, and alignments along a guide tree."""

import os
import random
from functools import lru_cache

import numpy as np
import pytest

from helixframe.operators import align as L
from helixframe.operators import progressive as P
from helixframe.plans import sequence_queries

SF = "/root/testdata/sf0.001"


def profile(rows):
    letters = "ACDE"
    return np.array([[sum(r[i] == x for r in rows) / len(rows) for x in letters] for i in range(len(rows[0]))]).reshape(len(rows[0]), 4)


def column_score(p, q):
    met = sum(x * y * (P.MATCH if i == j else P.MISMATCH) for i, x in enumerate(p) for j, y in enumerate(q))
    return met + P.GAP * (sum(p) * (1 - sum(q)) + sum(q) * (1 - sum(p)))


def best_score(a, b):
    """Affine gaps by three recurrences; a gap may follow one of the other side."""

    @lru_cache(None)
    def f(i, j, state):
        if i < 0 or j < 0:
            return -1e18
        if i == j == 0:
            return 0.0 if state == "m" else -1e18
        if state == "m":
            return max(f(i - 1, j - 1, s) for s in "mxy") + column_score(a[i - 1], b[j - 1]) if i and j else -1e18
        if not (i if state == "x" else j):
            return -1e18
        back, lone = ((i - 1, j), a[i - 1]) if state == "x" else ((i, j - 1), b[j - 1])
        return max(f(*back, s) - (s != state) * P.OPEN for s in "mxy") + P.GAP * sum(lone)

    return max(f(len(a), len(b), s) for s in "mxy")


def score(a, b, left, right):
    total, last = 0.0, "m"
    for i, j in zip(left, right):
        state = "m" if i >= 0 and j >= 0 else "x" if j < 0 else "y"
        total += column_score(a[i], b[j]) if state == "m" else P.GAP * sum(a[i] if state == "x" else b[j]) - (state != last) * P.OPEN
        last = state
    return total


def test_profile_alignments_are_best():
    rng = random.Random(1)
    for _ in range(150):
        rows = [["".join(rng.choice("ACDE-" if k else "ACDE") for _ in range(n)) for k in range(rng.randint(1, 3))] for n in (rng.randint(0, 7), rng.randint(0, 7))]
        a, b = (profile(r) if r[0] else np.zeros((0, 4)) for r in rows)
        left, right = P.align_profiles(a, b)
        assert [i for i in left if i >= 0] == list(range(len(a))) and [j for j in right if j >= 0] == list(range(len(b)))
        assert not ((left < 0) & (right < 0)).any()
        assert score(a, b, left.tolist(), right.tolist()) == pytest.approx(best_score(tuple(map(tuple, a)), tuple(map(tuple, b))))


def test_large_tables_are_laid_side_by_side(monkeypatch):
    monkeypatch.setattr(P, "CELLS", 5)
    left, right = P.align_profiles(np.ones((3, 1)), np.ones((2, 1)))
    assert left.tolist() == [0, 1, 2] and right.tolist() == [0, 1, -1]


def test_progressive(spark):
    rows = [(1, "MKTAYIAKQRQISFVK"), (2, "MKTYIAKQRQISFVK"), (3, "MKTAYWWIAKQRQISFVK"), (4, "TAYIAKQRQ"), (5, ""), (6, None), (1, "MKTAYIAKQRQISFV")]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "protein_id long, sequence string, n string").repartition(3)
    out = [(r["protein_id"], r["aligned"]) for r in P.progressive(df).collect()]
    assert len({len(a) for _, a in out}) == 1
    assert sorted((i, a.replace("-", "")) for i, a in out) == sorted((i, s or "") for i, s in rows)
    assert sorted(map(tuple, P.progressive(df.repartition(1)).collect())) == sorted(out)
    full = dict(o for o in out if o[0] in (2, 3, 4))
    assert full[3].strip("-") == "MKTAYWWIAKQRQISFVK" and full[4].strip("-") in ("TAY--IAKQRQ",)
    sets = spark.createDataFrame([("a", 1, "MKTA"), ("a", 2, "MTA"), ("b", 1, "QQQQQQ"), ("c", 1, None)], "family_id string, protein_id long, sequence string")
    got = {(r["family_id"], r["protein_id"]): r["aligned"] for r in P.progressive(sets).collect()}
    assert got == {("a", 1): "MKTA", ("a", 2): "M-TA", ("b", 1): "QQQQQQ", ("c", 1): ""}
    assert P.progressive(df.limit(0)).count() == 0


def test_sum_of_pairs(spark):
    aligned = spark.createDataFrame([(1, "AC-"), (2, "AD-"), (3, "A-E")], "protein_id long, aligned string")
    assert P.sum_of_pairs(aligned).head()["score"] == 3 * 2 + (-1 - 2 * 2) + -2 * 2
    assert P.sum_of_pairs(aligned.limit(0)).head()["score"] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_no_worse_than_the_star(spark):
    records = sequence_queries.bench(spark, SF)
    both = [P.sum_of_pairs(f(records)).head()["score"] for f in (P.progressive, L.center_star)]
    assert both[0] >= both[1]
