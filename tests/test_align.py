import random

import pytest

from helixframe.operators import align as L
from helixframe.sources import records as R


def best_score(a, b):
    row = [j * L.GAP for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * L.GAP]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (L.MATCH if x == y else L.MISMATCH), row[j] + L.GAP, new[-1] + L.GAP))
        row = new
    return row[-1]


def test_pairwise_alignments_are_best():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 14))) for _ in range(2))
        parts = L.pairwise(a, b)
        assert "".join(parts).replace("-", "") == b
        score = sum(len(x) * L.GAP for x in parts[::2]) + sum(L.GAP if y == "-" else L.MATCH if x == y else L.MISMATCH for x, y in zip(a, parts[1::2]))
        assert score == best_score(a, b)


def test_center_star(spark):
    rows = [(1, "MKTAYIAKQR"), (2, "MKTYIAKQR"), (3, "MKTAYWWIAKQR"), (4, "TAYIAK"), (5, ""), (6, None)]
    out = {r["protein_id"]: r["aligned"] for r in L.center_star(spark.createDataFrame(rows, "protein_id long, sequence string").repartition(3)).collect()}
    assert len({len(a) for a in out.values()}) == 1
    assert {i: a.replace("-", "") for i, a in out.items()} == {i: s or "" for i, s in rows}
    assert out[1] == "MKTAY--IAKQR" and out[4] == "--TAY--IAK--"
    assert L.center_star(spark.createDataFrame([], "protein_id long, sequence string")).count() == 0


def test_fetched_records(spark):
    pages = {"http://x/P1.fasta": ">sp|P1|NAME a protein\nMK\nTA\n", "http://x/f": ">a one\nMK\n>b\nTT\n"}

    def get(url, timeout):
        return pages[url]

    ids = spark.createDataFrame([("P1",), ("P2",)], "protein_id string")
    assert [(r["protein_id"], r["sequence"]) for r in R.fetch_uniprot(ids, "http://x/", get=get).collect()] == [("P1", "MKTA")]
    assert sorted((r["protein_id"], r["sequence"]) for r in R.read_fasta_url(spark, "http://x/f", get=get).collect()) == [("a", "MK"), ("b", "TT")]
    with pytest.raises(KeyError):
        R.read_fasta_url(spark, "http://x/none", get=get)
    tries = []
    with pytest.raises(OSError):
        R.fetch_object(lambda ref: tries.append(ref) or (_ for _ in ()).throw(OSError()), "1/2", wait=0)
    assert len(tries) == 3
