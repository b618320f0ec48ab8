import re

import pytest
from pyspark.sql import functions as F

from helixframe.functions import constants as K
from helixframe.functions import sequence as S

S1 = "MKTAYIAKQRQISFVKSHFSRQDILDLWIYHTQGYFPQ"
S2 = "MKTVRQERLKSIVRILERSKEPVSGAQLAEELSVSRQVIVQDIAYLRSLGYNIVATPRGYVLAGG"


@pytest.fixture(scope="module")
def row(spark):
    def get(value, **cols):
        df = spark.createDataFrame([(value,)], "s string")
        return df.select(*(c(F.col("s")).alias(n) for n, c in cols.items())).head()

    return get


def test_properties(row):
    for seq, mw, charge, gravy, pi, ext, inst, ali in ((S1, 5313.4, 0.16, -0.487, 4.9, 9970, 0.53, 26.32), (S2, 8367.5, 0.38, -0.052, 6.5, 4470, 0.92, 40.0)):
        r = row(seq, mw=S.molecular_weight, charge=S.net_charge, gravy=S.gravy, pi=S.isoelectric_point, ext=S.extinction, inst=S.instability, ali=S.aliphatic_index)
        assert r["mw"] == pytest.approx(mw, abs=0.006)
        assert r["charge"] == pytest.approx(charge, abs=0.006)
        assert r["gravy"] == pytest.approx(gravy, abs=0.0006)
        assert r["pi"] == pytest.approx(pi, abs=1e-9)
        assert r["ext"] == ext
        assert r["inst"] == pytest.approx(inst, abs=0.006)
        assert r["ali"] == pytest.approx(ali, abs=0.006)


def test_structure_and_counts(row):
    r = row(S1, st=S.structure, mc=S.most_common, nd=S.distinct_residues)
    assert (r["st"]["helix"], r["st"]["sheet"], r["st"]["turn"], r["st"]["dominant"], r["st"]["score"]) == (34.2, 35.0, 30.8, "sheet", 1.05)
    assert r["mc"] == "Q" and r["nd"] == 17
    assert row("MK", st=S.structure)["st"]["coil"] == 100.0
    groups = row(S1, **{g: lambda c, g=g: S.group_count(c, g) for g in K.GROUPS}).asDict()
    assert [groups[g] for g in ("hydrophobic", "hydrophilic", "charged", "polar", "aromatic", "aliphatic", "sulfur_containing", "basic", "acidic", "small", "large")] == [15, 22, 9, 13, 7, 10, 1, 7, 2, 8, 14]


@pytest.mark.parametrize("seq", [S1, S2, "", "LAAAAAALAAAAAALAA", "AALAAAAAALAAAAAALAALAAAAAALXLAAAAAALAAAAAAL", "CCACC", "PPP"])
def test_motif_spans_are_those_of_re(row, seq):
    got = row(seq, **{m: lambda c, m=m: S.motif_spans(c, m) for m in K.MOTIFS}).asDict()
    for name, (_, pattern) in K.MOTIFS.items():
        want = [(m.start(), m.end(), m.group(), f"{m.start() + 1}-{m.end()}") for m in re.finditer(pattern, seq)]
        assert [tuple(x) for x in got[name]] == want, name


def test_dipeptides():
    """The rows of the table that tell all classes apart, residues in alphabetical order."""
    rows = {
        "A": [1, 0, -1, -1, 1, 0, -1, 1, -1, 1, 1, -1, 0, -1, -1, 0, 0, 1, 1, 1],
        "C": [0, 1, -1, -1, 1, 0, -1, 1, -1, 1, 1, -1, 0, -1, -1, 0, 0, 1, 1, 1],
        "D": [-1, -1, 1, 1, -1, -1, 1, -1, 1, -1, -1, 1, -1, 1, 1, -1, -1, -1, -1, -1],
        "G": [0, 0, -1, -1, 1, 0, -1, 1, -1, 1, 1, -1, 0, -1, -1, 0, 0, 1, 1, 1],
    }
    for a, weights in rows.items():
        assert [K.DIPEPTIDES[a + b] for b in "ACDEFGHIKLMNPQRSTVWY"] == weights
    assert len(K.DIPEPTIDES) == 400 and all(K.DIPEPTIDES[a + b] == K.DIPEPTIDES[b + a] for a in K.ALPHABET for b in K.ALPHABET)


def test_dipeptide_sums(row):
    every = "".join(K.DIPEPTIDES)
    for seq in (S1, S2, "CCC", "AAAA", "A", "", every):
        assert row(seq, d=S.dipeptide_sum)["d"] == sum(K.DIPEPTIDES[a + b] for a, b in zip(seq, seq[1:]))


def test_predicates_and_names(row):
    assert row("MK", v=S.is_valid)["v"] and row("mk", v=S.is_valid)["v"]
    for bad in ("", "MB", "M K", None):
        assert row(bad, v=S.is_valid)["v"] is False
    assert [row(x, v=S.is_uniprot_id)["v"] for x in ("P12345", "P1234", "A0A0A0A0A0", "p12345", "1ABCDE", None)] == [True, True, True, False, False, False]
    assert [row(x, v=S.is_workspace_ref)["v"] for x in ("1/2", " 1 / -2", "1/2/3", "a/2", None)] == [True, True, False, False, False]
    assert [row(x, v=S.file_safe)["v"] for x in ("G protein-coupled/receptor", "__a--b__", "***", None)] == ["G_protein_coupled_receptor", "a_b", "unknown_family", "unknown_family"]
    assert row("a b/c~d*", v=S.quote)["v"] == "a%20b/c~d%2A"
    assert row("  ", v=S.wrap)["v"] == "N/A"
    assert row("aaa bbb ccc", v=lambda c: S.wrap(c, 7))["v"] == "aaa bbb<br>ccc"
    links = row("P1 2", v=S.database_links)["v"]
    assert len(links) == 73 and links["uniprot"].endswith("/P1%202") and links["signalp"].endswith("SignalP-5.0")


def test_spans_of_many_matches_take_linear_time(spark):
    """Twice the matches of one long sequence do not take four times as long: an array is not copied for each of them."""
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([("SA" * n,), (None,), ("",), ("ASAS",)], "seq string").coalesce(1)
        began = time.perf_counter()
        got = df.select(F.explode(S.motif_spans(F.col("seq"), "o_glycosylation")).alias("s")).select("s.*").agg(F.count("*"), F.max("end"), F.sum(F.col("end").cast("long"))).head()
        took.append(time.perf_counter() - began)
        assert tuple(got) == (n + 1, 2 * n, n * (n + 1) + 3)
    assert took[1] < 8
