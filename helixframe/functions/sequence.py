"""Column expressions over protein sequences. All are JVM-side; lengths and counts come from ``replace`` and regular
expressions, so long sequences are never exploded."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def from_text(text: Column) -> Column:
    """The residues of a text: its letters in upper case, without those that name no residue."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.regexp_replace(letters, f"[^{K.ALPHABET}]", "")


def clean(seq: Column) -> Column:
    return F.upper(F.trim(seq))


def is_valid(seq: Column) -> Column:
    """Non-empty, residues only, at most ``MAX_LENGTH`` long; null is not valid."""
    ok = F.upper(seq).rlike(f"^[{K.ALPHABET}]+$") & F.length(seq).between(1, K.MAX_LENGTH)
    return F.coalesce(ok, F.lit(False))


def is_uniprot_id(col: Column) -> Column:
    return F.coalesce(col.rlike("^[A-Z]([0-9A-Z]{4}|[0-9A-Z]{5}|[0-9A-Z]{9})$"), F.lit(False))


def is_workspace_ref(col: Column) -> Column:
    """Two integers around one slash; signs and blanks around them are allowed."""
    return F.coalesce(col.rlike(r"^\s*[+-]?\d+\s*/\s*[+-]?\d+\s*$"), F.lit(False))


def count_of(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def counts(seq: Column, residues: str = K.AMINO_ACIDS) -> dict[str, Column]:
    return {r: count_of(seq, r) for r in residues}


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def group_count(seq: Column, group: str) -> Column:
    """Residues of a named group."""
    return F.length(seq) - F.length(F.regexp_replace(seq, f"[{K.GROUPS[group]}]", ""))


def weighted(seq: Column, place: int, residues: str = K.AMINO_ACIDS) -> Column:
    """Sum over residues of a property, by its place in the table of residues."""
    return _sum(count_of(seq, r) * F.lit(K.RESIDUES[r][place]) for r in residues)


def molecular_weight(seq: Column) -> Column:
    return weighted(seq, 1)


def gravy(seq: Column) -> Column:
    """Mean hydropathy; null for an empty sequence."""
    return weighted(seq, 2) / F.nullif(F.length(seq), F.lit(0))


def net_charge(seq: Column, ph: float = 7.0) -> Column:
    """Residues with a pKa below ``ph`` count as acids, those above as bases."""

    def part(r: str) -> Column:
        pka = K.RESIDUES[r][3]
        sign = -1.0 if pka < ph else 1.0
        return count_of(seq, r) * F.lit(sign / (1 + 10 ** abs(ph - pka)))

    return _sum(part(r) for r in K.AMINO_ACIDS if K.RESIDUES[r][3] != ph)


def isoelectric_point(seq: Column) -> Column:
    """The pH of a grid of tenths from 3.0 to 11.9 with the charge nearest to zero, the first of equals."""
    acids, bases = "DE", "KRH"
    power = lambda x: F.pow(F.lit(10.0), x)

    def charge(i: Column, n: Column) -> Column:
        ph = F.lit(3.0) + i * F.lit(0.1)
        ends = F.lit(1.0) / (1 + power(ph - K.N_TERMINUS)) - F.lit(1.0) / (1 + power(K.C_TERMINUS - ph))
        side = _sum(n[r] / (1 + power(ph - K.RESIDUES[r][3])) for r in acids) - _sum(n[r] / (1 + power(K.RESIDUES[r][3] - ph)) for r in bases)
        return F.abs(ends + side)

    # the counts are bound once a row, not once a grid point
    one = F.array(F.struct(*(c.alias(r) for r, c in counts(seq, acids + bases).items())))
    best = F.transform(one, lambda n: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: F.struct(charge(i, n).alias("c"), i.alias("i"))))["i"])
    return F.lit(3.0) + best[0] * F.lit(0.1)


def extinction(seq: Column) -> Column:
    return _sum(count_of(seq, r) * F.lit(e) for r, e in K.EXTINCTION.items())


def dipeptide_sum(seq: Column) -> Column:
    """Sum of the weights of all neighbouring pairs of residues, by overlapping matches of pair classes."""
    p, s = K.DIPEPTIDE_POLAR, K.DIPEPTIDE_SMALL
    hits = lambda pattern: F.regexp_count(seq, F.lit(pattern))
    pairs = F.greatest(F.length(seq) - 1, F.lit(0))
    mixed = hits(f"(?=[{p}][^{p}])") + hits(f"(?=[^{p}][{p}])")
    still = hits(f"(?=[{s}][{s}])") - _sum(hits(f"(?={pair})") for pair in K.DIPEPTIDE_WHOLE)
    return pairs - 2 * mixed - still


def instability(seq: Column) -> Column:
    return F.when(F.length(seq) < 2, 0.0).otherwise(F.lit(10.0) / F.length(seq) * dipeptide_sum(seq))


def aliphatic_index(seq: Column) -> Column:
    return F.lit(100.0) * group_count(seq, "aliphatic") / F.nullif(F.length(seq), F.lit(0))


def percent_of(seq: Column, residue: str) -> Column:
    """Share of a residue in percent; 0 for an empty sequence."""
    return F.lit(100.0) * count_of(seq, residue) / F.greatest(F.length(seq), F.lit(1))


def most_common(seq: Column) -> Column:
    """The most frequent residue, the first seen of equals."""
    each = F.array(*(F.struct(count_of(seq, r).alias("n"), (-F.instr(seq, r)).alias("at"), F.lit(r).alias("r")) for r in K.AMINO_ACIDS))
    return F.when(F.length(seq) > 0, F.array_max(each)["r"])


def distinct_residues(seq: Column) -> Column:
    return _sum(F.when(F.instr(seq, r) > 0, 1).otherwise(0) for r in K.AMINO_ACIDS)


def structure(seq: Column) -> Column:
    """Struct of helix, sheet and turn percentages, coil, dominant state and its score; short sequences are all coil."""
    n = F.nullif(F.length(seq), F.lit(0))
    h, s, t = (weighted(seq, i) / n for i in (4, 5, 6))
    total = h + s + t
    pct = [F.bround(100 * x / total, 1) for x in (h, s, t)]
    rest = F.greatest(F.lit(0.0), 100 - (pct[0] + pct[1] + pct[2]))
    best = F.when((h >= s) & (h >= t), "helix").when(s >= t, "sheet").otherwise("turn")
    full = F.struct(pct[0].alias("helix"), pct[1].alias("sheet"), pct[2].alias("turn"), rest.alias("coil"), best.alias("dominant"), F.bround(F.greatest(h, s, t), 3).alias("score"))
    zero = F.lit(0.0)
    short = F.struct(zero.alias("helix"), zero.alias("sheet"), zero.alias("turn"), F.lit(100.0).alias("coil"), F.lit("coil").alias("dominant"), zero.alias("score"))
    return F.when(F.length(seq) < 3, short).otherwise(full)


def structure_class(mw: Column, instability_index: Column, pi: Column) -> Column:
    return F.when(mw < 10000, "small").when(instability_index < 40, "stable").when(pi < 6, "acidic").when(pi > 8, "basic").otherwise("neutral")


_ZIPPER = "L.{6}L.{6}L"


def _zipper(seq: Column, plain: Column, other: Column, none: Column) -> Column:
    """The leucine zipper's pattern swallows all residues up to its last hit, so a sequence of residues has one match or
    none; matching it as written would try every start of what is left. Other characters need the pattern itself."""
    return F.when(~seq.rlike(_ZIPPER), none).when(seq.rlike(f"^[{K.ALPHABET}]+$"), plain).otherwise(other)


def motif_matches(seq: Column, motif: str) -> Column:
    """All non-overlapping matches of a motif, left to right."""
    found = F.regexp_extract_all(seq, F.lit(K.MOTIFS[motif][1]), F.lit(0))
    if motif == "leucine_zipper":
        return _zipper(seq, F.array(F.regexp_extract(seq, f"^.*{_ZIPPER}", 0)), found, F.array().cast("array<string>"))
    return found


def motif_count(seq: Column, motif: str) -> Column:
    return F.size(motif_matches(seq, motif))


def _running():
    """Running sums of arrays. An aggregation that appends to an array copies it for each element, so that takes Arrow."""

    def run(x: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        each = sums[1:] - np.repeat(sums[cuts[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(each.astype(np.int32)), mask=x.is_null())

    return F.arrow_udf(run, "array<int>")


def motif_spans(seq: Column, motif: str) -> Column:
    """Array of (start, end, sequence, position): start from 0, end exclusive, position as "first-last" from 1."""
    found = motif_matches(seq, motif)
    gaps = F.split(seq, K.MOTIFS[motif][1], -1)
    if motif == "leucine_zipper":
        gaps = _zipper(seq, F.array(F.lit(""), F.regexp_replace(seq, f"^.*{_ZIPPER}", "")), gaps, F.array(seq))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
    span = lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("sequence"), F.concat_ws("-", end - F.length(h) + 1, end).alias("position"))
    return F.zip_with(_running()(steps), found, span)


def quote(col: Column) -> Column:
    """Percent-encoding that leaves slashes and tildes and writes a blank as %20."""
    out = F.url_encode(col)
    for have, want in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def database_links(protein_id: Column) -> Column:
    """Map of link target to address."""
    quoted = quote(protein_id)
    parts = []
    for name, (_, by_id, base) in K.DATABASES.items():
        parts += [F.lit(name), F.concat(F.lit(base), quoted) if by_id else F.lit(base)]
    return F.create_map(*parts)


def file_safe(col: Column) -> Column:
    """Letters, digits and single underscores only; ``unknown_family`` where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(col, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown_family"))


def wrap(col: Column, width: int = 80) -> Column:
    """Words in lines of at most ``width`` characters joined by ``<br>``; longer words stand alone; blank gives ``N/A``."""
    words = F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")
    step = lambda acc, w: F.when(acc["n"].isNull(), F.struct(w.alias("out"), F.length(w).alias("n"))).otherwise(
        F.when(acc["n"] + 1 + F.length(w) <= width, F.struct(F.concat(acc["out"], F.lit(" "), w).alias("out"), (acc["n"] + 1 + F.length(w)).alias("n"))).otherwise(
            F.struct(F.concat(acc["out"], F.lit("<br>"), w).alias("out"), F.length(w).alias("n"))
        )
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("n"))
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", "N/A").otherwise(F.aggregate(words, zero, step)["out"])


def summary_text(seq: Column, protein_id: Column) -> Column:
    """A report of a few lines on one sequence."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Protein: "), protein_id),
        F.format_string("Length: %d", F.length(seq)),
        F.format_string("Molecular weight: %.2f", molecular_weight(seq)),
        F.format_string("Isoelectric point: %.2f", isoelectric_point(seq)),
        F.format_string("GRAVY: %.3f", gravy(seq)),
        F.format_string("Dominant structure: %s", structure(seq)["dominant"]),
    )
