"""Report data for display, and a plain HTML page of it."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import search as Q
from ..operators import stats as T

#: Ranges of scores, from the lower end on; the last holds its upper end too.
SCORES = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


def display_score(score: Column) -> Column:
    return F.round(score, 3)


def chart_scale(score: Column, factor: float = 120.0, most: float = 95.0) -> Column:
    """A score as a bar height, cut at ``most``."""
    return F.least(F.lit(most), score * factor)


def edge_ratios(sizes: DataFrame) -> DataFrame:
    """Edges for each node and average degree, guarded against empty graphs."""
    n = F.greatest(F.col("n_nodes"), F.lit(1))
    return sizes.select("graph", (F.col("n_edges") / n).alias("edges_per_node"), (2 * F.col("n_edges") / n).alias("avg_degree"))


def summary_rows(table: DataFrame) -> DataFrame:
    """Display rows of a dashboard table."""
    return table.select("protein_id", "family", display_score(F.col("confidence")).alias("confidence"), "n_similar", display_score(F.col("best_similarity")).alias("best_similarity"))


def summary(table: DataFrame) -> DataFrame:
    """One row of a dashboard with lengths: proteins, families, and the means of length, confidence, similar proteins and size of
    the family's network. Means of nothing are null."""
    known = F.when(F.col("family") != "Unknown", F.col("family"))
    means = (("length", "avg_length"), ("confidence", "avg_confidence"), ("n_similar", "avg_similar"), ("n_nodes", "avg_network_size"))
    return table.agg(F.count("*").alias("proteins"), F.countDistinct(known).alias("families"), *(F.avg(c).alias(n) for c, n in means))


def distributions(table: DataFrame, matches: DataFrame) -> DataFrame:
    """(kind, range, n): how many proteins of a dashboard have each family, confidence and length, and how many matches each
    similarity. Ranges without any have a row of 0; null values are in none."""
    spark = table.sparkSession

    def scores(values: DataFrame, col: str, kind: str) -> DataFrame:
        named = F.element_at(F.array(*map(F.lit, SCORES)), F.col("bin") + 1)
        return Q.histogram(values, col, len(SCORES)).select(F.lit(kind).alias("kind"), named.alias("range"), "n")

    families = table.groupBy("family").agg(F.count("*").alias("n")).select(F.lit("family").alias("kind"), F.col("family").alias("range"), "n")
    lengths = T.length_histogram(table.where("length is not null"), "length")
    every = spark.createDataFrame([(x,) for x in T.LENGTHS], "bin string")
    lengths = every.join(lengths, "bin", "left").select(F.lit("length").alias("kind"), F.col("bin").alias("range"), F.coalesce("n", F.lit(0)).alias("n"))
    return families.unionByName(scores(table, "confidence", "confidence")).unionByName(lengths).unionByName(scores(matches, "similarity", "similarity"))


def network_summary(sizes: DataFrame) -> DataFrame:
    """One row of graphs (n_nodes, n_edges, density): how many there are, how many have edges, and the mean of each size."""
    return sizes.agg(F.count("*").alias("networks"), F.count_if(F.col("n_edges") > 0).alias("with_edges"), *(F.avg(c).alias(f"avg_{n}") for c, n in (("n_nodes", "nodes"), ("n_edges", "edges"), ("density", "density"))))


def alignment_summary(alignment: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: aligned proteins, places of the alignment, their mean conservation and mean share of gaps."""
    none = F.lit(None).cast("double")
    rows = alignment.select(F.lit(True).alias("row"), none.alias("conservation"), none.alias("gap_share"))
    both = rows.unionByName(scores.select(F.lit(False).alias("row"), "conservation", "gap_share"))
    return both.agg(F.count_if("row").alias("proteins"), F.count_if(~F.col("row")).alias("places"), F.avg("conservation").alias("avg_conservation"), F.avg("gap_share").alias("avg_gap_share"))


def _table(df: DataFrame, order: list[str], rows: int) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.orderBy(*order).limit(rows).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def page(title: str, sections: dict[str, tuple[DataFrame, list[str]]], rows: int = 20) -> str:
    """One page with the first ``rows`` rows of each section in its order; a report, so the limit is its feature."""
    parts = "".join(f"<section><h2>{escape(name)}</h2>{_table(df, order, rows)}</section>" for name, (df, order) in sections.items())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{parts}</body></html>'


#: Sections of a full page: table, title, columns shown, order, and what is said where the table is missing or empty.
SECTIONS = (
    ("summary", "Summary", ("proteins", "families", "avg_length", "avg_confidence", "avg_similar", "avg_network_size"), ("proteins",)),
    ("dashboard", "Proteins", ("protein_id", "length", "family", "confidence", "n_similar", "best_similarity"), ("protein_id",)),
    ("analyses", "Sequence analysis", ("protein_id", "length", "molecular_weight", "isoelectric_point", "instability_index", "aliphatic_index", "extinction"), ("protein_id",)),
    ("matches", "Similar proteins", ("query_id", "protein_id", "similarity", "rank"), ("query_id", "rank")),
    ("distributions", "Distributions", ("kind", "range", "n"), ("kind", "range")),
    ("network_summary", "Network figures", ("networks", "with_edges", "avg_nodes", "avg_edges", "avg_density"), ("networks",)),
    ("network_stats", "Networks", ("graph", "n_nodes", "n_edges", "density", "avg_degree"), ("graph",)),
    ("alignment_summary", "Alignment", ("proteins", "places", "avg_conservation", "avg_gap_share"), ("places",)),
    ("identities", "Pairs", ("src", "dst", "identity", "similarity", "length_diff"), ("src", "dst")),
    ("regions", "Conserved regions", ("start", "end", "best"), ("start",)),
    ("links", "Databases", ("protein_id", "database", "url"), ("protein_id", "database")),
)


def section(title: str, table: DataFrame | None, columns: tuple[str, ...], order: tuple[str, ...], rows: int = 20) -> str:
    """One section: the first ``rows`` rows of the columns that the table has, numbers with three decimals."""
    body = f"<p>{escape(title)} not available.</p>"
    if table is not None:
        kinds = dict(table.dtypes)
        shown = [F.format_number(c, 3).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns if c in kinds]
        first = table.orderBy(*order).limit(rows).select(*shown)
        if not first.isEmpty():
            body = _table(first, [c for c in order if c in kinds], rows)
    return f"<section><h2>{escape(title)}</h2>{body}</section>"


def full_page(title: str, tables: dict[str, object], rows: int = 20) -> str:
    """A page of every section; those whose table a run does not have say so."""
    known = {n: t for n, t in tables.items() if isinstance(t, DataFrame)}
    parts = "".join(section(name, known.get(table), columns, order, rows) for table, name, columns, order in SECTIONS)
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{parts}</body></html>'
