"""Every registered query against its SQL on the smallest tables."""

import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from helixframe import registry
from helixframe.functions import constants as K
from helixframe.plans import sequence_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    def show(v):
        if np.ndim(v) == 0 and pd.isna(v):
            return "NULL"
        return str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.12g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert plain(got) == plain(con.execute(sql).df())


def test_motif_matches(spark, tmp_path):
    """All 24 motifs, against re.finditer."""
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("acdefghiklmnpqrstvwyCKRGSTLP ") for _ in range(n))) for i, n in enumerate((0, 40, 400, 3000))]
    hits = "lxxxxxxlxxxxxxlxxxxxxl".replace("x", "a")
    docs += [(9, hits + " " + hits), (10, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["motif_matches"](spark, f"file://{tmp_path}").collect()}
    want = set()
    for r in sequence_queries.seqs(spark, f"file://{tmp_path}").collect():
        for m, (_, pattern) in K.MOTIFS.items():
            want |= {(r["protein_id"], m, x.start(), x.end(), x.group(), f"{x.start() + 1}-{x.end()}") for x in re.finditer(pattern, r["seq"] or "")}
    assert got == want and len({w[1] for w in want}) > 12


def test_stated_searches_answer_every_hundredth_row(spark):
    want = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    for name in ("search_all_families", "search_global_threshold"):
        assert {r["query_id"] for r in registry.queries()[name](spark, SF).collect()} == want


def test_wrapped_texts_and_reports_are_those_of_all_documents(spark):
    def wrapped(text):
        lines = []
        for w in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
            if lines and len(lines[-1]) + 1 + len(w) <= 80:
                lines[-1] += " " + w
            else:
                lines.append(w)
        return "<br>".join(lines) or "N/A"

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert max(len(t or "") for t in docs.values()) > 10_000
    assert {r["doc_id"]: r["wrapped"] for r in registry.queries()["wrap_text"](spark, SF).collect()} == {d: wrapped(t) for d, t in docs.items()}
    length = {r["protein_id"]: len(r["seq"] or "") for r in sequence_queries.seqs(spark, SF).collect()}
    report = {r["protein_id"]: r["report"] for r in registry.queries()["sequence_report"](spark, SF).collect()}
    assert report.keys() == docs.keys() and all(str(length[d]) in report[d].replace(",", "") for d in docs if length[d])


def test_statistics_of_texts_without_residues(spark, tmp_path):
    """Null, empty and residue-free texts, as the SQL has them."""
    docs = [(1, None), (2, ""), (3, "12 34"), (4, "AAKK"), (5, "kkaa"), (6, "中文"), (7, "xzv")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(registry.queries()["seq_statistics"](spark, f"file://{tmp_path}").toPandas()) == plain(c.execute(registry.oracle_sql()["seq_statistics"]).df())


#: Queries whose rows come of one search, with the shuffles by the query that its rows and what follows them may take.
SEARCHES = {
    "knn_edges": 1,
    "knn_hybrid": 1,
    "robust_edges": 1,
    "similarity_table": 1,
    "top_matches": 1,
    "matches_listed": 1,
    "search_stats": 1,
    "search_status_totals": 2,  # one is of the families assigned
    "graph_degree": 1,
    "graph_trim_query": 1,
}


def planned(spark, name):
    of = registry.queries()[name](spark, SF)._jdf.queryExecution()
    return of.optimizedPlan().toString(), of.executedPlan().toString()


@pytest.mark.parametrize("name", list(SEARCHES))
def test_rows_of_a_search_move_and_are_sorted_once(spark, name):
    logical, physical = planned(spark, name)
    assert logical.count("FlatMapCoGroupsInArrow") <= 1 and physical.count("WindowGroupLimit") <= 1
    assert len(re.findall(r"Exchange hashpartitioning\(query_id", physical)) <= SEARCHES[name]


def test_neighbours_of_a_node_are_not_sorted_again(spark):
    assert len(re.findall(r"Sort \[", planned(spark, "robust_edges")[1])) <= 3  # two sides of blocks, and the ranks


#: Queries of which matches are ranked where they are found, so that no window goes over them.
RANKED = ["similarity_table", "search_stats", "top_matches", "knn_hybrid", "search_status_totals"]


@pytest.mark.parametrize("name", RANKED)
def test_matches_are_ranked_where_they_are_found(spark, name):
    assert "Window" not in planned(spark, name)[1]


@pytest.mark.parametrize("name", ["search_stats", "top_matches", "knn_hybrid"])
def test_vectors_of_a_search_are_moved_as_they_are_stored(spark, name):
    assert "lambda" not in planned(spark, name)[1]


def test_best_matches_overall_are_not_shuffled(spark):
    assert "Exchange hashpartitioning(query_id" not in planned(spark, "top_matches")[1]
