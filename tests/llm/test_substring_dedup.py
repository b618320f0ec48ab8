import hashlib

import helpers
import pytest

from helixframe.llm import substring_dedup as D


def expected(rows, window):
    first = {}
    words = [(d, helpers.WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None and (k not in first or d < first[k]):
                first[k] = d
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("batches, limit", [(1, 1 << 20), (2, 1 << 20), (6, 0)])
def test_against_brute_force(docs, clash, batches, limit):
    rows = helpers.corpus()
    assert any(r[2] for r in expected(rows, 50))
    assert got(D.substring_dedup(clash, batches=batches, broadcast_limit=limit)) == expected(rows, 50)


@pytest.mark.parametrize("window", [8, 9, 20])
def test_small_windows(docs, window):
    assert got(D.substring_dedup(docs, window=window, batches=3)) == expected(helpers.corpus(), window)


def test_repeats_ties_and_nulls(spark):
    same = "la " * 80
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage), (5, passage), (5, passage), (3, same), (4, same + "x"), (9, "q " + passage + " z"), (2, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(D.substring_dedup(df)) == expected(rows, 50)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(150_000))
    rows = [(1, long), (2, " ".join(long.split()[100:400]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in D.substring_dedup(df).collect()}
    assert out == {1: 0, 2: 300}


def test_empty(none):
    assert D.substring_dedup(none).count() == 0


def test_texts_and_compaction(docs):
    out = {r["doc_id"]: r for r in D.remove_repeats(docs, drop_emptied=False).collect()}
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    digest = {r["doc_id"]: r for r in D.substring_dedup(docs).collect()}
    assert set(out) == set(plain)
    for d, r in out.items():
        if digest[d]["n_removed"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest[d]["kept_sha256"]
        else:
            assert r["text"] == plain[d]
    fewer = {r["doc_id"] for r in D.remove_repeats(docs).collect()}
    assert fewer == {d for d, r in out.items() if not (digest[d]["n_removed"] and digest[d]["n_removed"] == digest[d]["n_words"])}


def test_index_compacts(spark, docs):
    index = D.FingerprintIndex(spark, fanout=2)
    lo, hi = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    index.batch(lo, None)
    assert len(index.runs) == 1
    index.batch(hi, lo)
    assert len(index.runs) == 1  # two runs became one
    run = index.history()
    assert run.count() == run.select("a", "c").distinct().count()
    again = index.batch(docs.where("doc_id >= 30"), docs, keep=False)
    assert again.count() > 0


def test_index_is_opened_again(spark, docs, tmp_path):
    """Three batches, each by an index of its own that only knows the path, find what one index finds in one batch."""
    path = f"file://{tmp_path}/index"
    parts = [docs.where("doc_id < 20"), docs.where("doc_id between 20 and 39"), docs.where("doc_id >= 40")]
    found, past = [], None
    for i, part in enumerate(parts):
        index = D.FingerprintIndex(spark, fanout=2, path=path)
        assert len(index.runs) == min(i, 1)
        found += index.batch(part, past).collect()
        assert index.compactions == (i > 0) and len(index.runs) == 1
        past = part if past is None else past.unionByName(part)
    windows = lambda rows: {(r["doc_id"], r["h"], w) for r in rows for w in range(r["s"], r["e"] + 1)}
    whole = D.FingerprintIndex(spark).batch(docs, None).collect()
    assert windows(found) == windows(whole) and whole
    with pytest.raises(ValueError):
        D.FingerprintIndex(spark, window=20, path=path)
    index = D.FingerprintIndex(spark, path=path)
    index.drop()
    assert D.FingerprintIndex(spark, path=path).runs == []


def test_stage_keeps_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = docs
    for name in ("_ranges", "_ranges_", "h", "s", "e", "hs", "spans", "fresh"):
        rows = rows.withColumn(name, F.col("doc_id") * 2)
    out = D.remove_repeats(rows, drop_emptied=False)
    assert out.columns == rows.columns and all(r["_ranges"] == r["_ranges_"] == r["hs"] == 2 * r["doc_id"] for r in out.collect())
