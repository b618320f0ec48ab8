import random

import helpers
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng, words = random.Random(3), helpers.vocabulary(500, 9)
    items = [(i, helpers.prose(rng, words, 30)) for i in range(5)]
    rows = helpers.corpus(80) + [(500, items[2][1], "xx", "s1", 1), (501, "start " + items[3][1].lower() + " end", "xx", "s2", 1)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows


def test_stages(spark, folder):
    sf, rows = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    for before, after in zip(seen[:4], seen[1:5]):
        assert after.columns == before.columns and [t for _, t in after.dtypes] == [t for _, t in before.dtypes]
    ids = [{r["doc_id"] for r in df.collect()} for df in seen]
    text = {d: t for d, t, *_ in rows}
    assert ids[1] == {d for d, t in text.items() if t and any(c.isalpha() for c in t)}
    near = {}
    for d in sorted(ids[1]):
        near.setdefault(helpers.shingle_set(text[d]), d)
    assert ids[2] <= set(near.values()) and len(ids[2]) < len(ids[1])
    assert ids[3] <= ids[2] and ids[4] == ids[3] - {500, 501}
    passages = [r["text"] for r in seen[3].collect()]
    windows = [tuple(w[i : i + 50]) for w in (p.split() for p in passages) for i in range(len(w) - 49)]
    assert len(passages) > 10 and len(set(windows)) >= 0.99 * len(windows)
    assert {r["doc_id"] for r in seen[5].collect()} == ids[4]


def test_language_stage_uses_its_prediction(spark):
    rng, words = random.Random(3), helpers.vocabulary(500, 9)
    rows = [(i, helpers.prose(rng, words, rng.randint(3, 60)), "xx") for i in range(60)]
    odd = [(100, "\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a\u6587", None), (101, "\u0431\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0438\u0446\u0430", None), (102, "1234", None), (103, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(60))
    assert corpus_pipeline.known_language(spark, docs.limit(0), "").count() == 0


def test_stages_meet_odd_rows(spark, folder):
    """Repeated ids, ties, nulls, a very long text and columns of clashing names pass every stage."""
    sf, _ = folder
    rng, words = random.Random(9), helpers.vocabulary(500, 9)
    text, long = helpers.prose(rng, words, 80), helpers.prose(rng, words, 30_000)
    other = helpers.prose(rng, words, 90)
    rows = [(1, text, "xx", "s", 1), (1, text, "xx", "s", 1), (2, text, None, None, None), (2, other, "xx", "s", 2), (None, other, "xx", "s", 3), (3, None, None, None, None), (4, "", "xx", "s", 0), (5, long, "xx", "s", 5)]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    for name in ("key", "class_id", "_ranges", "score", "item_id", "size", "part"):
        docs = docs.selectExpr("*", f"doc_id as `{name}`")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    assert all(df.columns == docs.columns for df in seen[:5])
    kept = lambda i: sorted(((r["doc_id"], len(r["text"] or "")) for r in seen[i].collect()), key=str)
    assert kept(1) == sorted([(1, len(text)), (1, len(text)), (2, len(text)), (2, len(other)), (None, len(other)), (5, len(long))], key=str)
    assert kept(2) == sorted([(1, len(text)), (2, len(other)), (None, len(other)), (5, len(long))], key=str)
    assert kept(4) == kept(3) == kept(2)
    assert seen[5].agg({"length": "sum"}).head()[0] > 30_000


def test_run_is_the_stages_in_order(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)
