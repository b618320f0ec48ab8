import random

import helpers
import numpy as np
import pytest

from helixframe.llm import ann
from helixframe.llm import decontaminate as D
from helixframe.llm import jaccard_join as J
from helixframe.llm.components import components
from helixframe.llm.runtime import Scratch


def brute(rows, threshold=0.8):
    sets = [(d, helpers.shingle_set(t)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (find(d), links[d]) for d in root}


@pytest.mark.parametrize("block, limit", [(256, 1 << 20), (2, 0)])
def test_join(clash, block, limit):
    want = brute(helpers.corpus())
    assert any(n for _, n in want.values())
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(clash, block=block, broadcast_limit=limit).collect()}
    assert got == want


def test_join_large_group(spark):
    """A group of distinct near copies larger than a block, of which only some pairs are near."""
    rng, words = random.Random(5), helpers.vocabulary(400)
    base = helpers.prose(rng, words, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(df, block=8, recall=0.99999999).collect()}
    assert got == brute(rows)


def test_join_odd_rows(spark, none):
    assert J.jaccard_join(none).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, None), (4, ""), (5, "a"), (6, "a"), (7, "a b")]
    out = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("1", 1, 1), ("1", 1, 1), ("2", 2, 0), ("3", 3, 0), ("4", 4, 0), ("5", 5, 1), ("6", 5, 1), ("7", 7, 0), ("None", None, 0)]


def test_bands_reach_their_recall():
    plans = {}
    for s, r in ((0.8, 0.99), (0.8, 0.9995), (0.6, 0.9), (0.95, 0.999), (1.0, 0.99)):
        b, rows = plans[s, r] = J.plan_bands(s, r)
        assert 1 - (1 - s**rows) ** b >= r - 1e-9 and (b == 1 or r > 1 - (1 - s**rows) ** (b - 1))
    assert plans[0.8, 0.9995] == (15, 4) and plans[0.95, 0.999][1] > plans[0.6, 0.9][1]


def test_words_of_any_length_are_told_apart(spark):
    """Two words that a polynomial modulo 2**64 cannot tell apart, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    out = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_links"] for r in out] == [0, 0]


def test_one_of_each_group(spark):
    """Rows that share an id are judged by their texts."""
    rows = [(3, "a b c"), (5, "d e f"), (5, "a b c"), (7, "d e f"), (7, "d e f"), (9, "x y"), (9, "x y"), (None, "a b c"), (8, None), (8, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as key", "text as class_id", "1 as d", "2 as x")
    for limit in (1 << 20, 0):
        out = J.one_of_each(df, broadcast_limit=limit)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(3, "a b c"), (5, "d e f"), (9, "x y"), (None, "a b c"), (8, None), (8, ""), (2, None)], key=str)
    assert J.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("order", ["ascending", "random"])
def test_components_of_long_paths(spark, order):
    ids = list(range(5_000))
    if order == "random":
        random.Random(4).shuffle(ids)
    work = Scratch(spark, "t")
    work.table, rounds = (lambda df, name, table=work.table: rounds.append(name) or table(df, name)), []
    out = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), work)
    assert out.where("label = 0").count() == 5_000
    assert sum(n.startswith("edges") for n in rounds) <= 20


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert D.fewest_edits(item, text) == sellers(item, text)


@pytest.fixture(scope="module")
def leaks():
    rng, words = random.Random(6), helpers.vocabulary(500, 9)
    items = [(i, helpers.prose(rng, words, rng.randint(15, 50))) for i in range(12)] + [(20, None), (21, " "), (22, "tiny item"), (23, "qq")]
    docs, want = [], set()
    for d in range(120):
        text = helpers.prose(rng, words, rng.randint(0, 80))
        if d % 4 == 0:
            i, item = items[d // 4 % 12]
            s = list(item.upper() if d % 8 else item)
            for _ in range(int(len(s) * 0.08 * (d % 3))):
                s[rng.randrange(len(s))] = rng.choice("abcxyz")
            text += "  " + "".join(s) + "\n" + helpers.prose(rng, words, 10)
            want.add((d, i))
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "a tiny item here"), (203, "qq")]
    want |= {(202, 22), (203, 23)}
    return items, docs, want


def test_contamination(spark, leaks):
    items, docs, want = leaks
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'x' as edits")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as similarity")
    for block in (1 << 20, 200):  # one block of items, and several
        got = D.contamination(df, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    text, item = dict(docs), dict(items)
    for r in got:
        assert r["edits"] == sellers(D.normalise(item[r["item_id"]]), D.normalise(text[r["doc_id"]])) <= 0.2 * len(D.normalise(item[r["item_id"]]))
    clean = D.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_contamination_of_empty_tables(spark, leaks):
    items, docs, _ = leaks
    no_items = spark.createDataFrame([], "item_id long, text string")
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert D.contamination(df, no_items).count() == 0 and D.decontaminate(df, no_items).count() == len(docs)
    assert D.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def scattered(rng, text, edits, letters):
    s = list(text)
    for _ in range(edits):
        i, c = rng.randrange(len(s)), rng.choice(letters)
        s[i : i + 1] = rng.choice([[], [c], [s[i], c]])
    return "".join(s)


@pytest.mark.parametrize("least, most", [(24, 40), (40, 60), (81, 120), (121, 180), (250, 400)])
def test_contamination_recall_by_length(least, most):
    """At 20 % edits, against the edit search over the whole text."""
    rng, words = random.Random(least), helpers.vocabulary(500, 9)
    items = [D.normalise(helpers.prose(rng, words, 120))[: rng.randint(least, most)].strip() for _ in range(100)]
    index = D.ItemIndex(list(enumerate(items)), 0.2, 0.99)
    docs, want = [], set()
    for i in [*range(100)] * 3:
        t = items[i]
        text = D.normalise(helpers.prose(rng, words, 12) + " " + scattered(rng, t, int(0.2 * len(t)), "abcdefghijkl mnopqrstuvwxyz") + " " + helpers.prose(rng, words, 12))
        if D.fewest_edits(t, text) <= 0.2 * len(t):
            want.add((len(docs), i))
        docs.append(text)
    got = {(d, h[0]) for d, found in enumerate(index.hits(docs)) for h in found}
    assert len(want) > 290 and len(want & got) >= 0.98 * len(want)


@pytest.mark.parametrize("script", ["han", "cyrillic", "thai"])
def test_contamination_recall_in_other_scripts(script):
    """At 20 % edits in texts of two and three bytes a character, with blanks and without."""
    rng = random.Random(script)
    letters = {"han": [chr(c) for c in range(0x4E00, 0x4E00 + 900)], "cyrillic": [chr(c) for c in range(0x430, 0x450)], "thai": [chr(c) for c in range(0x0E01, 0x0E2F)]}[script]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    text = lambda n: (" " if script == "cyrillic" else "").join(word() for _ in range(n))
    items = [D.normalise(text(80))[: rng.choice([10, 25, 60, 120, 200])].strip() for _ in range(60)]
    index = D.ItemIndex(list(enumerate(items)), 0.2, 0.99)
    docs = [D.normalise(text(20) + scattered(rng, t, int(0.2 * len(t)), letters) + text(20)) for t in items]
    want = {(i, i) for i, t in enumerate(items) if D.fewest_edits(t, docs[i]) <= 0.2 * len(t)}
    got = {(d, h[0]) for d, found in enumerate(index.hits(docs)) for h in found}
    assert len(want) > 55 and len(want & got) >= 0.98 * len(want)


def test_contamination_of_repeated_rows_and_long_texts(spark):
    rng, words = random.Random(8), helpers.vocabulary(500, 9)
    item, other = helpers.prose(rng, words, 30), helpers.prose(rng, words, 30)
    long = helpers.prose(rng, words, 60_000)
    docs = spark.createDataFrame([(1, item), (1, item), (1, "nothing"), (2, long), (3, long[:200_000] + item + long[200_000:]), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, other), (None, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in D.contamination(docs, bench).collect())
    assert got == sorted((d, i, 0) for d in ("1", "1", "3", "None") for i in ("7", "7", "None"))
    assert sorted((r["doc_id"], len(r["text"])) for r in D.decontaminate(docs, bench).collect()) == [(1, 7), (2, len(long))]


def test_items_of_one_id_have_limits_of_their_own(spark):
    rng, words = random.Random(21), helpers.vocabulary(500, 9)
    long, short = (D.normalise(helpers.prose(rng, words, n))[:m].strip() for n, m in ((80, 209), (40, 83)))
    texts = {}
    for doc, item, edits in ((1, long, 26), (2, short, 10), (3, short, 17 + 8)):
        s = list(item)
        for i in np.random.default_rng(doc).choice(len(s), edits, replace=False):
            s[i] = "#"
        texts[doc] = helpers.prose(rng, words, 10) + " " + "".join(s) + " " + helpers.prose(rng, words, 10)
    docs = spark.createDataFrame([*texts.items(), (4, "clean")], "doc_id long, text string")
    for ids in ((1, 2), (1, 1), (None, None)):
        for items in ((long, short), (short, long)):
            bench = spark.createDataFrame(list(zip(ids, items)), "item_id long, text string")
            for block in (1 << 20, 1):
                got = sorted((r["doc_id"], r["edits"]) for r in D.contamination(docs, bench, block_chars=block).collect())
                assert got == [(1, 26), (2, 10)]
                assert sorted(r["doc_id"] for r in D.decontaminate(docs, bench, block_chars=block).collect()) == [3, 4]


def test_contamination_finds_exact_copies_anywhere():
    """Behind punctuation, glued to letters and inside unspaced text."""
    rng, words = random.Random(12), helpers.vocabulary(500, 9)
    han, thai = [chr(c) for c in range(0x4E00, 0x5200)], [chr(c) for c in range(0x0E01, 0x0E2F)]
    unspaced = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items, texts = [], []
    for n in (4, 10, 20, 40, 50, 80):
        for letters in (han, thai):
            items.append(unspaced(letters, n))
            texts.append(unspaced(letters, 30) + items[-1] + unspaced(letters, 30))
    for n in (3, 12, 30, 48, 50, 53, 90, 150):
        for before, after in (("question:", ""), ("xq", "qx"), ('("', '")'), ("\u201c", "\u201d"), ("7", "7")):
            items.append(D.normalise(helpers.prose(rng, words, 60))[:n].strip())
            texts.append(helpers.prose(rng, words, 5) + " " + before + items[-1] + after + " " + helpers.prose(rng, words, 5))
    items.append("https://" + unspaced("abcdefgh", 60))
    texts.append("see" + items[-1] + "there")
    found = D.ItemIndex(list(enumerate(items)), 0.2, 0.99).hits([D.normalise(t) for t in texts])
    assert [i for i in range(len(items)) if (i, 0, 1.0) not in found[i]] == []


def vectors(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:120] = v[50]  # a common vector
    return v


def nearest(v, q, k=10, ids=None):
    ids = np.arange(len(v)) if ids is None else ids
    x = v.astype(np.float64)
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q]
    return [(int(ids[i]), d[i]) for i in order[:k]]


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_nearest(spark, shard_rows):
    v = vectors()
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, rank int")
    index = ann.VectorIndex(rows, shard_rows=shard_rows)
    out = {}
    for r in index.search(index.rows.where("vec_id % 10 = 0"), 10, block=16).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(out) == list(range(0, 400, 10))
    hits = 0
    for q, got in out.items():
        got.sort()
        want = nearest(v, q)
        assert [g[0] for g in got] == list(range(1, 11))
        hits += len({g[1] for g in got} & {w[0] for w in want})
        for _, i, s in got:
            assert s == pytest.approx(np.sqrt(((v[i].astype(float) - v[q].astype(float)) ** 2).sum()), abs=1e-12)
    assert hits / 400 >= 0.97
    assert [g[1] for g in sorted(out[60])] == [50, 51, 52, 53, 54, 55, 56, 57, 58, 59]  # ties to the smaller id


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (7, []), (None, [1.0, 1.0]), (200, [nan, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).collect())
    assert out == [(0, 1, 100), (100, 1, 0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
