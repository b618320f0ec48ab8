import hashlib
import random
import zlib

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import chat as C
from helixframe.llm import language_id as L
from helixframe.llm import quality as Q

TEXT = {
    "aa": ["the", "of", "and", "ing", "tion", "er", "th", "st"],
    "bb": ["der", "die", "und", "ung", "sch", "keit", "ein", "ß"],
    "cc": ["que", "los", "ción", "ñ", "el", "as", "osa", "rr"],
}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(TEXT))
        words = ["".join(rng.choice(TEXT[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(words), lang if i % 10 else None, lang))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(["", None, "123 !!", "  ", "9" * 5000])]
    return rows, spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def test_language(languages):
    rows, df = languages
    out = {r["doc_id"]: r for r in L.language_id(df).collect()}
    assert len(out) == len(rows)
    right = 0
    for d, text, _, lang in rows:
        r = out[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if lang is None:
            assert (r["lang_pred"], r["score"]) == (L.UND, 0.0)
        elif r["held_out"]:
            right += r["lang_pred"] == lang
    held = sum(1 for r in rows if r[3] and out[r[0]]["held_out"])
    assert right / held > 0.98


def test_language_ties_repeats_and_long_texts(spark):
    """Two languages with equal profiles tie, the first by name is taken; equal rows get equal results; long texts count whole."""
    rows = [(i, "ab ba " * 20, "pp" if i % 2 else "qq") for i in range(20)] + [(30, "ab ba " * 200_000, None), (30, "ab ba " * 200_000, None), (31, "ab ba " * 20, None)]
    out = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "doc_id").collect()
    assert {r["lang_pred"] for r in out} == {"pp"} and len(out) == 23
    assert len({(r["lang_pred"], round(r["score"], 12)) for r in out if r["doc_id"] == 30}) == 1


def test_held_out_rows_teach_nothing(languages):
    _, df = languages
    wrong = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a = {r["doc_id"]: tuple(r) for r in L.language_id(df).collect()}
    assert {r["doc_id"]: tuple(r) for r in L.language_id(wrong).collect()} == a


def test_profiles_by_brute_force(languages):
    rows, df = languages
    profiles = L.learn(df, top=50)
    counts = {}
    for _, text, lang, _ in rows:
        if lang and L.has_letter(text):
            data = L.words_of(text)
            for n in (1, 2, 3):
                for i in range(len(data) - n + 1):
                    g = data[i : i + n]
                    if g.strip() and b" " not in g[1:-1] and g != b"  ":
                        counts.setdefault(lang, {}).setdefault((n, g), 0)
                        counts[lang][n, g] += 1
    code = lambda n, g: (n << 24) | int.from_bytes(g, "big")
    for i, lang in enumerate(profiles.languages):
        want = [code(*k) for k, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], code(*x[0])))][:50]
        rank = profiles.rank[i]
        assert [int(profiles.codes[j]) for j in np.argsort(np.where(rank[:-1] < 0, 10**6, rank[:-1]), kind="stable")[: len(want)]] == want


def test_language_of_nothing(spark, none):
    assert L.language_id(none).count() == 0
    df = spark.createDataFrame([(1, "abc", None), (None, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.language_id(df).collect()} == {L.UND}


def test_keep_known(languages):
    rows, df = languages
    out = L.keep_known(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in rows if r[3]}


@pytest.fixture(scope="module")
def rated(spark):
    rng, words = random.Random(2), helpers.vocabulary(400)
    docs, labels = [], []
    for i in range(900):
        text = helpers.prose(rng, words, rng.randint(40, 120)).split()
        toxic, low = rng.random() < 0.2, rng.random() < 0.25
        if low:
            text = [w + rng.choice(["###", "%%%", "$$$"]) for w in text]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Vilest,", "odious", "scum."]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: 0 if t else 1 + q for d, q, t in labels}


def test_quality_held_out(rated):
    docs, labels, truth = rated
    model = Q.learn(docs, labels.where("doc_id < 600"))
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in Q.score(docs, model).collect() if r["doc_id"] >= 600}
    right = sum(r["selected"] == (truth[d] == 2) for d, r in out.items())
    assert right / len(out) > 0.95
    mean = [np.mean([r["expected_grade"] for d, r in out.items() if truth[d] == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]
    for r in out.values():
        assert 0 <= r["tail_prob"] <= 1 and r["tail_prob"] <= r["expected_grade"] <= 2


def test_cumulative_link_by_brute_force():
    """On one feature the fit is the best of a fine grid."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 400)
    z = 1.5 * x + rng.logistic(size=400)
    grades = (z > 0.2).astype(int) + (z > 1.4)
    model = Q.CumulativeLink.fit([np.array([7], dtype=np.int32) if v else np.zeros(0, dtype=np.int32) for v in x], grades, least_docs=1, l2=0, steps=3000)

    def loss(w, t1, t2):
        c = 1 / (1 + np.exp(np.array([t1, t2])[None] - w * x[:, None]))
        p = np.column_stack([1 - c[:, 0], c[:, 0] - c[:, 1], c[:, 1]])
        return -np.log(p[np.arange(400), grades]).sum()

    own = loss(model.weights[7], *model.thresholds)
    best = min(loss(w, a, a + g) for w in np.linspace(0.5, 2.5, 21) for a in np.linspace(-0.6, 1, 17) for g in np.linspace(0.6, 1.8, 13))
    assert own <= best + 0.05


def test_quality_odd_rows(spark, none, rated):
    docs, labels, _ = rated
    model = Q.learn(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "y " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as grade", "'x' as tail_prob")
    out = Q.score(odd, model).collect()
    assert len(out) == 4 and sorted(r["tail_prob"] for r in out)[:2] == [0.0, 0.0]
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["selected"] for r in Q.quality(docs, no_labels).collect()} == {True}
    assert Q.quality(none, no_labels).count() == 0
    bad = spark.createDataFrame([(1, None, 0), (2, 0, None), (None, 1, 1), (3, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = bad.select("doc_id", Q.grade(F.col("quality"), F.col("toxic")).alias("g")).where("g is not null and doc_id is not null").groupBy("doc_id").agg(F.min("g").alias("g")).collect()
    assert [(r["doc_id"], r["g"]) for r in got] == [(3, 0)]


def test_quality_sample(spark, rated):
    """Labels of unknown documents take no part, and the sample ends at its bytes."""
    docs, labels, _ = rated
    strangers = labels.selectExpr("doc_id + 100000 as doc_id", "1 - quality as quality", "toxic")
    own = Q.learn(docs, labels, sample=300)
    assert np.array_equal(Q.learn(docs, labels.unionByName(strangers), sample=300).weights, own.weights)
    few = Q.learn(docs, labels, sample=300, sample_bytes=20_000)
    assert not np.array_equal(few.weights, own.weights)


PIECE = st.sampled_from([*C.CONTROLS, "\\", "\\\\", "<", "[", "/", "s>", "a", " ", "\n", "é", "🙂", ""])
BODY = st.lists(PIECE, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), BODY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, BODY), max_size=6))
def test_grammar_round_trip(turns):
    text = "".join(C.render_turn(r, t) for r, t in turns)
    assert C.parse(text) == turns


def test_plain_turns_stay_plain():
    assert C.render_turn("user", r"a \n b") == r"[INST]a \n b[/INST]"
    assert C.render_turn("assistant", "x</s>") == r"<s>x\</s></s>"
    for bad in ("x", "<s>a", "[INST]a</s>", "<s>a</s>b"):
        with pytest.raises(C.GrammarError):
            C.parse(bad)


def test_chats(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "hi", "</s>[INST] ok [/INST]", "a\\", "\\<s>", "x" * 3000])) for c in [*range(20), None] for t in range(rng.randint(1, 30))]
    rows += [(3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "assistant", "tie"), (4, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    out = {r["conv_id"]: r for r in C.read_chats(C.format_chats(df)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    assert len(out) == 21
    for c in out:
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        said = "".join(t for r, t in mine if r == "assistant")
        r = out[c]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] == len("".join(C.render_turn(*m) for m in mine))
    assert C.read_chats(C.format_chats(df.limit(0))).count() == 0


def test_loss_masks(spark):
    """The mask alone says what is trained on, in place in the formatted text."""
    long = "<s>long\\" * 100_000
    rows = [(1, 0, "user", "<s>a</s>"), (1, 1, "assistant", "b</s>\\"), (1, 2, "assistant", None), (1, 3, "assistant", long), (1, 4, "tool", "c")]
    shown = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    learned = [C.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in shown]
    assert learned == ["", "b</s>\\", "", long, ""]
    assert shown[1]["formatted"][shown[1]["loss_end"] :] == "</s>"
