import random
import zlib

import helpers
import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import huffman as H
from helixframe.llm import packing as P
from helixframe.llm import token_binary as B
from helixframe.llm import token_counts as C
from helixframe.llm.queries import tokenizer_path
from helixframe.llm.tokens import stream

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "B", "'s", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "\r\n", "é", "é", "ß", "Σ", "ΑΣ", "12", "!", "...", "don't", "<|endoftext|>", "<|", " ", "　", "中文", "\x1c", "\0", "🙂", "İ", "﻿", "ﬁ", "foo.", "Bar,", "##"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_stream_gives_the_librarys_ids(path):
    rng, library, own = random.Random(4), Tokenizer.from_file(path), stream(path)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 10))) for _ in range(4000)] + [t or "" for t in helpers.ODD] + [t or "" for _, t, *_ in helpers.corpus()]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.ids_packed(t), dtype=own.dtype).tolist() == want, repr(t)
        assert own.count(t) == len(want)
    assert own.ids_packed(None) == b""


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_piece_table_is_bounded(monkeypatch, path):
    from helixframe.llm import tokens

    monkeypatch.setattr(tokens, "PIECES", 40)
    monkeypatch.setattr(tokens, "BLOCK", 60)
    own, library, words = tokens.TokenStream(path), Tokenizer.from_file(path), helpers.vocabulary(300)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(50)]
    for _ in range(2):
        for t, ids in zip(texts, own.ids_batch(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.table.n <= 40 + 21  # and what one block adds


def test_equal_hashes_are_told_apart(monkeypatch):
    from helixframe.llm import tokens

    plain = tokens._Hashes.of
    monkeypatch.setattr(tokens._Hashes, "of", lambda self, *a: (lambda f, s: (f % np.uint64(7) + np.uint64(1), s))(*plain(self, *a)))
    own, library = tokens.TokenStream(BYTES), Tokenizer.from_file(BYTES)
    text = " ".join(helpers.vocabulary(60)) + " " + "long" * 40
    for _ in range(2):
        assert own.ids_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(clash, none):
    library = Tokenizer.from_file(WORDS)
    for limit in (2048, 20):
        want = {d: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > limit) for d, t, *_ in helpers.corpus()}
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.token_counts(clash, WORDS, limit).collect()} == want
    assert C.token_counts(none, WORDS).count() == 0


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = C.DigestCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([(1, "a b"), (2, "a  b"), (None, "a b"), (None, None), (3, "c")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in C.token_counts(rows, WORDS, cache=cache).collect()) == [0, 1, 2, 2, 2]
    assert cache.read().count() == 3  # white space does not tell texts apart for this tokenizer
    marked = cache.read().selectExpr("content", "tokenizer", "n_tokens + 100 as n_tokens").collect()
    other = C.DigestCache(spark, f"file://{tmp_path}/other")
    other.append(spark.createDataFrame(marked, C.CACHE_SCHEMA))
    assert sorted(r["n_tokens"] for r in C.token_counts(rows, WORDS, cache=other).collect()) == [100, 101, 102, 102, 102]
    C.token_counts(rows, BYTES, cache=C.DigestCache(spark, other.path)).collect()  # opened again
    assert other.read().select("tokenizer").distinct().count() == 2


def test_equal_rows_are_encoded_once(spark, tmp_path):
    cache = C.DigestCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([(1, "a b")] * 3 + [(2, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in C.token_counts(rows, WORDS, cache=cache).collect()) == [1, 1, 2, 2, 2, 2]
    assert spark.read.parquet(cache.path).count() == 2


def test_long_texts(spark):
    """A text of 300,000 words is counted, coded and packed whole."""
    text = " ".join(f"word{i % 977}" for i in range(300_000))
    rows = spark.createDataFrame([(1, text, "s"), (2, "short", "s")], "doc_id long, text string, source string")
    for path, run in ((WORDS, lambda: C.token_counts(rows, WORDS)), (BYTES, lambda: B.write_tokens(rows, BYTES, 2).read())):
        n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
        assert {r["doc_id"]: r["n_tokens"] for r in run().collect()}[1] == n + (path == BYTES)
    check_pieces([(1, text), (2, "short")], P.pack(rows, WORDS, 2).collect(), 4096)


@pytest.mark.parametrize("n, most", [(1, 17), (2, 17), (3, 17), (300, 9), (5000, 17)])
def test_huffman(n, most):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.7, n) * 10 + 1).astype(np.int64)
    lengths = H.code_lengths(counts, most)
    assert lengths.max() <= most and sum(2.0 ** -lengths.astype(float)) <= 1 + 1e-12
    codes, table = H.canonical_codes(lengths), H.decoding_table(lengths)
    parts = [rng.choice(n, size=k, p=counts / counts.sum()) for k in (1, 7, 100, 2500)]
    for part, coded in zip(parts, H.encode_many(parts, codes, lengths, 100)):
        bits, at = H.encode(part, codes, lengths)
        assert coded[8 : 8 + len(bits)] == bits
        marks = np.concatenate([[0], np.frombuffer(coded, "<u8", offset=8 + len(bits)).astype(np.int64)])
        each = np.full(len(marks), 100)
        each[-1] = len(part) - 100 * (len(marks) - 1)
        assert (H.decode(np.frombuffer(bits, np.uint8), marks, each, table) == part).all()
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(9), 3)


def test_token_files(clash, none, tmp_path, spark):
    library, start, want = Tokenizer.from_file(BYTES), 0, {}
    for d, t, *_ in helpers.corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = B.write_tokens(clash, BYTES, 2)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in files.read().collect()} == want
    assert files.rows.where("n_ids > 0").count() >= 1 and files.lengths.max() <= H.MAX_BITS
    assert B.write_tokens(none, BYTES, 2).read().count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, "a"), (1, "a"), (1, "b b"), (0, None)], "doc_id long, text string")
    out = B.write_tokens(odd, BYTES, 2).read().orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 0, 1, 1, 1] and [r["n_tokens"] for r in out][:2] == [2, 1]
    assert out[-1]["start"] + out[-1]["n_tokens"] == sum(r["n_tokens"] for r in out)
    kept = f"file://{tmp_path}/kept"
    B.write_tokens(clash, BYTES, 2, kept)
    again = B.TokenFiles(spark, kept)  # by the files alone
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in again.read().collect()} == want
    with pytest.raises(ValueError):
        B.read_block(b"nope" + bytes(40), H.decoding_table(files.lengths))


def deficit_round_robin(totals, quanta, unit, size):
    """What the first windows take from each queue, with a counter for each queue, token by token."""
    left, counter, took, out, given = list(totals), [0] * len(totals), [0] * len(totals), [[0] * len(totals)], 0
    while any(left):
        for i in range(len(totals)):
            counter[i] += quanta[i]
            while counter[i] >= unit and left[i]:
                counter[i], left[i], took[i], given = counter[i] - unit, left[i] - 1, took[i] + 1, given + 1
                if given % size == 0:
                    out.append(list(took))
    return out if given % size == 0 else [*out, took]


@pytest.mark.parametrize("seed", range(16))
def test_schedule(seed):
    rng = np.random.default_rng(seed)
    s, size = int(rng.integers(1, 8)), int(rng.choice([16, 64, 100]))
    totals, weights = rng.integers(0, 3000, s), rng.random(s) * (rng.random(s) > 0.2)
    if seed % 2 and totals.sum():
        weights = totals / totals.sum()
    plan = P.Schedule(totals, weights, size)
    k = np.arange(-(-int(totals.sum()) // size) + 1)
    q = plan.upto(k)
    assert (q[0] == 0).all() and (q[-1] == totals).all() and (np.diff(q, axis=0) >= 0).all()
    assert (q.sum(axis=1) == np.minimum(k * size, totals.sum())).all()
    if (weights > 0).all():
        assert q.tolist() == deficit_round_robin(totals.tolist(), plan.quantum.tolist(), P.UNIT, size)
    for i in range(s):
        x = np.arange(totals[i])
        assert (plan.window(x, np.full(len(x), i)) == np.searchsorted(q[:, i], x, "right") - 1).all()
    if seed % 2 and len(k) > 3:  # every window but the last holds its share, deficits are carried
        assert np.abs(np.diff(q, axis=0)[:-1] - size * weights).max() < s + 1


def test_schedule_of_many_queues_and_tokens():
    rng = np.random.default_rng(1)
    totals = rng.integers(1, 10**10, 4000)
    plan = P.Schedule(totals, totals / totals.sum(), 4096)
    k = np.sort(rng.integers(0, totals.sum() // 4096, 20))
    q = plan.upto(k)
    assert (q.sum(axis=1) == k * 4096).all()
    at = rng.integers(0, 4000, 20)
    assert (plan.window(q[np.arange(20), at], at) >= k).all() and (plan.window(q[np.arange(20), at] - 1, at)[k > 0] < k[k > 0]).all()


def check_pieces(rows, pieces, size):
    library = Tokenizer.from_file(WORDS)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows}
    at, seen = {}, {}
    for r in sorted(pieces, key=lambda r: (str(r["doc_id"]), r["start"])):
        d = r["doc_id"]
        assert r["start"] == at.get(d, 0) and r["doc_tokens"] == len(ids[d])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[d] = r["start"] + r["length"]
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    full = sum(map(len, ids.values()))
    assert sorted(seen) == list(range(-(-full // size)))
    for k, parts in seen.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == min(size, full - k * size)


@pytest.mark.parametrize("targets", [None, {"s1": 0.2, "s2": 0.5, None: 0.3}, {"s2": 1.0}])
def test_packing(clash, targets):
    pieces = P.pack(clash, WORDS, 2, size=256, targets=targets).collect()
    check_pieces(helpers.corpus(), pieces, 256)


def test_packing_odd_rows(spark, none):
    assert P.pack(none, WORDS, 2).count() == 0
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None), (2, "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.pack(df, WORDS, 2, size=4).collect()
    assert sum(r["length"] for r in out) == 4 + 4 + 1 + 2
    assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)[0][1] == 0
