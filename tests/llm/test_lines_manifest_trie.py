"""Line dedup, Merkle manifest and prefix trie against brute-force versions and their SQL."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict
from itertools import groupby

import duckdb
import helpers
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.llm import line_dedup, manifest, prefix_trie, queries

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(v) else str(int(v)) if isinstance(v, (float, bool, np.bool_)) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_prefix_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(con.execute(queries.oracle_sql()[name]).df())


# line dedup


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def kept_lines(rows, least=40, docs=5):
    hold = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(line_key(x)) >= least:
                hold[line_key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(hold[line_key(x)]) >= docs and max(hold[line_key(x)]) != d for x in lines]
        out.append((d, lines, [x for x, g in zip(lines, gone) if not g]))
    return out


def lined(n=120, seed=5):
    rng = random.Random(seed)
    words = helpers.vocabulary(60)
    hot = [helpers.prose(rng, words, 12).replace("\n", " ") for _ in range(12)]
    rows = [(None, hot[0]), (None, hot[0]), (3, None), (4, ""), (5, "\n\n"), (6, "é" * 39), (7, "é" * 40), (8, "\n".join(hot * 300))]
    rows += [(i, "é" * 40 + rng.choice(["", " ", "\t\r"])) for i in range(10, 15)]
    for i in range(20, n):
        text = [rng.choice(hot) if rng.random() < 0.4 else helpers.prose(rng, words, rng.randint(1, 20)) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(rng.choice([x, x, x.upper(), f"  {x}\r"]) for x in text)))
    return [*rows, rows[-1], (n - 2, hot[1]), (n - 2, hot[1] + "\n" + hot[2])]


def test_lines_are_those_of_brute_force(spark):
    rows = lined()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = kept_lines(rows)
    assert sum(len(a) - len(b) for _, a, b in want) > 1000
    expected = [(d, len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for d, a, b in want]
    assert order(map(tuple, line_dedup.line_dedup(docs).collect())) == order(expected)
    kept = docs.withColumn("key", F.lit(1)).withColumn("_dropped", F.lit("x")).withColumn("shard", F.lit(2.5))
    out = line_dedup.drop_repeated_lines(kept)
    assert out.columns == kept.columns and {(r["key"], r["_dropped"], r["shard"]) for r in out.collect()} == {(1, "x", 2.5)}
    texts = [(d, "\n".join(b) if len(a) > len(b) else t) for (d, a, b), (_, t) in zip(want, rows)]
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order(texts)


def test_a_line_index_is_opened_again(spark, tmp_path):
    rows = lined(seed=6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    first = line_dedup.line_dedup(docs, path=path).collect()
    assert order(map(tuple, line_dedup.line_dedup(docs, path=path).collect())) == order(map(tuple, first))
    new = spark.createDataFrame([(10**9, rows[7][1]), (10**9 + 1, "a line of its own that no other document has at all")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(new, path=path).collect()}
    held = kept_lines(rows)[7]
    keys = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            keys[line_key(x)].add(d)
    assert got[10**9] == (len(held[1]), sum(len(keys[line_key(x)]) >= 5 for x in held[1])) and got[10**9 + 1] == (1, 0)


def test_no_lines(spark, none):
    assert line_dedup.line_dedup(none).collect() == [] and line_dedup.drop_repeated_lines(none).columns == none.columns
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark, min_docs=300)


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 70_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**64, size=n, dtype=np.uint64) for _ in range(2))
    a[: n // 3] = 5  # keys that differ in one half only
    hash_ = line_dedup.PerfectHash.build(a, b)
    assert sorted(hash_.slots(a, b).tolist()) == list(range(n))
    assert len(hash_.bits) <= 4.5 * n + 400
    other = hash_.slots(b[:100], a[:100])
    assert ((other >= -1) & (other < max(1, n))).all()
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.zeros(2, dtype=np.uint64), np.zeros(2, dtype=np.uint64))


def test_fingerprints_refuse_other_keys():
    rng = np.random.default_rng(1)
    pairs = np.zeros(5000, dtype=line_dedup._PAIR)
    pairs["a"], pairs["b"] = rng.integers(-(2**63), 2**63, size=(2, 5000))
    n = rng.integers(1, 400, size=5000)
    row = line_dedup.Shard.build(3, pairs["a"], pairs["b"], n, np.arange(5000), 5)
    shard = line_dedup.Shard(dict(zip(("shard", "sizes", "bits", "fingerprints", "counts", "hot", "last"), row)))
    hits = shard.repeated(pairs, 5)
    assert hits["last"].tolist() == np.flatnonzero(n >= 5).tolist()
    pairs["b"] += 1 << 40
    assert not len(shard.repeated(pairs, 5))


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, k):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
    return levels


def merkle(rows, k):
    """doc_id, text, lang, source, n_chars rows, tree by tree."""

    def leaf(r):
        return H(*("-" if r[i] is None else f"{len(str(r[i]).encode())}:{r[i]}" for i in (0, 3, 2, 4, 1)))

    rows = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[2])]
    trees = [climb([leaf(r) for r in g], k) for g in groups]
    top = climb([t[-1][0] for t in trees], k)
    out = []
    for number, (group, tree) in enumerate(zip(groups, trees)):
        for i, r in enumerate(group):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, siblings = leaf((*r[:4], r[4] + 1) if bad else r), []
            for levels, at in ((tree, i), (top, number)):
                for nodes in levels[:-1]:
                    run = nodes[at - at % k : at - at % k + k]
                    left, right = run[: at % k], run[at % k + 1 :]
                    siblings += left + right
                    now, at = H(*left, now, *right), at // k
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], H(*siblings), now, now == top[-1][0]))
    return out


ROWS = [(None, "a", None, "s", None), (None, "b", None, "s", 1), (5, None, None, None, 3), (5, None, None, None, 3), (5, "other", None, None, 3), (1, "", "xx", "s", 0), (2, "é" * 100_000, "é", "s", 7), (7, "x", "zz", None, 1)]


@pytest.mark.parametrize(("arity", "span"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_manifest(spark, arity, span):
    rows = ROWS + [(i, f"t{i % 3}", "yy", "s", i) for i in range(61)]
    docs = spark.createDataFrame(rows, helpers.SCHEMA).repartition(6)
    for c in ("n", "pos", "leaf", "level", "part", "at", "salt"):
        docs = docs.withColumn(c, F.lit("x"))
    want = merkle(rows, arity)
    assert order(map(tuple, manifest.manifest(docs, arity, span).collect())) == order(want)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, none):
    for rows in ([ROWS[0]], [ROWS[5], ROWS[6]]):
        assert order(map(tuple, manifest.manifest(spark.createDataFrame(rows, helpers.SCHEMA)).collect())) == order(merkle(rows, 2))
    assert manifest.manifest(none).collect() == []


def test_combiner_takes_events_in_any_order():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    want = climb([x.hex() for x in leaves], 3)[-1][0]
    for seed in range(3):
        c = manifest.Combiner(3, 20)
        events = list(enumerate(leaves))
        random.Random(seed).shuffle(events)
        first = manifest.Combiner(3, 20)
        for i, d in events[:50]:
            first.feed(0, 100, 0, i, d)
        first.rest()
        assert first.partial == {}
        for kind, tree, n, level, i, d, _ in first.done:
            if kind == manifest.OPEN:
                c.feed(tree, n, level, i, d)
        for i, d in events[50:]:
            c.feed(0, 100, 0, i, d)
        assert [d[5].hex() for d in c.done if d[0] == manifest.ROOT] == [want] and not c.partial


# prefix trie


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    return [(m[0], len(s), members[s[:-1]][0] if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(",".join(map(str, ends.get(s, []))).encode()).hexdigest()) for s, m in members.items()]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 101, 102, 113, -7, None]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "é" * 500])))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


CASES = {
    "odd": conversations(),
    "one": [(1, 0, "user", "x")],
    "none": [],
    "copies": [(c, t, "u", "same") for c in range(300) for t in range(3)] + [(5 * c + 1000, t, "u", f"deep{t}") for c in range(3) for t in range(70)],
    "long": [(0, 0, "u", "w" * 3_000_000), (5, 0, "u", "w" * 3_000_000), (6, 1, "u", "own")],
}


@pytest.mark.parametrize("case", CASES)
def test_trie(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    for c in ("key", "depth", "n", "parent", "family", "bytes"):
        df = df.withColumn(c, F.lit("x"))
    assert order(map(tuple, prefix_trie.prefix_trie(df).select(*prefix_trie.RESULT).collect())) == order(trie(rows))


def test_ends_in_pieces_and_families_in_parts(spark, monkeypatch):
    """Small bounds, on the functions that tasks run."""
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    keys = [bytes([k]) * 16 for k in range(5) for _ in range(40)]
    ids = list(range(200))
    done, pieces = {}, []
    for cut in ((0, 30), (30, 150), (150, 200)):
        batch = pa.RecordBatch.from_arrays([pa.array(keys[slice(*cut)], pa.binary()), pa.array(ids[slice(*cut)], pa.int64())], names=["key", "conv_id"])
        for out in prefix_trie._end_digests(iter([batch.slice(0, 7), batch.slice(7)])):
            for r in out.to_pylist():
                if r["ids"] is None:
                    done[r["key"]] = r["ends_sha256"]
                else:
                    pieces.append((r["key"], r["first"], r["ids"]))
    pieces.sort()
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[2] for p in pieces], pa.binary())], names=["key", "ids"])
    for out in prefix_trie._join_pieces(iter([batch.slice(0, 3), batch.slice(3)])):
        done |= {r["key"]: r["ends_sha256"] for r in out.to_pylist()}
    assert done == {bytes([k]) * 16: hashlib.sha256(",".join(map(str, range(40 * k, 40 * k + 40))).encode()).hexdigest() for k in range(5)}

    trie_, small = prefix_trie.FamilyTrie(), prefix_trie.FamilyTrie()
    for t in (trie_, small):
        monkeypatch.setattr(prefix_trie, "HELD", 4 if t is small else 1000)
        for c in range(3):
            t.begin(c)
            for i in range(9):
                t.turn(b"u", b"%d" % (i if i < 5 else 10 * c + i))
            t.end()
        t.flush()

    def merged(rows):
        out = defaultdict(lambda: [0, 99])
        for key, parent, depth, size, n, conv, ends in rows:
            out[key, parent, depth, size, ends][0] += n
            out[key, parent, depth, size, ends][1] = min(out[key, parent, depth, size, ends][1], conv)
        return out

    assert merged(trie_.rows) == merged(small.rows) and len(small.rows) > len(trie_.rows)
