"""Benchmark decontamination under edit distance.

Both sides are lower-cased and their white space runs become one blank. A CGK random walk maps a string to one in which few
edits become few changed positions: at step j the walk emits the character it stands on and moves on by a random bit of j
and that character, so that after an edit the walks of both strings soon meet again. The walk of an item-sized window begins
like the walk of the text from that place, whatever the item's length; so one walk from each place of a document serves
windows for all items. Places are after blanks, where letters or digits begin, and at each character of unspaced scripts
(``places``). Items are entered at each of their own places, a window for each; for items with few of them every character
is a place, on both sides.

One repetition samples the emitted characters at a fixed set of steps; equal samples make a candidate (item, place). The
number of repetitions is planned for each group of items of similar length, so that an item of the group with ``max_edits``
of its characters edited at random is met with the target recall (``plan_repetitions``). Items too short for a walk, or
that walks do not bring to the recall, are cut into one piece more than edits are allowed and searched by exact pieces,
which misses nothing.

Every candidate is verified by the exact edit distance between the item and the text around the place, with free ends. As
the distances of an item's disjoint pieces of 64 characters, each to the text where it would lie, cannot add up to more than
the item's own, most candidates fall by the first piece or two; those are compared side by side (``ItemIndex.possible``). An
item that is found within ``max_edits`` contaminates the document.

Items are broadcast in blocks that end with the item that reaches ``block_chars`` characters, each of which passes over all
documents; a worker holds the walks of one block, about 16 bytes for each entered place and repetition, some 150 MB at most.
``decontaminate`` writes what a block leaves before the next one passes, so no task holds two.

Result of ``contamination``: one row (doc_id, item_id, edits, similarity) for each document and item found in it, with the
smallest number of edits. ``decontaminate`` returns the documents in which nothing is found, with all their columns.

Cases: null and blank texts contain nothing and blank items are in nothing; items of up to 1 / ``max_edits`` characters must
be found unchanged; rows of equal doc_id are judged each by itself, and items of equal or null item_id each by their own length, with a row for each; long texts are searched whole, in chunks of whole texts; duplicates of an item are all reported; an empty table
on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, pick, prepare, tidy

#: Steps of a walk and how many of them are sampled; an item must have so many bytes at least.
STEPS, SAMPLES = 36, 13
#: Items with fewer places than this are entered at each character, and each character of a document is a place for them.
_FEW = 8
#: Walks after which a group of items that is still short of the recall is searched by its pieces instead.
_PATIENCE = 48
_PRIME = np.uint64(1099511628211)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
#: Characters of text whose candidates are compared together, bytes that are walked together, and entries met together.
_HELD, _CHUNK, _TOGETHER = 4 << 20, 1 << 18, 1 << 20
#: Characters of a word and classes of characters in the comparison of candidates, how many are compared side by side, and
#: what a window has on each side besides the edits.
_WORD, _CLASSES, _SIDE, _BESIDE = 64, 128, 4096, 8


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[ord("a") : ord("z") + 1] = kinds[0x80:] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    return kinds


_KIND = _kinds()


def places(data: np.ndarray, dense: bool) -> np.ndarray:
    """Where windows begin in normalised UTF-8 that has a blank first: at each character if ``dense``, else after blanks,
    where letters or digits begin, and at and after each character of three bytes or more but those of Indian scripts."""
    if dense:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        return at[at > 0]
    kind = _KIND.take(data)
    begins = np.empty(len(data), dtype=bool)
    begins[0] = False
    begins[1:] = ((kind[1:] != kind[:-1]) & (kind[1:] > 0)) | (data[:-1] == 32)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead]
        second = data.take(lead + 1, mode="clip")
        wide = (first >= 0xE1) | ((first == 0xE0) & (second >= 0xB8))
        begins[lead[wide]] = True
        after = np.concatenate([lead[wide] + np.where(first[wide] >= 0xF0, 4, 3), lead[first == 0xC2] + 2])
        begins[after[after < len(data)]] = True
    return np.flatnonzero(begins)


class Walk:
    """One repetition: the random bits of the walk, and the steps that are sampled."""

    def __init__(self, seed: int, steps: int = STEPS):
        rng = np.random.default_rng([10, seed])
        self.bits = rng.integers(0, 2, size=(steps, 256)).astype(np.int64)
        early = 10
        first = rng.choice(early, size=4, replace=False)
        rest = rng.choice(np.arange(early, steps), size=SAMPLES - 4, replace=False)
        self.samples = sorted({*map(int, first), *map(int, rest)})
        self.stops = [self.samples[i] for i in (4, 6, 9)]

    def keys(self, data: np.ndarray, at: np.ndarray, sieves: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """The sampled walk from each place: final keys, the keys at the stops, which places are left, and the last byte read.

        With ``sieves`` places whose key at a stop is in no item's are dropped there.
        """
        pos, key, left, stops = at.astype(np.int64), np.zeros(len(at), dtype=np.uint64), np.arange(len(at)), []
        for j in range(self.samples[-1] + 1):
            c = data.take(pos)
            if j in self.samples:
                key *= _PRIME
                key += c
                if j in self.stops:
                    if sieves is not None:
                        ok = np.flatnonzero(sieves[len(stops)].take(((key * _SPREAD) >> np.uint64(64 - _BITS)).view(np.int64)))
                        pos, key, left, c = pos[ok], key[ok], left[ok], c[ok]
                    stops.append(key.copy())
            if j < self.samples[-1]:
                pos += self.bits[j].take(c)
        return key, stops, left, pos


class Entries:
    """The places of some texts, laid one behind the other: bytes, places, the text of each and its offset there in characters."""

    def __init__(self, raws: list[bytes], dense: bool):
        parts = [np.frombuffer(b" " + r, dtype=np.uint8) for r in raws]
        base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.data = np.concatenate([*parts, np.zeros(STEPS + 1, dtype=np.uint8)])
        self.at = places(self.data[: base[-1]], dense)
        self.who = np.searchsorted(base, self.at, "right") - 1
        inside = self.at > base[self.who]
        self.at, self.who = self.at[inside], self.who[inside]
        chars = np.cumsum((self.data & 0xC0) != 0x80)
        self.off, self.end = chars[self.at] - chars[base[self.who]] - 1, base[self.who + 1]

    def whole(self, walk: Walk):
        """Keys, keys at the stops, texts and offsets of the walks that do not leave their text."""
        key, stops, _, last = walk.keys(self.data, self.at)
        ok = np.flatnonzero(last < self.end)
        return key[ok], [k[ok] for k in stops], self.who[ok], self.off[ok]


def edited(rng: np.random.Generator, text: str, edits: int, letters: str) -> str:
    """The text after random replacements, insertions and deletions."""
    s = list(text)
    for _ in range(edits):
        i, kind, c = int(rng.integers(len(s))), int(rng.integers(3)), letters[int(rng.integers(len(letters)))]
        s[i : i + 1] = [[], [c], [s[i], c]][kind]
        s = s or [" "]
    return "".join(s)


def plan_repetitions(items: list[str], dense: bool, max_edits: float, recall: float) -> int | None:
    """Repetitions after which items with ``max_edits`` of their characters edited at random are met with probability
    ``recall``, or None if ``_PATIENCE`` of them are not enough.

    The walks of the scan itself are tried on random edits, glued to what is before them. Misses of one text are not
    independent, so those left after each walk are counted, down to half of what is allowed.
    """
    rng = np.random.default_rng(11)
    letters = "".join(sorted({c for t in items[:200] for c in t}))
    size = min(600, max(100, 300_000 // max(map(len, items))))
    pairs = [items[int(i)] for i in (rng.permutation(len(items)) if len(items) >= size else rng.integers(len(items), size=size))[:size]]
    texts = [("x" + edited(rng, t, int(max_edits * len(t)), letters)).encode() for t in pairs]
    slack = np.array([max(8, int(max_edits * len(t))) for t in pairs])
    ours, theirs = Entries([t.encode() for t in pairs], dense), Entries(texts, dense)
    missed = np.ones(size, dtype=bool)
    for n in range(_PATIENCE):
        walk = Walk(n)
        key, _, who, off = ours.whole(walk)
        key = key * _SPREAD + who.astype(np.uint64)
        order = np.argsort(key)
        key, off = key[order], off[order]
        seen = walk.keys(theirs.data, theirs.at)[0] * _SPREAD + theirs.who.astype(np.uint64)
        lo, hi = np.searchsorted(key, seen, "left"), np.searchsorted(key, seen, "right")
        for e in np.flatnonzero(hi > lo):
            if missed[theirs.who[e]] and (abs(off[lo[e] : hi[e]] - theirs.off[e]) <= slack[theirs.who[e]]).any():
                missed[theirs.who[e]] = False
        if missed.sum() <= size * (1 - recall) / 2:
            return n + 1
    return None


class ItemIndex:
    """A block of items: their sampled walks for all repetitions, and the pieces of those that walks do not serve."""

    def __init__(self, items: list[tuple[object, str]], max_edits: float, recall: float):
        self.items = [(i, t) for i, t in items if t]
        self.max_edits = max_edits
        self.most = np.array([int(max_edits * len(t)) for _, t in self.items], dtype=np.int64)
        groups, planned = defaultdict(list), defaultdict(list)
        self.passes, self.pieces = [], []
        for n, (_, text) in enumerate(self.items):
            raw = text.encode()
            few = len(places(np.frombuffer(b" " + raw[: max(0, len(raw) - STEPS // 2)], dtype=np.uint8), False)) < _FEW
            groups[few, int(np.log(len(raw)) / np.log(1.2)) if len(raw) >= STEPS else 0].append(n)
        self.plan = {}
        for (dense, size), group in sorted(groups.items()):
            texts = [self.items[i][1] for i in group]
            n = plan_repetitions(texts, dense, max_edits, recall) if size else None
            if size and n is None and not dense:
                dense, n = True, plan_repetitions(texts, True, max_edits, recall)
            self.plan[dense, size] = n
            if n is None:
                self.pieces += [(g, *piece) for g in group for piece in self._pieces(self.items[g][1])]
            for r in range(n or 0):
                planned[dense, r] += group
        self.passes = [(dense, *self._enter(Walk(r), group, dense)) for (dense, r), group in sorted(planned.items())]
        self._mask()

    def _pieces(self, text: str) -> list[tuple[bytes, int]]:
        """One more piece than edits are allowed, with their offsets: one of them is left unedited."""
        n = int(self.max_edits * len(text)) + 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        return [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]

    def _enter(self, walk: Walk, group: list[int], dense: bool):
        key, stops, who, off = Entries([self.items[n][1].encode() for n in group], dense).whole(walk)
        sieves = []
        for k in stops:
            sieve = np.zeros(1 << _BITS, dtype=bool)
            sieve[(k * _SPREAD) >> np.uint64(64 - _BITS)] = True
            sieves.append(sieve)
        order = np.argsort(key, kind="stable")
        return walk, sieves, key[order], np.array(group, dtype=np.int32)[who[order]], off[order].astype(np.int32)

    def _mask(self) -> None:
        """Of each item its full words of ``_WORD`` characters (one shorter word, if it has none): bit masks by character class."""
        sizes = [max(1, len(t) // _WORD) for _, t in self.items]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.masks = np.zeros((self.first[-1], _CLASSES), dtype=np.uint64)
        for n, (_, text) in enumerate(self.items):
            classes = _classes(text)
            for i in range(sizes[n]):
                part = classes[i * _WORD : (i + 1) * _WORD]
                np.bitwise_or.at(self.masks[self.first[n] + i], part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, and the first and the last character of the text where the item may begin; nearby beginnings are one."""
        joined = b" " + b" ".join(texts)
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        data = np.frombuffer(joined + bytes(STEPS + 1), dtype=np.uint8)
        chars = None if joined.isascii() else np.cumsum((data & 0xC0) != 0x80) - 1
        found = [np.zeros((3, 0), dtype=np.int64)]
        at = {dense: places(data[: base[-1]], dense) for dense in {p[0] for p in self.passes}}

        def add(place: np.ndarray, item: np.ndarray, off: np.ndarray) -> None:
            doc = np.searchsorted(base, place, "right") - 1
            begin = place - base[doc] - 1 if chars is None else chars[place] - chars[base[doc]] - 1
            found.append(np.unique(np.stack([doc, item, begin - off]), axis=1))

        for dense, walk, sieves, keys, who, off in self.passes:
            key, _, left, _ = walk.keys(data, at[dense], sieves)
            lo = np.searchsorted(keys, key, "left")
            many = np.searchsorted(keys, key, "right") - lo
            hit = np.flatnonzero(many)
            for part in np.split(hit, np.searchsorted(np.cumsum(many[hit]), np.arange(_TOGETHER, int(many.sum()), _TOGETHER))):
                if len(part):
                    n = many[part]
                    entry = np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    add(np.repeat(at[dense][left[part]], n), who[entry].astype(np.int64), off[entry])
        for n, piece, off in self.pieces:
            p, where = joined.find(piece), []
            while p >= 0:
                where.append(p)
                p = joined.find(piece, p + 1)
            if where:
                add(np.array(where), np.full(len(where), n), np.full(len(where), off))
        doc, item, begin = np.concatenate(found, axis=1)
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        new = np.ones(len(doc), dtype=bool)
        near = begin // np.maximum(8, self.most[item])
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (near[1:] != near[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(doc))[: len(heads)] - 1
        return doc[heads], item[heads], begin[heads], begin[tails]

    def possible(self, classes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which candidates the words of their items do not rule out, for items that begin at places ``lo`` to ``hi``.

        ``classes`` are the characters of all texts side by side. A word is looked for in more text than it can lie in, and
        characters of one class count as equal, so that the sum of the words' distances is never too large.
        """
        most, n_words = self.most[item], self.first[item + 1] - self.first[item]
        far, sum_ = np.ones(len(item), dtype=bool), np.zeros(len(item), dtype=np.int64)
        for i in range(int(n_words.max(initial=0))):
            left = np.flatnonzero(far & (i < n_words))
            span = hi[left] - lo[left] + _WORD + 2 * most[left] + 2 * _BESIDE
            left = left[np.argsort(span, kind="stable")]
            for part in np.split(left, np.arange(_SIDE, len(left), _SIDE)):
                if len(part):
                    length = np.array([min(_WORD, len(self.items[n][1])) for n in item[part].tolist()]) if i == 0 else np.full(len(part), _WORD)
                    begin = lo[part] + i * _WORD - most[part] - _BESIDE
                    columns = int((hi[part] - lo[part] + 2 * most[part]).max()) + _WORD + 2 * _BESIDE
                    sum_[part] += _word_distances(self.masks, self.first[item[part]] + i, length, classes, begin, columns)
            far = sum_ <= most
        return far

    def hits(self, texts: list[str]) -> list[list[tuple[object, int, float]]]:
        """For each normalised text the items in it: id, edits, similarity."""
        out: list[list] = [[] for _ in texts]
        raw, at, found = [t.encode() for t in texts], 0, []
        ends = np.cumsum([len(r) for r in raw])
        while at < len(raw):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - len(raw[at]) + _CHUNK, "right")))
            doc, *rest = self.candidates(raw[at:stop])
            found.append((doc + at, *rest))
            at = stop
        doc, item, lo, hi = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 4
        if not len(doc):
            return out
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        likely = self.possible(_classes(" ".join(texts)), item, base[doc] + lo, base[doc] + hi)
        rows = [x[likely].tolist() for x in (doc, item, lo, hi)]
        for at, (d, n, a, b) in enumerate(zip(*rows)):
            ident, text = self.items[n]
            most = int(self.most[n])
            if not at or (rows[0][at - 1], rows[1][at - 1]) != (d, n):
                best = most + 1
            if best:
                best = min(best, fewest_edits(text, texts[d][max(0, a - most - _BESIDE) : max(0, b + len(text) + most + _BESIDE)]))
            if (at + 1 == len(rows[0]) or (rows[0][at + 1], rows[1][at + 1]) != (d, n)) and best <= most:
                out[d].append((ident, best, 1 - best / len(text)))
        return out


def _classes(text: str) -> np.ndarray:
    """The class of each character: its own for ASCII, one of as many for all others."""
    return (np.frombuffer(text.encode("utf-32-le"), dtype="<u4") & np.uint32(_CLASSES - 1)).astype(np.uint8)


def _word_distances(masks: np.ndarray, word: np.ndarray, length: np.ndarray, classes: np.ndarray, begin: np.ndarray, columns: int) -> np.ndarray:
    """The smallest edit distance of each word to any substring of ``columns`` characters from ``begin`` on; places outside
    the text read its ends. Bit-parallel dynamic programming, a column of all pairs at a time."""
    flat, row = masks.ravel(), word * masks.shape[1]
    one, full = np.uint64(1), bool((length == _WORD).all())
    top = np.uint64(_WORD - 1) if full else (length - 1).astype(np.uint64)
    up, down = np.full(len(word), ~np.uint64(0)), np.zeros(len(word), dtype=np.uint64)
    score, best = length.astype(np.int64), length.astype(np.int64)
    pos = begin.copy()
    inside = len(pos) and pos.min() >= 0 and pos.max() + columns < len(classes)
    for _ in range(columns):
        eq = flat.take(row + classes.take(pos, mode="wrap" if inside else "clip"))
        pos += 1
        d0 = eq & up
        d0 += up
        d0 ^= up
        d0 |= eq
        d0 |= down
        hp = d0 | up
        np.invert(hp, out=hp)
        hp |= down
        hn = up & d0
        more, less = hp >> top, hn >> top
        if not full:
            more &= one
            less &= one
        score += more.view(np.int64)
        score -= less.view(np.int64)
        np.minimum(best, score, out=best)
        hp <<= one
        hn <<= one
        up = d0 | hp
        np.invert(up, out=up)
        up |= hn
        down = hp & d0
    return best


def fewest_edits(item: str, text: str) -> int:
    """The smallest edit distance between ``item`` and any substring of ``text``: bit-parallel dynamic programming."""
    if item in text:
        return 0
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    rows: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        rows[c] |= 1 << i
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = rows.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (mask & ~(d0 | up)), up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            best = min(best, score)
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        up, down = hn | (mask & ~(d0 | hp)), hp & d0
    return best


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in pick(benchmark, "item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if text:
            block.append((row["item_id"], text))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _scan(index, keep_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            found, held, size = [], [], 0
            for t in texts:
                held.append(normalise(t.as_py()))
                size += len(held[-1])
                if size >= _HELD:
                    found += items.hits(held)
                    held, size = [], 0
            if held:
                found += items.hits(held)
            if keep_clean:
                yield b.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[i], *hit) for i, f in enumerate(found) for hit in f]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "edits", "similarity"])

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame, max_edits: float, recall: float, block_chars: int):
    spark = docs.sparkSession
    prepare(spark)
    for block in _blocks(benchmark, block_chars):
        yield spark.sparkContext.broadcast(ItemIndex(block, max_edits, recall))


def contamination(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99, block_chars: int = 1 << 20) -> DataFrame:
    """Every (document, item) pair within ``max_edits``; see the module's text."""
    schema = "doc_id long, item_id long, edits long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    for index in _indexes(docs, benchmark, max_edits, recall, block_chars):
        out = out.unionByName(rows.mapInArrow(tidy(_scan(index, False)), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99, block_chars: int = 1 << 20) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    work = Scratch(docs.sparkSession, "clean")
    left = None
    for i, index in enumerate(_indexes(docs, benchmark, max_edits, recall, block_chars)):
        if i:  # so that a task holds one block, and later blocks see only what the earlier ones have left
            docs = work.table(left, f"block-{i}")
            if i > 1:
                work.drop(f"block-{i - 1}")
        left = docs.mapInArrow(tidy(_scan(index, True)), docs.schema)
    return docs if left is None else left
