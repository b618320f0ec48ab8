"""A Merkle manifest of a document table: a tree for each language, a tree over their roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs, one after the other; digests enter as hex text. A leaf is H of doc_id, source,
lang, n_chars and text, each as its UTF-8 byte count, a colon and the value, or a dash if null. The leaves of a language stand
in the order of doc_id; every ``arity`` consecutive nodes become their H, the last ones also if they are fewer, until one
node is left, the subroot. The subroots, in the order of languages, give the root in the same way.

The trees are built like ``combineByKey``, driven by events (``Combiner``): a node is a child event of its parent, which
holds the digests of the children that have come, by index. How many it needs follows from the size of its tree; with the last of them
the parent is complete, is emitted with a link back to its children, and is itself an event of its own parent. Each round
covers ``span`` levels:

1. every partition combines what it holds (map side), which completes all but the nodes at the edges of its ranges;
2. what is unresolved, a few nodes for each edge and level, is shuffled by the ancestor at the top of the round and combined.

Rounds go on with the nodes that are left, 1 of ``arity ** span`` each time. Proofs go down the same rounds over the reverse
links: the proof of a child is its siblings and the proof of its parent. A task holds one ancestor's part of a round, at most
``arity ** span`` nodes, so a language of any size spreads over tasks. Digests of texts are made where the texts are; only digests move.

``verify`` folds a leaf with its siblings up to the root, as a holder of the proof does.

Cases: null values have a dash, and a null doc_id or language comes first; rows of equal language and doc_id stand in the
order of their leaves, and equal rows one after the other; empty and very long texts are values as others; an empty table has no rows and no root; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, crc32_of_id, pick, prepare, tidy

ARITY, SPAN = 2, 10
LINK, UP, ROOT, OPEN = range(4)
_NODES = "kind int, tree long, n long, level int, idx long, digest binary, kids binary"
_NAMES = [f.split()[0] for f in _NODES.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_PROOFS = "tree long, n long, level int, idx long, proof binary, subroot binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@lru_cache(4096)
def level_sizes(n: int, arity: int) -> tuple[int, ...]:
    """Nodes at each level of a tree of n leaves, from the leaves to the root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return tuple(sizes)


def digest_of(kids: list[bytes]) -> bytes:
    return hashlib.sha256("".join(k.hex() for k in kids).encode()).digest()


class Combiner:
    """Partial parents of the nodes that have come; ``done`` gathers complete nodes with their links."""

    def __init__(self, arity: int, top: int):
        self.arity, self.top, self.partial, self.done = arity, top, {}, []

    def feed(self, tree: int, n: int, level: int, idx: int, digest: bytes) -> None:
        sizes = level_sizes(n, self.arity)
        while True:
            if sizes[level] == 1 or level == self.top:
                self.done.append((ROOT if sizes[level] == 1 else UP, tree, n, level, idx, digest, None))
                return
            parent = idx // self.arity
            key = tree, n, level, parent
            kids = self.partial.setdefault(key, {})
            kids[idx] = digest
            if len(kids) < min(self.arity, sizes[level] - parent * self.arity):
                return
            del self.partial[key]
            own = [kids[i] for i in sorted(kids)]
            digest, level, idx = digest_of(own), level + 1, parent
            self.done.append((LINK, tree, n, level, idx, digest, b"".join(own)))

    def rest(self) -> None:
        """What has no complete parent here goes on as it is."""
        for (tree, n, level, _), kids in self.partial.items():
            self.done += [(OPEN, tree, n, level, idx, digest, None) for idx, digest in kids.items()]
        self.partial = {}

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.done)) or [[]] * len(_NAMES)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _combine(arity: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Combiner(arity, top)
        for b in batches:
            for event in zip(*(b.column(n).to_pylist() for n in ("tree", "n", "level", "idx", "digest"))):
                c.feed(*event)
            yield c.take()
        c.rest()
        yield c.take()

    return run


def _descend(arity: int, base: int):
    """Proofs of a round's lowest nodes from those of its highest; rows come by ancestor, those with a proof first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tops, links in _groups(batches, ("level", "idx", "proof", "subroot", "kids", "n")):
            rows = []
            for tree, n, level, idx, proof, subroot in _below(tops, links, arity, base):
                rows.append((tree, n, level, idx, proof, subroot))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=[f.split()[0] for f in _PROOFS.split(", ")])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Rows of each (tree, block), split into those with a proof and the links among the others."""
    now, tops, links = None, [], {}
    for b in batches:
        for tree, block, *row in zip(*(b.column(c).to_pylist() for c in ("tree", "block", *names))):
            if (tree, block) != now:
                if now is not None:
                    yield tops, links
                now, tops, links = (tree, block), [], {}
            level, idx, proof, subroot, kids, n, *more = row
            if proof is not None:
                tops.append((tree, n, level, idx, proof, subroot))
            elif kids is not None:
                links[level, idx] = kids
            else:
                links.setdefault(idx, []).append(more)
    if now is not None:
        yield tops, links


def _below(tops: list, links: dict, arity: int, base: int) -> Iterator[tuple]:
    stack = list(tops)
    while stack:
        tree, n, level, idx, proof, subroot = stack.pop()
        if level == base:
            yield tree, n, level, idx, proof, subroot
            continue
        kids = links[level, idx]
        for j in range(len(kids) >> 5):
            stack.append((tree, n, level - 1, idx * arity + j, kids[: 32 * j] + kids[32 * j + 32 :] + proof, subroot))


def fold(digest: bytes, idx: int, n: int, siblings: list[bytes], arity: int) -> tuple[bytes, list[bytes]]:
    """The root over a node at place ``idx`` of ``n``, and the siblings that are left over."""
    for size in level_sizes(n, arity)[:-1]:
        first = idx - idx % arity
        many = min(arity, size - first)
        own, siblings = siblings[: many - 1], siblings[many - 1 :]
        digest, idx = digest_of([*own[: idx - first], digest, *own[idx - first :]]), idx // arity
    return digest, siblings


def verify(leaf: bytes, pos: int, n: int, tree: int, trees: int, proof: bytes, arity: int = ARITY) -> str:
    """The root that a leaf's digest and its proof give."""
    siblings = [proof[i : i + 32] for i in range(0, len(proof), 32)]
    subroot, rest = fold(leaf, pos, n, siblings, arity)
    return fold(subroot, tree, trees, rest, arity)[0].hex()


def _prove(arity: int, trees: int, root: str):
    """Results of the rows of each block of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for tops, links in _groups(batches, ("level", "idx", "proof", "subroot", "kids", "n", "doc_id", "leaf", "other")):
            rows = []
            for tree, n, _, idx, proof, subroot in _below(tops, links, arity, 0):
                for doc, leaf, other in links[idx]:
                    folded = verify(other or leaf, idx, n, tree, trees, proof, arity)
                    rows.append((doc, leaf.hex(), subroot.hex(), root, hashlib.sha256(proof.hex().encode()).hexdigest(), folded, folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def numbered(rows: DataFrame, group: str | None, order: list[str], work: Scratch, name: str) -> DataFrame:
    """A written table with ``pos``, each row's place in its group, and ``n``, the group's size.

    Rows are range-partitioned; places inside a partition are local, and what is before it comes from a table of one row for
    each partition and group that meet.
    """
    own = F.col(group) if group else F.lit(None).cast("string")
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    local = work.table(local, f"{name}-local")
    w = Window.partitionBy("own")
    parts = local.groupBy("part", own.alias("own")).agg(F.count("*").alias("many"), F.min("at").alias("first"))
    parts = parts.select("part", "own", "first", (F.sum("many").over(w.orderBy("part")) - F.col("many")).alias("before"), F.sum("many").over(w).alias("n"))
    parts = work.table(parts.withColumnRenamed("part", "_part"), f"{name}-parts")
    on = (F.col("part") == F.col("_part")) & own.eqNullSafe(F.col("own"))
    out = local.join(parts.hint("merge"), on).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "_part", "own", "at", "first", "before")
    return work.table(out, name)


class Forest:
    """Trees of one digest a node: built upwards in rounds, whose links lead proofs down again."""

    def __init__(self, leaves: DataFrame, work: Scratch, name: str, arity: int = ARITY, span: int = SPAN):
        """``leaves``: tree, pos, n, digest."""
        self.work, self.name, self.arity, self.span, self.rounds = work, name, arity, span, []
        longest = leaves.agg(F.max("n")).head()[0] or 0
        left = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
        while longest and (not self.rounds or longest > 1):
            r, top = len(self.rounds), span * (len(self.rounds) + 1)
            here = work.table(left.sortWithinPartitions("tree", "idx").mapInArrow(tidy(_combine(arity, top)), _NODES), f"{name}-{r}-here")
            open_ = here.where(F.col("kind") == OPEN).withColumn("block", self._block(top))
            met = open_.repartition("tree", "block").select("tree", "n", "level", "idx", "digest").mapInArrow(tidy(_combine(arity, top)), _NODES)
            met = work.table(met, f"{name}-{r}-met")
            both = here.where(F.col("kind") != OPEN).unionByName(met)
            self.rounds.append(both)
            left = both.where(F.col("kind") == UP).select("tree", "n", "level", "idx", "digest")
            longest = -(-longest // arity**span)

    def _block(self, top: int) -> Column:
        """The ancestor at the round's top of a node below it."""
        return F.expr(f"idx div cast(pow({self.arity}, {top} - level) as bigint)")

    def roots(self) -> DataFrame:
        out = [both.where(F.col("kind") == ROOT).select("tree", "n", "level", "idx", "digest") for both in self.rounds]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]

    def descend(self, roots: DataFrame, last) -> DataFrame:
        """Proofs (``_PROOFS``) of all nodes below ``roots``, given with theirs; ``last`` makes the rows of the lowest round."""
        given = None
        for r in range(len(self.rounds) - 1, -1, -1):
            top, base = self.span * (r + 1), self.span * r
            links = self.rounds[r].where(F.col("kind") == LINK).select("tree", "n", "level", "idx", "kids")
            ends = roots.where(f"level between {base + (r > 0)} and {top}")
            tops = ends if given is None else ends.unionByName(given)
            rows = links.unionByName(tops, allowMissingColumns=True).withColumn("block", self._block(top))
            if not r:
                return last(rows)
            given = rows.repartition("tree", "block").sortWithinPartitions("tree", "block").select("tree", "block", "level", "idx", "proof", "subroot", "kids", "n").mapInArrow(tidy(_descend(self.arity, base)), _PROOFS)
            given = self.work.table(given, f"{self.name}-{r}-proofs")


def manifest(docs: DataFrame, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """Per document doc_id, leaf, subroot, root, proof_sha256 (H of the siblings from the leaf to the root), folded_root (of
    a tampered leaf where 7 divides the CRC-32 of doc_id) and verified (whether that is the root)."""
    spark = docs.sparkSession
    prepare(spark)
    work = Scratch(spark, "manifest")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.when((F.pmod(crc32_of_id(doc_id), F.lit(7)) == 0) & n_chars.isNotNull(), leaf_digest(doc_id, source, lang, n_chars.cast("long") + 1, text))
    rows = pick(docs, "doc_id", "source", "lang", "n_chars", "text").select(doc_id.cast("long").alias("doc_id"), lang.cast("string").alias("lang"), leaf_digest(doc_id, source, lang, n_chars, text).alias("leaf"), tampered.alias("other"), F.monotonically_increasing_id().alias("salt"))
    rows = work.table(rows, "leaves")
    leaves = numbered(rows, "lang", ["lang", "doc_id", "leaf", "salt"], work, "places")
    langs = numbered(work.table(leaves.groupBy("lang").agg(F.max("n").alias("leaves")), "sizes"), None, ["lang"], work, "langs")
    trees = langs.select(F.col("lang").alias("_lang"), F.col("pos").alias("tree"))
    leaves = work.table(leaves.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "pos", "n", "doc_id", "leaf", "other"), "placed")

    forest = Forest(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")), work, "tree", arity, span)
    if not forest.rounds:
        return spark.createDataFrame([], RESULT)
    subroots = work.table(forest.roots(), "subroots")
    count = langs.agg(F.max("n")).head()[0]
    above = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).alias("n"), "digest"), work, "top", arity, span)
    end = work.table(above.roots(), "root")
    root = end.head()["digest"].hex()

    def of_langs(rows: DataFrame) -> DataFrame:
        ask = rows.repartition("tree", "block").sortWithinPartitions("tree", "block").select("tree", "block", "level", "idx", "proof", "subroot", "kids", "n")
        return work.table(ask.mapInArrow(tidy(_descend(arity, 0)), _PROOFS), "top-proofs")

    upper = above.descend(end.select("tree", "n", "level", "idx", F.lit(b"").alias("proof"), F.col("digest").alias("subroot")), of_langs)
    tops = subroots.join(upper.select(F.col("idx").alias("tree"), "proof").hint("merge"), "tree").select("tree", "n", "level", "idx", "proof", F.col("digest").alias("subroot"))

    def of_rows(rows: DataFrame) -> DataFrame:
        own = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), "doc_id", "leaf", "other").withColumn("block", forest._block(span))
        ask = rows.unionByName(own, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block")
        ask = ask.select("tree", "block", "level", "idx", "proof", "subroot", "kids", "n", "doc_id", "leaf", "other")
        return ask.mapInArrow(tidy(_prove(arity, count, root)), RESULT)

    return forest.descend(work.table(tops, "tops"), of_rows)
