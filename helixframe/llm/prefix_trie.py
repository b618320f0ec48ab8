"""The prefix trie of conversations, merged family by family.

Conversation c belongs to the family of ``c - c % FAMILY``. It is rebuilt from the first h turns of its family's base
conversation, which has that id, and its own turns after its first h, h being the CRC-32 of its decimal id modulo 9. A node
is a distinct sequence of turns (role, text) that rebuilt conversations begin with; its key is a 128-bit chained digest.

1. The turns of a family come together, ordered, in one stream: the base's first turns are kept, and each member's turns
   walk down the family's small trie (``FamilyTrie``). A task holds one family's nodes, 32 bytes each and no texts, and
   hands them on when they are more than ``HELD``.
2. Only the families' nodes are shuffled, with their sums combined by task before: members add up, the smallest member
   stays. Conversations that end somewhere are rows of their own.
3. A node is named by its smallest member and its depth, and below a node of a conversation's name all of that conversation's
   nodes have it too. So the trie is chains, one a conversation, each hanging from a node of another chain. Sums over whole
   chains meet by doubling along the chain above (log2 of the nesting, one row a chain); a running sum up each chain then
   gives every node's subtree. The root, which nothing is above, is summed apart.
4. Ids that end at a node are range-partitioned by node and id and hashed as they stream by; only the first and the last
   node of a partition can go on elsewhere, and those alone meet again, as pieces of at most ``PIECE`` bytes in order. So a
   node at which a third of all conversations end costs a task a stream, no list.

Turns of one conversation are chained in order, so one conversation is one task's stream, however long.

Cases: a null role or text is an empty one; turns are ordered with null first, rows of equal turn by role and text; rows
without conv_id take no part; a conversation without a base keeps its own turns after its first h, possibly none, and is then
a member of the root only; long texts are held one at a time; an empty table gives no nodes; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, pick, prepare, tidy

FAMILY, SHARED = 5, 9
#: Nodes of a family that a task holds at most, and bytes of a piece of joined ids.
HELD, PIECE = 1 << 17, 1 << 20
_NODES = "key binary, parent binary, depth int, bytes long, n long, conv_id long, ends boolean"
_NAMES = [f.split()[0] for f in _NODES.split(", ")]
_KINDS = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
ROOT = bytes(16)
RESULT = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % SHARED


def step(key: bytes, role: bytes, text: bytes) -> bytes:
    """The key of a node's child."""
    h = hashlib.blake2b(key, digest_size=16)
    h.update(b"%d:" % len(role))
    h.update(role)
    h.update(text)
    return h.digest()


class FamilyTrie:
    """Nodes of one family: how many members pass, and the smallest; conversations that end are kept with the node they end at."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.rows: list[tuple] = []
        self.conv, self.key, self.depth = None, ROOT, 0

    def begin(self, conv: int) -> None:
        self.conv, self.key, self.depth = conv, ROOT, 0
        self._pass(ROOT, None, 0, 0)

    def turn(self, role: bytes, text: bytes) -> None:
        parent, self.key, self.depth = self.key, step(self.key, role, text), self.depth + 1
        self._pass(self.key, parent, self.depth, len(text))

    def _pass(self, key: bytes, parent: bytes | None, depth: int, size: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            if len(self.nodes) >= HELD:
                self.flush()
            self.nodes[key] = [parent, depth, size, 1, self.conv]
        else:
            node[3] += 1
            node[4] = min(node[4], self.conv)

    def end(self) -> None:
        self.rows.append((self.key, None, self.depth, 0, 0, self.conv, True))

    def flush(self) -> None:
        self.rows += [(key, *node, False) for key, node in self.nodes.items()]
        self.nodes = {}


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in the order of family, conversation and turn become the nodes of each family."""
    trie, family, conv = FamilyTrie(), None, None
    base: list[tuple[bytes, bytes]] = []
    seen = shared = 0

    def finish():
        if conv is not None:
            if conv != family and seen <= shared:  # no turn of its own came after the shared ones
                for t in base[:shared]:
                    trie.turn(*t)
            trie.end()

    def out():
        cols = list(zip(*trie.rows)) or [[]] * len(_NAMES)
        trie.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)

    for b in batches:
        for f, c, role, text in zip(b.column("family").to_pylist(), b.column("conv_id").to_pylist(), b.column("role"), b.column("text")):
            role, text = (v.as_buffer().to_pybytes() if v.is_valid else b"" for v in (role, text))
            if f != family or c != conv:
                finish()
                if f != family:
                    trie.flush()
                    family, base = f, []
                conv, seen, shared = c, 0, shared_turns(c)
                trie.begin(c)
            if c == f and seen < SHARED - 1:
                base.append((role, text))
            seen += 1
            if c == f:
                trie.turn(role, text)
            elif seen > shared:
                if seen == shared + 1:
                    for t in base[:shared]:
                        trie.turn(*t)
                trie.turn(role, text)
        if trie.rows:
            yield out()
    finish()
    trie.flush()
    yield out()


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends in the order of key and conv_id: a digest for each node that lies inside the partition; the nodes at its two
    edges leave their ids in pieces."""
    now, first, piece, size, no = None, True, [], 0, 0
    rows: list[tuple] = []

    def cut():
        nonlocal piece, size, no
        if piece:
            rows.append((now, None, no, piece[0], ",".join(map(str, piece)).encode()))
            piece, size, no = [], 0, no + 1

    for b in batches:
        for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if key != now:
                if now is not None:
                    if first or no:  # at the edge, or already in pieces
                        cut()
                    else:
                        rows.append((now, hashlib.sha256(",".join(map(str, piece)).encode()).hexdigest(), 0, None, None))
                    first = False
                now, piece, size, no = key, [], 0, 0
            piece.append(conv)
            size += 12
            if size >= PIECE:
                cut()
        if rows:
            yield _digest_rows(rows)
            rows = []
    if now is not None:
        cut()
        yield _digest_rows(rows)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "ends_sha256", "no", "first", "ids"])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of key and first id: one digest a node."""
    now, h, rows = None, None, []
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    rows.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256(ids)
            else:
                h.update(b",")
                h.update(ids)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame, work: Scratch) -> DataFrame:
    """(key, ends_sha256) of a written table (key, conv_id) of distinct rows."""
    order = ["key", "conv_id"]
    schema = "key binary, ends_sha256 string, no int, first long, ids binary"
    some = work.table(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_end_digests), schema), "end-pieces")
    met = some.where("ids is not null").select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first")
    return some.where("ids is null").select("key", "ends_sha256").unionByName(met.mapInArrow(tidy(_join_pieces), "key binary, ends_sha256 string"))


def chain_sums(chains: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, leaves, saved): of each chain with all chains that hang from it, directly or not, from a table (conv_id, up,
    leaves, saved). The reach doubles: a round adds each chain's sums to the chain 2**i places above it."""
    now, reach = work.table(chains.select("conv_id", "up", "leaves", "saved"), "reach-0"), 0
    while not (lift := now.where("up is not null")).isEmpty():
        more = lift.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("leaves_"), F.sum("saved").alias("saved_"))
        far = lift.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        far = lift.select("conv_id", "up").join(far.hint("merge"), "up").select("conv_id", "next")
        out = now.join(more.hint("merge"), "conv_id", "left").join(far.hint("merge"), "conv_id", "left")
        out = out.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("leaves_", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("saved_", F.lit(0))).alias("saved"))
        reach += 1
        now = work.table(out, f"reach-{reach}")
    return now.select("conv_id", "leaves", "saved")


def subtree_sums(nodes: DataFrame, work: Scratch) -> DataFrame:
    """(key, leaves, saved): sums over the subtree of each node of a written table (key, conv_id, depth, parent_conv_id, leaf,
    saving) without the root."""
    top = F.min(F.struct("depth", "parent_conv_id")).alias("top")
    chains = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"), top)
    chains = work.table(chains.select("conv_id", F.when(F.col("top.depth") > 1, F.col("top.parent_conv_id")).alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"), "chains")
    whole = chains.select("conv_id", "up", "at").where("up is not null").join(chain_sums(chains, work).hint("merge"), "conv_id")
    hung = whole.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves_"), F.sum("saved").alias("saved_"))
    both = nodes.select("key", "conv_id", "depth", "leaf", "saving").join(hung.hint("merge"), ["conv_id", "depth"], "left")
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    return both.select("key", *(F.sum(F.col(own) + F.coalesce(more, F.lit(0))).over(down).alias(name) for own, more, name in (("leaf", "leaves_", "leaves"), ("saving", "saved_", "saved"))))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (of the ids of the members that end there)."""
    spark = conversations.sparkSession
    prepare(spark)
    work = Scratch(spark, "trie")
    conv = F.col("conv_id").cast("long")
    rows = pick(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    rows = rows.select((conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "role", "text")
    parts = work.table(rows.select("family", "conv_id", "role", "text").mapInArrow(tidy(_families), _NODES), "families")

    merged = parts.where(~F.col("ends")).groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    merged = work.table(merged, "merged")
    kids = merged.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(kids.hint("merge"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = work.table(nodes, "nodes")

    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = work.table(nodes.join(parents.hint("merge"), "parent", "left"), "linked")

    sums = subtree_sums(nodes.where("depth > 0"), work)
    whole = nodes.where("depth > 0 or leaf = 1").agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved")).where("leaves is not null")
    sums = sums.unionByName(whole.select(F.lit(ROOT).alias("key"), "leaves", "saved"))
    ends = end_digests(work.table(parts.where("ends").select("key", "conv_id"), "ends"), work)
    out = nodes.join(sums.hint("merge"), "key").join(ends.hint("merge"), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
