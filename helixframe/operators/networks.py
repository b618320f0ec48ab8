"""Measures of similarity graphs of any size: communities, shortest paths, centralities.

Graphs of up to ``IN_TASK`` links are worked on in tasks (``graphs_in_tasks``), paths by blocks of sources. Larger ones are
joins and sums over the edge table (graph, src, dst, weight), so no graph has to fit one task; what iterates there writes its
state to the shared folder and reads it again, so lineage stays short and a lost executor costs one step.
Edges count once, whatever their direction and number; loops do not count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, apart, ship
from . import graphs_in_tasks as T

#: Rows (graph, source, node) that one block of sources may have; more sources are taken block by block.
STATE_ROWS = 50_000_000
#: Links (both directions) of a graph that a task takes; the joins do any number.
IN_TASK = 4_000_000
#: Sources of a task's block for distances, and for dependencies.
REACH, DEPEND = 2048, 1024
#: Gains of modularity up to this count as none.
_NONE = 1e-9


def links_of(edges: DataFrame, work: Scratch, weighted: bool = False) -> DataFrame:
    """Both directions of every edge once: graph, src, dst, w; of repeated edges the largest weight."""
    one = edges.where("src <> dst").select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w"))
    one = one.groupBy("graph", "a", "b").agg(F.max("w").alias("w"))
    both = one.select("graph", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("x"), "w")
    return work.table(both.select("graph", "x.src", "x.dst", "w"), "links")


def _by_size(links: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The links of the graphs that tasks take, each once, and those of the others in both directions (None: there are none)."""
    one = links.where("src < dst and graph is not null")
    large = work.table(links.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > IN_TASK).select("graph"), "large")
    if large.isEmpty():
        return one, None
    return one.join(large, "graph", "left_anti"), work.table(links.join(large, "graph", "left_semi"), "large-links")


def _from_blocks(links: DataFrame, sources: DataFrame, size: int, run, schema: str) -> DataFrame:
    """``run`` on each block of about ``size`` sources (graph, id) with the links of its graph."""
    ship(links.sparkSession)
    many = sources.groupBy("graph").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    q = sources.join(many, "graph").select("graph", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    t = links.join(q.select("graph", "block").distinct(), "graph").select(F.col("graph").alias("of"), F.col("block").alias("part"), "src", "dst")
    q, t = apart(q, "graph", "block"), apart(t, "of", "part")
    return q.groupBy("graph", "block").cogroup(t.groupBy("of", "part")).applyInArrow(run, schema)


# communities


def _judged(links: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (graph, id, k, m2, c) with the best community of each node, its gain over staying, and what modularity needs.

    Ties go to the smaller label. Of two nodes that are alone only the one of the larger label may move to the other.
    """
    total = state.groupBy("graph", "c").agg(F.sum("k").alias("tot"), F.count("*").alias("many"))
    near = links.join(state.select("graph", F.col("id").alias("dst"), F.col("c").alias("to")), ["graph", "dst"])
    near = near.groupBy("graph", F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    near = near.join(total.select("graph", F.col("c").alias("to"), F.col("tot").alias("to_tot"), F.col("many").alias("to_many")), ["graph", "to"])
    own = state.join(total, ["graph", "c"])
    each = near.join(own, ["graph", "id"])
    mine = F.col("to") == F.col("c")
    value = F.col("w") - F.col("k") * F.col("to_tot") / F.col("m2")
    allowed = ~mine & ((F.col("many") > 1) | (F.col("to_many") > 1) | (F.col("to") < F.col("c")))
    best = each.groupBy("graph", "id").agg(
        F.min(F.when(allowed, F.struct((-value).alias("v"), F.col("to").alias("to")))).alias("b"),
        F.sum(F.when(mine, F.col("w")).otherwise(0.0)).alias("w_own"),
    )
    out = own.join(best, ["graph", "id"], "left").withColumn("w_own", F.coalesce("w_own", F.lit(0.0)))
    stay = F.col("w_own") - F.col("k") * (F.col("tot") - F.col("k")) / F.col("m2")
    return out.select("graph", "id", "k", "m2", "c", F.col("b.to").alias("best"), F.coalesce(-F.col("b.v") - stay, F.lit(0.0)).alias("gain"), "w_own", "tot")


def _level(links: DataFrame, start: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(graph, id, k, m2, c) after rounds in which all nodes, or a hashed part of them, move where modularity gains most.

    Nodes move at once, so a round can lose. Such a round is taken back, and half as many nodes move in the next one; after
    three halvings, or if no node gains, the level is over. Modularity rises with every round that stays.
    """
    kept, best, part, n = None, None, 1, 0
    state = start
    while True:
        judged = work.table(_judged(links, state), f"{name}-{n}")
        q, movers = judged.agg(F.sum(F.col("w_own") / F.col("m2") - F.col("k") * F.col("tot") / F.col("m2") / F.col("m2")), F.count_if(F.col("gain") > _NONE)).head()
        if kept is None or q > best + 1e-12:
            kept, best, part = judged, q, max(1, part // 2)
        else:
            part *= 2
        if part > 8 or kept is judged and not movers:
            return kept.select("graph", "id", "k", "m2", "c")
        n += 1
        moves = (F.col("gain") > _NONE) & (F.shiftright(F.xxhash64("graph", "id"), 3 * (n % 20)).bitwiseAND(F.lit(part - 1).cast("long")) == 0)
        state = kept.select("graph", "id", "k", "m2", F.when(moves, F.col("best")).otherwise(F.col("c")).alias("c"))


def communities(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(graph, id, community) by Louvain's method: local moves, then communities become the nodes of a smaller edge table,
    level by level until none moves. A community is named by its smallest id; nodes without edges are their own.

    Without ``weighted`` every edge counts 1, all sums are whole numbers and the result is the same at any partitioning.
    """
    work = Scratch(nodes.sparkSession, "communities")
    links, large = _by_size(links_of(edges, work, weighted), work)
    ship(nodes.sparkSession)
    kind = dict(links.dtypes)
    salted = links.select("*", F.xxhash64("graph", "src").alias("hash_src"), F.xxhash64("graph", "dst").alias("hash_dst"))
    known = apart(salted, "graph").groupBy("graph").applyInArrow(T.louvain(_NONE), f"graph {kind['graph']}, id {kind['src']}, community {kind['src']}")
    if large is not None:
        known = known.unionByName(_communities(large, work))
    return nodes.select("graph", "id").join(known, ["graph", "id"], "left").select("graph", "id", F.coalesce("community", "id").alias("community"))


def _communities(links: DataFrame, work: Scratch) -> DataFrame:
    """(graph, id, community) of nodes with links, by joins."""
    degree = links.groupBy("graph", F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = degree.join(degree.groupBy("graph").agg(F.sum("k").alias("m2")), "graph").withColumn("c", F.col("id"))
    labels, level = state.select("graph", "id", "c"), 0
    while True:
        moved = _level(links, work.table(state, f"state-{level}"), work, f"level-{level}")
        if moved.where("c <> id").isEmpty():
            break
        to = moved.select("graph", F.col("id").alias("c"), F.col("c").alias("next"))
        labels = work.table(labels.join(to, ["graph", "c"]).select("graph", "id", F.col("next").alias("c")), f"labels-{level}")
        a = moved.select("graph", F.col("id").alias("src"), F.col("c").alias("a"))
        b = moved.select("graph", F.col("id").alias("dst"), F.col("c").alias("b"))
        links = links.join(a, ["graph", "src"]).join(b, ["graph", "dst"]).where("a <> b").groupBy("graph", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        links = work.table(links, f"links-{level}")
        state = moved.groupBy("graph", F.col("c").alias("id")).agg(F.sum("k").alias("k"), F.first("m2").alias("m2")).withColumn("c", F.col("id"))
        level += 1
    named = labels.groupBy("graph", "c").agg(F.min("id").alias("community"))
    return labels.join(named, ["graph", "c"]).select("graph", "id", "community")


# shortest paths


def _forward(links: DataFrame, sources: DataFrame, work: Scratch, name: str) -> list[DataFrame]:
    """Breadth first from all sources at once: for each distance the rows (graph, s, v, paths) met there first, with their
    numbers of shortest paths. As edges go both ways, a step meets only rows of the last two distances again."""
    levels = [work.table(sources.select("graph", F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), f"{name}-0")]
    steps = links.select("graph", F.col("src").alias("v"), "dst")
    while True:
        met = levels[-1].join(steps, ["graph", "v"]).groupBy("graph", "s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        seen = reduce(DataFrame.unionByName, [t.select("graph", "s", "v") for t in levels[-2:]])
        front = work.table(met.join(seen, ["graph", "s", "v"], "left_anti"), f"{name}-{len(levels)}")
        if front.isEmpty():
            return levels
        levels.append(front)


def _dependencies(links: DataFrame, levels: list[DataFrame], work: Scratch, name: str) -> list[DataFrame]:
    """Brandes' back-propagation over the same rows: (graph, s, v, delta), level by level from the farthest."""
    steps = links.select("graph", F.col("src").alias("w"), F.col("dst").alias("v"))
    out, below = [], None
    for i in range(len(levels) - 1, 0, -1):
        here = levels[i]
        if below is None:
            here = here.withColumn("delta", F.lit(0.0))
        else:
            share = below.select("graph", "s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
            up = share.join(steps, ["graph", "w"]).groupBy("graph", "s", "v").agg(F.sum("share").alias("share"))
            here = here.join(up, ["graph", "s", "v"], "left").select("graph", "s", "v", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta"))
        below = work.table(here, f"{name}-back-{i}")
        out.append(below.select("graph", "s", "v", "delta"))
    return out


def _blocks(links: DataFrame, sources: DataFrame | None, work: Scratch, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes with edges, the sources, and the sources in blocks whose states have about ``most`` rows each."""
    ends = work.table(links.select("graph", F.col("src").alias("id")).distinct(), "ends")
    asked = ends if sources is None else work.table(sources.select("graph", "id").distinct().join(ends, ["graph", "id"], "left_semi"), "sources")
    sizes = ends.groupBy("graph").agg(F.count("*").alias("n")).join(asked.groupBy("graph").agg(F.count("*").alias("m")), "graph")
    rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).head()[0]
    many = max(1, -(-rows // most))
    return ends, asked, [asked.where(F.pmod(F.xxhash64("graph", "id"), F.lit(many)) == i) if many > 1 else asked for i in range(many)]


def _with_distance(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("graph", "s", "v", F.lit(i).alias("d")) for i, t in enumerate(levels)])


def path_lengths(edges: DataFrame, state_rows: int = STATE_ROWS) -> DataFrame:
    """Per graph the size, average shortest path and diameter of its largest component, exactly; of equally large ones of
    that with the smallest id. All nodes are sources: in blocks of them tasks, or joins, go on from all at once."""
    work = Scratch(edges.sparkSession, "paths")
    links, large = _by_size(links_of(edges, work), work)
    kind = dict(links.dtypes)
    ends = links.select("graph", F.explode(F.array("src", "dst")).alias("id")).distinct()
    sums = _from_blocks(links, ends, REACH, T.path_sums, f"graph {kind['graph']}, part {kind['src']}, m long, total long, far long")
    if large is not None:
        _, _, blocks = _blocks(large, None, work, state_rows)
        for i, block in enumerate(blocks):
            found = _with_distance(_forward(large, block, work, f"block-{i}"))
            own = found.groupBy("graph", "s").agg(F.count("*").alias("m"), F.sum("d").alias("total"), F.max("d").cast("long").alias("far"), F.min("v").alias("part"))
            sums = sums.unionByName(work.table(own.drop("s"), f"sources-{i}"))
    parts = sums.groupBy("graph", "part").agg(F.first("m").alias("m"), F.sum("total").alias("total"), F.max("far").alias("diameter"))
    big = parts.groupBy("graph").agg(F.min(F.struct((-F.col("m")).alias("x"), F.col("part"), F.col("m"), F.col("total"), F.col("diameter"))).alias("b"))
    pairs = F.greatest(F.lit(1), F.col("b.m") * (F.col("b.m") - 1))
    return big.select("graph", F.col("b.m").cast("int").alias("largest"), (F.col("b.total") / pairs).alias("avg_path"), F.col("b.diameter").cast("int").alias("diameter"))


def path_sketch(edges: DataFrame, lg: int = 10, share: float = 0.9) -> DataFrame:
    """Per graph, over all pairs that reach each other: estimated average path, effective diameter (the distance within which
    ``share`` of the pairs lie, interpolated) and the number of steps after which nothing new is met, which is at most the diameter.

    Each node holds a HyperLogLog sketch of 2**lg registers of the nodes within t steps; a step merges its neighbours'
    sketches into it. A sketch errs by about 1.04 / sqrt(2**lg) (3 % at 10); the work is rounds x edges, not nodes squared.
    """
    work = Scratch(edges.sparkSession, "sketches")
    links = links_of(edges, work)
    ends = links.select("graph", F.col("src").alias("id")).distinct()
    now = work.table(ends.groupBy("graph", "id").agg(F.hll_sketch_agg(F.xxhash64("id"), F.lit(lg)).alias("sketch")), "step-0")
    curve, step = [], 0
    while True:
        sums = now.groupBy("graph").agg(F.sum(F.hll_sketch_estimate("sketch")).alias("pairs"), F.count("*").alias("n"))
        curve.append(work.table(sums.withColumn("t", F.lit(step)), f"sum-{step}"))
        if step:
            grown = curve[-1].join(curve[-2].select("graph", F.col("pairs").alias("before")), "graph").where("pairs > before")
            if grown.isEmpty():
                break
        step += 1
        met = links.join(now.select("graph", F.col("id").alias("dst"), "sketch"), ["graph", "dst"]).select("graph", F.col("src").alias("id"), "sketch")
        now = work.table(met.unionByName(now).groupBy("graph", "id").agg(F.hll_union_agg("sketch").alias("sketch")), f"step-{step}")
        work.drop(f"step-{step - 1}")
    points = reduce(DataFrame.unionByName, curve)
    # at most one point a step: a graph's curve is as long as its diameter
    per = points.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("t", "pairs"))).alias("c"), F.first("n").alias("n"))
    gained = "transform(sequence(1, size(c) - 1), i -> greatest(0, c[i].pairs - c[i - 1].pairs))"
    per = per.withColumn("g", F.expr(gained)).withColumn("all", F.expr("aggregate(g, 0L, (a, x) -> a + x)"))
    per = per.withColumn("avg_path", F.expr("aggregate(transform(g, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x) / all"))
    per = per.withColumn("sums", F.expr("transform(sequence(0, size(g)), i -> aggregate(slice(g, 1, i), 0L, (a, x) -> a + x))"))
    at = F.expr(f"filter(sequence(1, size(g)), i -> sums[i] >= {float(share)!r}D * all)[0]")
    per = per.withColumn("at", at).withColumn("effective_diameter", F.expr(f"at - 1 + ({float(share)!r}D * all - sums[at - 1]) / g[at - 1]"))
    return per.select("graph", F.col("n").alias("n_nodes"), "avg_path", "effective_diameter", F.expr("size(filter(g, x -> x > 0))").alias("diameter"))


# centralities


def _ritz(depth: int):
    """Of each graph's sums of products of x, Ax, A(Ax) ... the combination that is nearest to the main eigenvector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for graph, scale, flat in zip(pdf["graph"], pdf["scale"], pdf["sums"]):
            m = np.zeros((depth + 1, depth + 1))
            m[np.triu_indices(depth + 1)] = flat
            m = m + np.triu(m, 1).T
            out.append(T.combination(m, scale, depth))
        return pd.DataFrame({"graph": pdf["graph"], "y": out})

    return run


def eigenvector(edges: DataFrame, cycles: int = 8, tolerance: float = 1e-6, depth: int = 8) -> DataFrame:
    """(graph, id, eigenvector): the main eigenvector of each graph's adjacency, of length 1, by restarted Krylov steps.

    A cycle multiplies by the adjacency ``depth`` times, each time a join and a sum, and takes the best combination of the
    products, for which a graph needs ``depth``**2 / 2 sums and no more. It ends when no entry moves by more than
    ``tolerance``, or after ``cycles``. If several components have the same main eigenvalue, each has its part of the start
    vector, which is even.
    """
    work = Scratch(edges.sparkSession, "eigen")
    return _main_vectors(*_by_size(links_of(edges, work), work), work, cycles, tolerance, depth)


def _main_vectors(links: DataFrame, large: DataFrame | None, work: Scratch, cycles: int = 8, tolerance: float = 1e-6, depth: int = 8) -> DataFrame:
    ship(links.sparkSession)
    kind = dict(links.dtypes)
    found = apart(links, "graph").groupBy("graph").applyInArrow(T.main_vector(cycles, tolerance, depth), f"graph {kind['graph']}, id {kind['src']}, eigenvector double")
    return found if large is None else found.unionByName(_eigenvector(large, work, cycles, tolerance, depth))


def _eigenvector(links: DataFrame, work: Scratch, cycles: int, tolerance: float, depth: int) -> DataFrame:
    """``eigenvector`` by joins."""
    degree = links.groupBy("graph", F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    size = degree.groupBy("graph").agg(F.max("d").alias("scale"), F.sqrt(F.count("*")).alias("n"))
    now = work.table(degree.join(size, "graph").select("graph", "id", "scale", (1 / F.col("n")).alias("x0")), "x-0")
    kind = dict(links.dtypes)["graph"]
    for n in range(1, cycles + 1):
        wide = now
        for j in range(depth):
            met = links.join(wide.select("graph", F.col("id").alias("dst"), f"x{j}"), ["graph", "dst"]).groupBy("graph", F.col("src").alias("id")).agg(F.sum(f"x{j}").alias("y"))
            wide = wide.join(met, ["graph", "id"]).select(*wide.columns, (F.col("y") / F.col("scale")).alias(f"x{j + 1}"))
            if j % 4 == 3:
                wide = work.table(wide, f"wide-{n}-{j}")
        sums = F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(depth + 1) for j in range(i, depth + 1)))
        best = wide.groupBy("graph").agg(F.first("scale").alias("scale"), sums.alias("sums"))
        best = best.mapInPandas(lambda parts: map(_ritz(depth), parts), f"graph {kind}, y array<double>")
        x = reduce(lambda a, b: a + b, (F.col("y")[j] * F.col(f"x{j}") for j in range(depth)))
        new = work.table(wide.join(best, "graph").select("graph", "id", "scale", F.col("x0").alias("old"), x.alias("x0")), f"x-{n}")
        moved = new.agg(F.max(F.abs(F.col("x0") - F.col("old")))).head()[0]
        now = new.drop("old")
        if moved is None or moved <= tolerance:
            break
    return now.select("graph", "id", F.col("x0").alias("eigenvector"))


def centralities(edges: DataFrame, sources: DataFrame | None = None, state_rows: int = STATE_ROWS) -> DataFrame:
    """Betweenness, closeness, eigenvector centrality and eccentricity of all nodes with edges.

    Paths start from all nodes, so the values are exact, at (nodes x nodes) rows of state for each graph. With ``sources``
    (graph, id) they start from those pivots only: betweenness and closeness are then estimates scaled by the pivots' share,
    and the eccentricity is the farthest pivot.
    """
    work = Scratch(edges.sparkSession, "central")
    both = links_of(edges, work)
    ends = work.table(both.where("graph is not null").select("graph", F.col("src").alias("id")).distinct(), "nodes")
    asked = ends if sources is None else work.table(sources.select("graph", "id").distinct().join(ends, ["graph", "id"], "left_semi"), "asked")
    links, large = _by_size(both, work)
    kind = dict(links.dtypes)
    small = asked if large is None else asked.join(large.select("graph").distinct(), "graph", "left_anti")
    sums = [work.table(_from_blocks(links, small, DEPEND, T.dependency_sums, f"graph {kind['graph']}, id {kind['src']}, delta double, seen long, total long, far int"), "sums")]
    if large is not None:
        sums += _dependency_sums(large, asked, work, state_rows)
    all_ = reduce(DataFrame.unionByName, sums).groupBy("graph", "id").agg(F.sum("delta").alias("delta"), F.sum("seen").alias("seen"), F.sum("total").alias("total"), F.max("far").alias("far"))
    sizes = ends.groupBy("graph").agg(F.count("*").alias("n")).join(asked.groupBy("graph").agg(F.count("*").alias("m")), "graph")
    own = asked.withColumn("pivot", F.lit(1))
    out = ends.join(sizes, "graph").join(all_, ["graph", "id"], "left").join(own, ["graph", "id"], "left").join(_main_vectors(links, large, work), ["graph", "id"])
    others = F.greatest(F.lit(1), F.col("m") - F.coalesce("pivot", F.lit(0)))
    between = F.coalesce("delta", F.lit(0.0)) * F.col("n") / F.col("m") / F.greatest(F.lit(1), (F.col("n") - 1) * (F.col("n") - 2))
    close = F.when(F.col("total") > 0, F.col("seen") / F.col("total") * (F.col("seen") / others)).otherwise(0.0)
    return out.select("graph", "id", between.alias("betweenness"), close.alias("closeness"), "eigenvector", F.coalesce("far", F.lit(0)).cast("int").alias("eccentricity"))


def _dependency_sums(links: DataFrame, sources: DataFrame, work: Scratch, state_rows: int) -> list[DataFrame]:
    """Dependencies and distances of each node summed over the sources, by joins: a table for each block of sources."""
    sums = []
    for i, block in enumerate(_blocks(links, sources, work, state_rows)[2]):
        levels = _forward(links, block, work, f"block-{i}")
        far = _with_distance(levels).where("d > 0").select("graph", "s", "v", F.col("d").alias("d"), F.lit(0.0).alias("delta"))
        parts = [far, *(t.withColumn("d", F.lit(None).cast("int")) for t in _dependencies(links, levels, work, f"block-{i}"))]
        both = reduce(DataFrame.unionByName, parts)
        sums.append(work.table(both.groupBy("graph", F.col("v").alias("id")).agg(F.sum("delta").alias("delta"), F.count("d").alias("seen"), F.sum("d").alias("total"), F.max("d").alias("far")), f"sums-{i}"))
        for j in range(len(levels)):
            work.drop(f"block-{i}-{j}")
            work.drop(f"block-{i}-back-{j}")
    return sums
