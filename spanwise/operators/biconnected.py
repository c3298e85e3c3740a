"""Cut nodes of a graph and what lies behind them, in rounds over tables.

What a node cuts off follows from the biconnected blocks of its edges: two neighbours of a
node stay connected without it if and only if their edges to it are in one block. Blocks
are found without a depth-first search, after Tarjan and Vishkin:

1. A spanning forest: every tree takes its first edge to another tree, trees so joined are
   relabelled by pointer doubling, and the edges between them are kept once. The trees at
   least halve with each round.
2. A tour of each tree along both directions of its edges: an arc's successor is the next
   arc of the node that it reaches, in a fixed order. Places in the tour come from pointer
   doubling, so a node's descendants are those whose place lies in the node's own range.
3. The least and greatest place that edges outside the tree reach from each range, by sums
   over dyadic blocks of places: a range is cut into few blocks, each of which is known.
4. Edges that must share a block are linked, and the components of those links are the blocks.

Components of few edges, most in a network that is not one whole, are searched each by itself in one
task instead; the rounds are for the others.

Every step is a join or an aggregate on a node, an arc or a block of places; rounds grow with
the logarithm of the longest tour, not with the number of cut nodes, and each round's table
is written, so that a lost executor costs a re-read.

A region is described by ranges of places, never by a list of its nodes: on a chain these lists
would grow with the square of its length. ``region_nodes`` lists the nodes of the regions that
are still wanted after their sizes and sums are known. Where only the nodes of regions without a protected
node are wanted, ``unprotected_nodes`` lists them in the task that searches their component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage, discard, drop_shuffles
from .graph import connected_components

Cut = Callable[[DataFrame], DataFrame]
#: Rounds of any one loop; 2^64 nodes need 64.
ROUNDS = 64
#: Edges of a component that is searched in one task.
SMALL = 100_000
#: Parts of all nodes that ``unprotected_nodes`` searches for shared ones, one after the other, so that only one's rows are shuffled at once.
SLICES = 2
#: Rows of regions that such a task holds before it hands them on, or one region's.
LISTED = 1 << 16


def simple_edges(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(a, b) with a < b, each once; no loops, no null ends."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    return edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def spanning_forest(edges: DataFrame, cut: Cut = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """Tree edges (a, b) of simple edges (a, b), and (node, root) with one root for each tree, its least node."""
    cur = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b")
    label = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    trees = []
    for _ in range(ROUNDS):
        both = cur.unionByName(cur.select(F.col("y").alias("x"), F.col("x").alias("y"), "a", "b"))
        # The first edge of each tree in one order of all edges, so that trees hook in pairs at most.
        hook = cut(both.groupBy("x").agg(F.min(F.struct("a", "b", "y")).alias("e")).select("x", "e.a", "e.b", "e.y"))
        if hook.isEmpty():
            discard(hook)
            break
        trees.append(cut(hook.select("a", "b").distinct()))
        back = hook.select(F.col("x").alias("y"), F.col("y").alias("_of"))
        up = cut(hook.join(back, "y").select(F.col("x").alias("node"), F.when((F.col("_of") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("root")))
        discard(hook)
        up = _to_roots(up, cut)
        name = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        new = label.join(name("root"), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
        joined = cur.join(name("x"), "x").join(name("y"), "y").where("_x != _y")
        less = joined.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), "a", "b")
        cur_new = cut(less.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("e")).select("x", "y", "e.a", "e.b"))
        label_new = cut(new)
        discard(cur, label, up)
        cur, label = cur_new, label_new
    else:
        raise RuntimeError("the forest did not settle")
    least = label.groupBy("root").agg(F.min("node").alias("_least"))
    label_new = cut(label.join(least, "root").select("node", F.col("_least").alias("root")))
    forest = trees[0] if trees else edges
    for t in trees[1:]:
        forest = forest.unionByName(t)
    forest = cut(forest)
    discard(cur, label, *trees)
    return forest, label_new


def _to_roots(up: DataFrame, cut: Cut) -> DataFrame:
    """Pointers (node, root) followed to their ends, which point at themselves."""
    for _ in range(ROUNDS):
        nxt = up.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        new = cut(up.select("node", "root").join(nxt, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        discard(up)
        up = new
        if new.where("_moved").isEmpty():
            return up
    raise RuntimeError("pointers did not settle")


def tours(forest: DataFrame, label: DataFrame, first: DataFrame | None = None, cut: Cut = cut_lineage) -> DataFrame:
    """(root, node, parent, first, last): each node's range of places in a tour of its tree; the root's parent is null.

    A tree is rooted at its least node in ``first`` (node), or else its least node.
    """
    wanted = label.join(first.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_semi") if first is not None else label.limit(0)
    # "root" names the tree from here on.
    starts = label.groupBy("root").agg(F.count("*").alias("n")).join(wanted.groupBy("root").agg(F.min("node").alias("_w")), "root", "left").select("root", "n", F.coalesce("_w", "root").alias("start"))
    starts = cut(starts)
    arcs = forest.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(forest.select(F.col("b").alias("x"), F.col("a").alias("y")))
    # The next neighbour of x after y in a fixed order, the first after the last; ranges by hash keep a hub's neighbours apart.
    succ = _next_neighbour(arcs, cut)
    end = starts.select(F.col("start").alias("y"), F.lit(True).alias("_is_start"))
    heads = succ.groupBy(F.col("x").alias("y")).agg(F.min(F.struct("place", "y")).getField("y").alias("_head"))
    # Arc (x, y) goes on as (y, next of x around y). The tour ends where it would begin again.
    step = arcs.join(succ.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("next").alias("z")), ["x", "y"])
    step = step.join(heads.join(end, "y").select("y", "_head"), "y", "left").select("x", "y", F.when(F.col("_head").isNotNull() & (F.col("z") == F.col("_head")), F.lit(None)).otherwise(F.col("z")).alias("z"))
    # (x, y) then (y, z): steps left until the end, doubled in each round; rows that have reached the end only wait.
    rank = cut(step.select("x", "y", F.when(F.col("z").isNotNull(), F.col("y")).alias("nx"), F.col("z").alias("ny"), F.when(F.col("z").isNull(), 0).otherwise(1).cast("long").alias("left")))
    for _ in range(ROUNDS):
        going = rank.where("nx is not null")
        if going.isEmpty():
            break
        ahead = rank.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), F.col("left").alias("_l"))
        moved = going.join(ahead, ["nx", "ny"]).select("x", "y", F.col("_nx").alias("nx"), F.col("_ny").alias("ny"), (F.col("left") + F.col("_l")).alias("left"))
        new = cut(rank.where("nx is null").unionByName(moved))
        discard(rank)
        rank = new
    else:
        raise RuntimeError("the tour did not settle")
    down = rank.select("x", "y", "left").join(rank.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("left").alias("_back")), ["x", "y"]).where(F.col("left") > F.col("_back"))
    # 2 (n - 1) arcs: the place of an arc is that number less the steps left from it; the start has place 0.
    named = down.join(label.select(F.col("node").alias("y"), "root"), "y").join(starts.select("root", "n"), "root")
    total = 2 * (F.col("n") - 1)
    inner = named.select("root", F.col("y").alias("node"), F.col("x").alias("parent"), (total - F.col("left")).alias("first"), (total - F.col("_back") - 1).alias("last"))
    roots = starts.select("root", F.col("start").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("first"), (2 * (F.col("n") - 1)).cast("long").alias("last"))
    out = cut(inner.unionByName(roots))
    discard(rank, starts)
    return out


def _next_neighbour(arcs: DataFrame, cut: Cut) -> DataFrame:
    """(x, y, next, place): the neighbours of each node in a circle, in the order of (range of y's hash, y).

    Each range is ordered by itself; a range's last neighbour is followed by the first of the
    node's next range that has one. So no task orders all neighbours of a hub.
    """
    arcs = arcs.withColumn("_r", F.pmod(F.xxhash64("y"), F.lit(256)))
    w = Window.partitionBy("x", "_r").orderBy("y")
    inside = cut(arcs.withColumn("_n", F.lead("y").over(w)))
    ranges = inside.groupBy("x", "_r").agg(F.min("y").alias("_first"))
    around = Window.partitionBy("x").orderBy("_r")  # 256 rows of a node at most
    whole = Window.partitionBy("x").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ranges.select("x", "_r", F.coalesce(F.lead("_first").over(around), F.first("_first").over(whole)).alias("_after"))
    return inside.join(after, ["x", "_r"]).select("x", "y", F.coalesce("_n", "_after").alias("next"), F.struct("_r", "y").alias("place"))


def _dyadic(first: str, end: str) -> str:
    """SQL of the blocks (level, number) that make up the places from ``first`` to before ``end``: two of each level at most."""
    top = f"cast(log2(greatest({end} - {first}, 1)) as int)"
    lo, hi = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    low = f"if({lo} < {hi} and {lo} % 2 = 1, array(struct(k as level, {lo} as block)), array())"
    high = f"if({lo} < {hi} and {hi} % 2 = 1, array(struct(k as level, {hi} - 1 as block)), array())"
    return f"flatten(transform(sequence(0, {top} + 1), k -> concat({low}, {high})))"


def range_sums(values: DataFrame, ranges: DataFrame, group: str, place: str, first: str, last: str, aggregates: dict[str, Callable], keys: Sequence[str]) -> DataFrame:
    """For each range (keys, group, first, last): the aggregates of the values whose place lies in it.

    ``aggregates`` maps a column of ``values`` to an aggregate that can be taken of its own results,
    as sums, least and greatest values can. Values go up to a level that covers the longest
    range; each is counted where it is read before it is shuffled.
    """
    longest = ranges.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length())))
    blocks = values.select(F.col(group).alias("_g"), place, *aggregates, levels.alias("_k")).groupBy("_g", F.col("_k").alias("_level"), F.expr(f"shiftright(`{place}`, _k)").alias("_block")).agg(*(f(F.col(c)).alias(c) for c, f in aggregates.items()))
    cut = ranges.select(*keys, F.col(group).alias("_g"), F.explode(F.expr(_dyadic(f"`{first}`", f"(`{last}` + 1)"))).alias("_b")).select(*keys, "_g", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    return cut.join(blocks, ["_g", "_level", "_block"]).groupBy(*keys).agg(*(f(F.col(c)).alias(c) for c, f in aggregates.items()))


@dataclass
class Blocks:
    """A graph's simple edges, its nodes with their ranges and sums of what lies below them, and the block of each node's edge to its parent."""

    edges: DataFrame
    nodes: DataFrame


def _measures(label: DataFrame, held: DataFrame, layers: DataFrame | None, sums: Sequence[str]) -> DataFrame:
    """(root, node, protected, sums): what each node has of its own."""
    own = label.join(held.withColumn("protected", F.lit(1).cast("long")), "node", "left")
    if layers is not None:
        own = own.join(layers.groupBy(F.col("node").cast("long").alias("node")).agg(*(F.sum(c).alias(c) for c in sums)), "node", "left")
    return own.select("root", "node", F.coalesce("protected", F.lit(0)).cast("long").alias("protected"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums))


def _in_tasks(edge: DataFrame, own: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The nodes of ``Blocks`` of edges (root, a, b) and nodes (root, node, protected, sums), by a depth-first search of each component."""
    measures = ["protected", *sums]
    rows = own.select("root", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), *measures)
    rows = rows.unionByName(edge.select("root", "a", "b", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in measures)))
    spark = edge.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts, "root").sortWithinPartitions("root", F.col("b").isNotNull())
    whole = ["root", "node", "parent", "first", "last", "low", "high", "block"]
    names = [*whole, "own_protected", *(f"own_{c}" for c in sums), *measures]
    kinds = [pa.int64()] * 9 + [pa.float64()] * len(sums) + [pa.int64()] + [pa.float64()] * len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, adj, has, found = None, {}, {}, []

        def out():
            columns = zip(*found) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for root, a, b, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if root != now:
                    found += _searched(now, adj, has)
                    now, adj, has = root, {}, {}
                    if len(found) >= 8192:
                        yield out()
                        found.clear()
                if b is None:
                    has[a] = values
                else:
                    adj.setdefault(a, []).append(b)
                    adj.setdefault(b, []).append(a)
        found += _searched(now, adj, has)
        yield out()

    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'double'}" for n, k in zip(names, kinds))
    order = ["root", "node", "parent", "first", "last", "own_protected", *(f"own_{c}" for c in sums), "low", "high", *measures, "block"]
    return dealt.mapInArrow(run, schema).select(*order)


def _searched(root: int, adj: dict[int, list[int]], has: dict[int, list]) -> list[tuple]:
    """A row for each node of one component, rooted at its least protected node, or else its least one."""
    if not has:
        return []
    start = min((n for n, v in has.items() if v[0]), default=min(has))
    first, parent, order, last = {start: 0}, {start: None}, [start], {}
    low, high, place = {start: 0}, {start: 0}, 0
    stack = [(start, iter(adj[start]))]
    while stack:
        n, around = stack[-1]
        for m in around:
            if m not in first:
                place += 1
                first[m] = low[m] = high[m] = place
                parent[m] = n
                order.append(m)
                stack.append((m, iter(adj[m])))
                break
            if m != parent[n]:
                low[n], high[n] = min(low[n], first[m]), max(high[n], first[m])
        else:
            stack.pop()
            last[n] = place
            place += 1
            if stack:
                p = stack[-1][0]
                low[p], high[p] = min(low[p], low[n]), max(high[p], high[n])
    block: dict[int, int | None] = {start: None}
    for n in order[1:]:
        p = parent[n]
        block[n] = n if p == start or low[n] >= first[p] else block[p]
    total = {n: list(has[n]) for n in order}
    for n in reversed(order[1:]):
        up = total[parent[n]]
        for i, x in enumerate(total[n]):
            up[i] += x
    return [(root, n, parent[n], first[n], last[n], low[n], high[n], block[n], *has[n], *total[n]) for n in order]


def blocks(edges: DataFrame, protected: DataFrame, layers: DataFrame | None = None, sums: Sequence[str] = (), u: str = "u", v: str = "v", cut: Cut = cut_lineage, small: int = SMALL) -> Blocks:
    """Biconnected blocks of an undirected graph, and for each node the sums of ``sums`` (columns of ``layers``) and of protected nodes over its subtree.

    Components of at most ``small`` edges are searched each in one task, larger ones by the rounds above.
    """
    every = cut(simple_edges(edges, u, v))
    held = protected.select(F.col("node").cast("long").alias("node")).distinct()
    if small > 0:
        label = connected_components(every, cut=cut)
        edge = cut(every.join(label.select(F.col("node").alias("a"), "root"), "a").select("root", "a", "b"))
        large = cut(edge.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > small).select("root"))
        if large.isEmpty():
            own = _measures(label, held, layers, sums)
            nodes = cut(_in_tasks(edge, own, sums))
            discard(label, edge, large)
            return Blocks(every, nodes)
        own = _measures(label.join(large, "root", "left_anti"), held, layers, sums)
        few = cut(_in_tasks(edge.join(large, "root", "left_anti"), own, sums))
        rest = cut(edge.join(large, "root", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v")))
        discard(label, edge, large)
        nodes = blocks(rest, held, layers, sums, cut=cut, small=0).nodes
        return Blocks(every, few.unionByName(nodes.select(*few.columns)))
    e = every
    forest, label = spanning_forest(e, cut)
    tour = tours(forest, label, held, cut)
    at = lambda c: tour.select(F.col("node").alias(c), F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}"), F.col("parent").alias(f"p{c}"))
    placed = cut(e.join(at("a"), "a").join(at("b"), "b").withColumn("tree", F.expr("coalesce(pa = b, false) or coalesce(pb = a, false)")))
    loose = placed.where("not tree")
    reach = loose.select(F.col("a").alias("node"), F.col("fb").alias("to")).unionByName(loose.select(F.col("b").alias("node"), F.col("fa").alias("to"))).groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    own = tour.join(reach, "node", "left").join(held.withColumn("protected", F.lit(1).cast("long")), "node", "left")
    if layers is not None:
        own = own.join(layers.groupBy(F.col("node").cast("long").alias("node")).agg(*(F.sum(c).alias(c) for c in sums)), "node", "left")
    own = cut(own.select("root", "node", "parent", "first", "last", F.least("first", "low").alias("low"), F.greatest("first", "high").alias("high"), F.coalesce("protected", F.lit(0)).cast("long").alias("protected"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums)))
    how = {"low": F.min, "high": F.max, "protected": F.sum} | dict.fromkeys(sums, F.sum)
    below = range_sums(own, own.select("root", "node", "first", "last"), "root", "first", "first", "last", how, ["node"])
    full = cut(own.select("root", "node", "parent", "first", "last", F.col("protected").alias("own_protected"), *(F.col(c).alias(f"own_{c}") for c in sums)).join(below, "node"))
    inner = full.where("parent is not null").select("node", "parent", "low", "high")
    above = full.where("parent is not null").select(F.col("node").alias("parent"), F.col("first").alias("pf"), F.col("last").alias("pl"))
    through = inner.join(above, "parent").where("low < pf or high > pl").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    across = loose.where("la < fb or lb < fa").select("a", "b")
    same = connected_components(through.unionByName(across), cut=cut).withColumnRenamed("root", "block")
    nodes = cut(full.join(same, "node", "left").withColumn("block", F.when(F.col("parent").isNotNull(), F.coalesce("block", "node"))))
    discard(forest, label, tour, placed, own, full)
    return Blocks(e, nodes)


def regions(found: Blocks, gates: DataFrame | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """(gate, entry, block, up, n, protected, sums): the parts that each gate cuts off from each other, none left out.

    Gates are all cut nodes, or the nodes given, cut nodes or not. ``entry`` is the least node of the part next to
    the gate; ``up`` tells whether the part is the one towards the tree's root.
    """
    nodes = found.nodes
    measures = ["n", "protected", *sums]
    nodes = nodes.withColumn("n", ((F.col("last") - F.col("first")) / 2 + 1).cast("long")).withColumn("own_n", F.lit(1).cast("long"))
    child = nodes.where("parent is not null").select(F.col("parent").alias("gate"), "block", *measures)
    mine = nodes.select(F.col("node").alias("gate"), "root", F.col("block").alias("_own"), *(F.col(f"own_{c}").alias(f"_o{c}") for c in measures))
    down = child.join(mine.select("gate", "_own"), "gate").where("_own is null or block != _own").groupBy("gate", "block").agg(*(F.sum(c).alias(c) for c in measures))
    whole = nodes.where("parent is null").select("root", *(F.col(c).alias(f"_t{c}") for c in measures))
    off = down.groupBy("gate").agg(*(F.sum(c).alias(f"_d{c}") for c in measures))
    up = mine.where("_own is not null").join(whole, "root").join(off, "gate", "left")
    up = up.select("gate", F.col("_own").alias("block"), *((F.col(f"_t{c}") - F.col(f"_o{c}") - F.coalesce(f"_d{c}", F.lit(0))).alias(c) for c in measures))
    parts = down.withColumn("up", F.lit(False)).unionByName(up.withColumn("up", F.lit(True)))
    name = lambda c: nodes.select(F.col("node").alias(c), F.col("block").alias(f"k{c}"), F.col("first").alias(f"f{c}"))
    # An edge's block is that of its deeper end, or of either.
    e = found.edges.join(name("a"), "a").join(name("b"), "b").withColumn("block", F.expr("if(fa > fb, ka, kb)"))
    entry = e.select(F.col("a").alias("gate"), F.col("b").alias("x"), "block").unionByName(e.select(F.col("b").alias("gate"), F.col("a").alias("x"), "block")).groupBy("gate", "block").agg(F.min("x").alias("entry"))
    out = parts.join(entry, ["gate", "block"]).select("gate", "entry", "block", "up", *measures)
    if gates is not None:
        return out.join(gates.select(F.col("node").cast("long").alias("gate")).distinct(), "gate", "left_semi")
    return out.join(out.groupBy("gate").agg(F.count("*").alias("_k")).where("_k > 1").select("gate"), "gate", "left_semi")


def region_nodes(found: Blocks, wanted: DataFrame) -> DataFrame:
    """(gate, entry, node) of the regions in ``wanted``, rows of ``regions``; as many rows as they have nodes."""
    nodes = found.nodes
    places = nodes.select("root", "first", "node")
    kids = nodes.where("parent is not null").select("root", F.col("parent").alias("gate"), F.col("block"), F.col("first").alias("_f"), F.col("last").alias("_l"))
    down = wanted.where("not up").select("gate", "entry", "block").join(kids, ["gate", "block"]).select("root", "gate", "entry", F.explode(F.sequence("_f", "_l")).alias("first"))
    below = down.join(places, ["root", "first"]).select("gate", "entry", "node")
    # Towards the root: the tree less the gate and what hangs from it by other blocks.
    up = wanted.where("up").select("gate", "entry", "block").join(nodes.select(F.col("node").alias("gate"), "root", F.col("first").alias("_gf")), "gate")
    tree = up.join(nodes.select("root", "node", "first"), "root").where("node != gate").select("gate", "entry", "node", "root", "first")
    hanging = up.select("gate", F.col("block").alias("_up")).join(kids, "gate").where("block != _up").select("root", "gate", F.explode(F.sequence("_f", "_l")).alias("first"))
    return below.unionByName(tree.join(hanging, ["root", "gate", "first"], "left_anti").select("gate", "entry", "node"))


def unprotected_nodes(edges: DataFrame, members: DataFrame, cut: Cut = cut_lineage, small: int = SMALL) -> DataFrame:
    """(gate, entry, node) of the parts without a protected node that cut nodes cut off: ``region_nodes`` of those ``regions``.

    Edges (way, u, v) belong to ways, which have numbers; members (way, node, protected) name all nodes of each way, which
    its edges connect, and are as many as there are or more. A node is protected if any of its rows is.

    Components are those of ways that share a node, so what is labelled are the ways and not the nodes. Each edge
    is dealt out by its way's label and written once; the task that gets a component lists the regions itself, so
    neither they nor their nodes are shuffled. Components of more than ``small`` edges go by ``blocks``.
    """
    members = members.where("node is not null")
    links = []
    for k in range(SLICES):
        some = members.where(F.pmod(F.xxhash64("node"), F.lit(SLICES)) == k).select("node", "way")
        shared = some.groupBy("node").agg(F.min("way").alias("_first"), F.max("way").alias("_last")).where("_first < _last").select("node", "_first")
        links.append(cut(some.join(shared, "node").where("way != _first").select("way", "_first")))
        drop_shuffles(edges.sparkSession)
    label = connected_components(reduce(DataFrame.unionByName, links), "way", "_first", cut=cut)
    discard(*links)
    drop_shuffles(edges.sparkSession)
    named = label.select(F.col("node").alias("way"), "root")
    rooted = lambda df: df.join(named, "way", "left").select(F.coalesce("root", "way").alias("root"), "a", "b")
    held = members.where("protected").select("way", F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
    ends = edges.where("u != v").select("way", F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"))
    dealt = cut(rooted(ends).unionByName(rooted(held)))
    discard(label)
    drop_shuffles(edges.sparkSession)
    large = cut(dealt.where("b is not null").groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > small).select("root"))
    if large.isEmpty():
        discard(large)
        return _listed(dealt)
    rest = dealt.join(large, "root", "left_semi")
    found = blocks(rest.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), rest.where("b is null").select(F.col("a").alias("node")), cut=cut, small=0)
    return _listed(dealt.join(large, "root", "left_anti")).unionByName(region_nodes(found, regions(found).where("protected = 0")))


def _listed(dealt: DataFrame) -> DataFrame:
    """(gate, entry, node) of ``unprotected_nodes`` from edges (root, a, b) and protected nodes (root, a, null), by a search of each component."""
    spark = dealt.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, adj, held = None, {}, set()
        gates, entries, nodes = [], [], []

        def out():
            full = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (gates, entries, nodes)], names=["gate", "entry", "node"])
            for c in (gates, entries, nodes):
                c.clear()
            return full

        def searched():
            for gate, entry, part in _cut_off(adj, held):
                gates.extend([gate] * len(part))
                entries.extend([entry] * len(part))
                nodes.extend(part)
                if len(nodes) >= LISTED:
                    yield out()

        for batch in batches:
            for root, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if root != now:
                    yield from searched()
                    now, adj, held = root, {}, set()
                if b is None:
                    held.add(a)
                else:
                    adj.setdefault(a, set()).add(b)
                    adj.setdefault(b, set()).add(a)
        yield from searched()
        yield out()

    return dealt.repartition(parts, "root").sortWithinPartitions("root").mapInArrow(run, "gate long, entry long, node long")


def _cut_off(adj: dict[int, set[int]], held: set[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(gate, entry, nodes) of each part without a held node that a cut node cuts off.

    A search starts at a held node where its component has one, so the part towards the start is wanted only where none is held.
    """
    first, last, low, parent, order, before = {}, {}, {}, {}, [], [0]

    def reach(n, by):
        first[n] = low[n] = len(order)
        parent[n] = by
        order.append(n)
        before.append(before[-1] + (n in held))
        return n, iter(adj[n])

    for start in (*(n for n in held if n in adj), *adj):
        if start in first:
            continue
        base, stack, kids = len(order), [reach(start, None)], {}
        while stack:
            n, around = stack[-1]
            for m in around:
                if m not in first:
                    stack.append(reach(m, n))
                    break
                if m != parent[n] and first[m] < low[n]:
                    low[n] = first[m]
            else:
                stack.pop()
                last[n] = len(order)
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[n])
                    if low[n] >= first[p]:
                        kids.setdefault(p, []).append(n)
        for gate, below in kids.items():
            if gate == start and len(below) == 1:
                continue
            froms, least, up = [first[c] for c in below], [None] * len(below), None
            for m in adj[gate]:
                i = bisect_right(froms, first[m]) - 1
                if i >= 0 and first[m] < last[below[i]]:
                    least[i] = m if least[i] is None else min(least[i], m)
                else:
                    up = m if up is None else min(up, m)
            for c, entry in zip(below, least):
                if before[last[c]] == before[first[c]]:
                    yield gate, entry, order[first[c] : last[c]]
            if gate != start and before[-1] == before[base]:
                part, at = order[base : first[gate]], first[gate] + 1
                for c in below:
                    part += order[at : first[c]]
                    at = last[c]
                yield gate, up, part + order[at:]
