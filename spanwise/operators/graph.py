"""Graphs as tables of edges: cheapest edges, components, shortest paths, random path incidence."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage, discard

#: Edges of a graph that is sent to every worker for path searches.
MAX_EDGES = 5_000_000
#: Edges of components that one task settles.
SMALL = 200_000
#: Gates that regions are looked for behind, one plan for each.
MAX_GATES = 10_000


def cheapest_edges(edges: DataFrame, u: str, v: str, cost: str) -> DataFrame:
    """One edge for each ordered pair of different nodes, its cost the least."""
    return edges.where(F.col(u) != F.col(v)).groupBy(u, v).agg(F.min(cost).alias(cost))


def degrees(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, out, in)."""
    o = edges.select(F.col(u).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    i = edges.select(F.col(v).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return o.unionByName(i).groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64, cut=None, small: int = SMALL) -> DataFrame:
    """(node, root): each node that has an edge to another, with the least node of its component.

    In each round every node points at the neighbour of the least hash, so that pointers end in pairs; what a pair draws in
    becomes one node, and edges between such nodes are kept once. Nodes at least halve, so rounds grow with
    the logarithm of the nodes, whatever the length of paths. At most ``small`` edges that are left are settled in one task.
    ``cut`` (such as ``DataFrame.checkpoint``) ends the lineage of each round; without it each round is a table in the
    shared folder, deleted when it has been used. Raises RuntimeError if it has not settled.
    """
    cut = cut or cut_lineage
    x, y = F.col(a), F.col(b)
    cur = cut(edges.where(x != y).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct())
    maps = []
    for _ in range(rounds):
        if cur.limit(small + 1).count() <= small:
            last = cut(_joined(cur))
            break
        both = cur.unionByName(cur.select(F.col("y").alias("x"), F.col("x").alias("y")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        up = cut(both.groupBy(F.col("x").alias("node")).agg(F.min(order("y"))["n"].alias("root")))
        # Of two that point at each other one stays.
        back = up.select(F.col("node").alias("root"), F.col("root").alias("_b"))
        first = cut(up.join(back, "root").select("node", F.when((F.col("_b") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root")).alias("root")))
        discard(up)
        top = _to_ends(first, cut)
        name = lambda c: top.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        joined = cur.join(name("x"), "x").join(name("y"), "y").where("_x != _y")
        new = cut(joined.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).distinct())
        discard(cur)
        cur = new
        maps.append(top)
    else:
        raise RuntimeError("components did not settle")
    label = last
    for top in reversed(maps):
        # What is a node of a later round's table is renamed by it, all others keep the end of their pointers.
        later = label.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        new = cut(top.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root")))
        discard(label, top)
        label = new
    least = label.groupBy("root").agg(F.min("node").alias("_least"))
    out = cut(label.join(least, "root").select("node", F.col("_least").alias("root")))
    discard(cur, label)
    return out


def _to_ends(up: DataFrame, cut) -> DataFrame:
    """Pointers (node, root) followed to their ends, which point at themselves."""
    for _ in range(64):
        nxt = up.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        new = cut(up.select("node", "root").join(nxt, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        discard(up)
        up = new
        if up.where("_moved").isEmpty():
            return up
    raise RuntimeError("pointers did not settle")


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (x, y), in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        nodes, at = np.unique(np.concatenate([f[["x", "y"]].to_numpy() for f in frames]), return_inverse=True)
        top = list(range(len(nodes)))
        for i, j in at.reshape(-1, 2).tolist():
            while top[i] != i:
                top[i] = i = top[top[i]]
            while top[j] != j:
                top[j] = j = top[top[j]]
            if i != j:
                top[max(i, j)] = min(i, j)
        for i in range(len(top)):  # a node points at none above it
            top[i] = top[top[i]]
        yield pd.DataFrame({"node": nodes, "root": nodes[np.array(top, np.int64)]})

    kind = edges.schema["x"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def hops_within(edges: DataFrame, sources: DataFrame, bound: int, u: str = "u", v: str = "v", cost: str = "cost") -> DataFrame:
    """(source, node, dist): least cost over at most ``bound`` edges, by relaxation; one aggregate a round."""
    best = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    e = edges.select(F.col(u).alias("node"), F.col(v).alias("_to"), F.col(cost).cast("double").alias("_c"))
    for _ in range(bound):
        step = best.join(e, "node").select("source", F.col("_to").alias("node"), (F.col("dist") + F.col("_c")).alias("dist"))
        best = best.unionByName(step).groupBy("source", "node").agg(F.min("dist").alias("dist"))
    return best


class _Graph:
    def __init__(self, u: np.ndarray, v: np.ndarray, cost: np.ndarray, link: np.ndarray):
        self.nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        s, self.to = at[: len(u)], at[len(u) :]
        order = np.argsort(s, kind="stable")
        self.to, self.cost, self.link = self.to[order], cost[order], link[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(self.nodes)))))

    def index(self, node) -> int | None:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else None

    def search(self, source: int, cost: np.ndarray):
        """Distances, and the edge by which each node is reached."""
        dist, by, prev = {source: 0.0}, {}, {}
        heap, done = [(0.0, source)], set()
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            for e in range(self.first[n], self.first[n + 1]):
                m, x = int(self.to[e]), d + cost[e]
                if x < dist.get(m, np.inf):
                    dist[m], by[m], prev[m] = x, e, n
                    heapq.heappush(heap, (x, m))
        return dist, by, prev

    def path(self, target: int, by: dict, prev: dict) -> list[int]:
        out = []
        while target in by:
            out.append(by[target])
            target = prev[target]
        return out[::-1]


def _shared_graph(edges: DataFrame, u: str, v: str, cost: str, link: str):
    n = edges.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges; path searches take at most {MAX_EDGES}")
    rows = edges.select(F.col(u).cast("long"), F.col(v).cast("long"), F.col(cost).cast("double"), F.col(link).cast("long")).toPandas().to_numpy()
    g = _Graph(rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2].astype(float), rows[:, 3].astype(np.int64))
    return edges.sparkSession.sparkContext.broadcast(g)


def shortest_paths(edges: DataFrame, pairs: DataFrame, u: str = "u", v: str = "v", cost: str = "cost", link: str = "link_id") -> DataFrame:
    """(src, dst, dist, links) of each pair that is connected; one search for each source in a batch.

    The graph (at most MAX_EDGES) is broadcast, sources are dealt out.
    """
    shared = _shared_graph(edges, u, v, cost, link)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            out = []
            for s, own in b.groupby("src")["dst"]:
                if (i := g.index(s)) is None:
                    continue
                dist, by, prev = g.search(i, g.cost)
                for d in own:
                    if (j := g.index(d)) is not None and j in dist:
                        out.append((s, d, dist[j], [int(g.link[e]) for e in g.path(j, by, prev)]))
            yield pd.DataFrame(out, columns=["src", "dst", "dist", "links"])

    dealt = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).repartition("src").sortWithinPartitions("src", "dst")
    return dealt.mapInPandas(run, "src long, dst long, dist double, links array<long>")


def random_path_incidence(edges: DataFrame, pairs: DataFrame, passes: int = 25, variation: float = 0.3, seed: int = 1, u: str = "u", v: str = "v", cost: str = "cost", link: str = "link_id") -> DataFrame:
    """(src, dst, dist, link, weight): mean unperturbed cost over passes with randomly perturbed edges, and the
    share of passes that use each link. A pass's noise depends on the seed, the pass and the edge alone."""
    shared = _shared_graph(edges, u, v, cost, link)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            out = []
            for (k, s), own in b.groupby(["pass", "src"])["dst"]:
                if (i := g.index(s)) is None:
                    continue
                noise = np.random.default_rng([seed, int(k)]).standard_normal(len(g.cost))
                _, by, prev = g.search(i, g.cost * np.exp(variation * noise))
                for d in own:
                    j = g.index(d)
                    if j is not None and (j in by or j == i):
                        way = g.path(j, by, prev)
                        total = float(g.cost[way].sum()) if way else 0.0
                        out += [(s, d, total, int(g.link[e])) for e in way]
            yield pd.DataFrame(out, columns=["src", "dst", "cost", "link"])

    grid = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    hits = grid.repartition("src", "pass").sortWithinPartitions("pass", "src", "dst").mapInPandas(run, "src long, dst long, cost double, link long")
    by_link = hits.groupBy("src", "dst", "link").agg((F.count("*") / F.lit(float(passes))).alias("weight"), F.avg("cost").alias("dist"))
    return by_link.select("src", "dst", "dist", "link", "weight")


def collapse(nodes: DataFrame, mapping: DataFrame, extensive: list[str], intensive: list[str], weight: str, node: str = "node") -> DataFrame:
    """Nodes merged by (node, into): extensive layers summed, intensive ones averaged by weight."""
    j = nodes.join(mapping, node, "left").withColumn("into", F.coalesce("into", node))
    w = F.col(weight)
    means = [F.when(F.sum(w) > 0, F.sum(F.col(c) * w) / F.sum(w)).otherwise(F.avg(c)).alias(c) for c in intensive]
    return j.groupBy(F.col("into").alias(node)).agg(*(F.sum(c).alias(c) for c in extensive), *means)


def articulation_points(edges: list[tuple[int, int]]) -> set[int]:
    """Nodes whose loss disconnects an undirected graph; for graphs that fit the driver."""
    adj: dict[int, list[int]] = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, []).append(b)
            adj.setdefault(b, []).append(a)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    found: set[int] = set()
    for root in adj:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, kids = [(root, None, iter(adj[root]))], 0
        while stack:
            n, up, it = stack[-1]
            m = next(it, None)
            if m is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[n])
                    if p != root and low[n] >= order[p]:
                        found.add(p)
            elif m not in order:
                order[m] = low[m] = len(order)
                kids += n == root
                stack.append((m, n, iter(adj[m])))
            elif m != up:
                low[n] = min(low[n], order[m])
        if kids > 1:
            found.add(root)
    return found


def edit(nodes: DataFrame, edges: DataFrame, drop: DataFrame | None = None, overrides: DataFrame | None = None, extra: DataFrame | None = None, node: str = "node", u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """A graph without the nodes to drop and their edges, with edge columns overridden by (u, v), and with extra edges."""
    columns = edges.columns
    if drop is not None:
        nodes = nodes.join(drop.select(node), node, "left_anti")
        for end in (u, v):
            edges = edges.join(drop.select(F.col(node).alias(end)), end, "left_anti").select(*columns)
    if overrides is not None:
        from .relational import override

        edges = override(edges, overrides, [u, v], [c for c in overrides.columns if c not in (u, v)])
    if extra is not None:
        edges = edges.unionByName(extra, allowMissingColumns=True)
    return nodes, edges


def dead_end_edges(edges: DataFrame, absorbed: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges to an absorbed terminus, one with a single way in and out, from a node that stays."""
    d = degrees(edges, u, v).where((F.col("out") <= 1) & (F.col("in") <= 1)).join(absorbed.select("node"), "node", "left_semi").select(F.col("node").alias(v))
    return edges.join(d, v, "left_semi").join(absorbed.select(F.col("node").alias(u)), u, "left_anti")


def regions_behind(edges: DataFrame, gates: DataFrame, protected: DataFrame, cut=None, u: str = "u", v: str = "v") -> DataFrame:
    """(gate, root, node): for each gate, the components of the graph without it that hold no protected node."""
    out = None
    found = gates.select("node").distinct().orderBy("node").limit(MAX_GATES + 1).collect()
    if len(found) > MAX_GATES:
        raise ValueError(f"more than {MAX_GATES} gates")
    for g in [r["node"] for r in found]:
        comp = connected_components(edges.where((F.col(u) != g) & (F.col(v) != g)), u, v, cut=cut)
        held = comp.join(protected.select("node"), "node", "left_semi").select("root").distinct()
        one = comp.join(held, "root", "left_anti").select(F.lit(g).alias("gate"), "root", "node")
        out = one if out is None else out.unionByName(one)
    return out


def unprotected(components: DataFrame, protected: DataFrame) -> DataFrame:
    """Rows (node, root) of the components that hold no protected node."""
    held = components.join(protected.select("node"), "node", "left_semi").select("root").distinct()
    return components.join(held, "root", "left_anti").select(*components.columns)


def virtual_pairs(pairs: DataFrame, extra: DataFrame, distance: float) -> DataFrame:
    """Routed pairs, and pairs that count in denominators only, at one distance, with a ``routed`` flag."""
    more = extra.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst").withColumn("dist", F.lit(float(distance)))
    return pairs.select("src", "dst", "dist").withColumn("routed", F.lit(True)).unionByName(more.withColumn("routed", F.lit(False)))


def touched(links: DataFrame, gone: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Links with an end in ``gone`` (node), and which: u_gone, v_gone."""
    ends = lambda c, flag: gone.select(F.col("node").alias(c)).distinct().withColumn(flag, F.lit(True))
    j = links.join(ends(u, "u_gone"), u, "left").join(ends(v, "v_gone"), v, "left")
    return j.select(*links.columns, *(F.coalesce(f, F.lit(False)).alias(f) for f in ("u_gone", "v_gone"))).where("u_gone or v_gone")


_TRIPS = pa.schema([("gate", pa.int64()), ("root", pa.int64()), ("node", pa.int64()), ("to", pa.float64()), ("back", pa.float64())])


def _distances_from(source: int, edges: dict[int, list[tuple[int, float]]]) -> dict[int, float]:
    dist, heap, done = {source: 0.0}, [(0.0, source)], set()
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for m, c in edges.get(n, ()):
            if d + c < dist.get(m, np.inf):
                dist[m] = d + c
                heapq.heappush(heap, (d + c, m))
    return dist


def _round_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (gate, root, u, v, cost), sorted, to the distances of each region's nodes from its gate and back; null if there is none.

    A batch holds many small regions; a region's edges are held until its last.
    """
    now, held = None, []

    def trips():
        on, back = {}, {}
        for u, v, c in held:
            on.setdefault(u, []).append((v, c))
            back.setdefault(v, []).append((u, c))
        there, home = _distances_from(now[0], on), _distances_from(now[0], back)
        for n in there.keys() | home.keys():
            yield (*now, n, there.get(n), home.get(n))

    out = []
    for b in batches:
        for gate, root, *edge in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4).to_numpy(zero_copy_only=False).tolist()):
            if (gate, root) != now:
                if held:
                    out += trips()
                now, held = (gate, root), []
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TRIPS)], schema=_TRIPS)
                    out = []
            held.append(edge)
    if held:
        out += trips()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TRIPS)], schema=_TRIPS)


#: Nodes of a region at least, and its demand and seconds below which it may be merged into its entrance.
LEAST_REGION, MOST_DEMAND, MOST_SECONDS = 2, 100.0, 60.0


def feasible_regions(regions: DataFrame, edges: DataFrame, nodes: DataFrame, demand: str, people: str, u: str = "u", v: str = "v", cost: str = "cost", least: int = LEAST_REGION, most_demand: float = MOST_DEMAND, most_s: float = MOST_SECONDS) -> DataFrame:
    """(gate, root, n, people, demand, to_s, from_s, most_s) of the regions (gate, root, node) that may be merged into their gate.

    A region needs ``least`` nodes, less demand than ``most_demand``, a way from the gate to every
    node and back within it, and no node ``most_s`` or farther from the gate. The times are means
    over its people, or over its nodes where nobody lives. Sizes and sums are tested before a
    region's edges are gathered; a task searches the regions dealt to it one after another, many of them in a batch.
    """
    layers = nodes.select("node", F.col(demand).alias("_d"), F.col(people).alias("_p"))
    sized = regions.join(layers, "node", "left").groupBy("gate", "root").agg(F.count("*").alias("n"), F.sum(F.coalesce("_p", F.lit(0.0))).alias("people"), F.sum(F.coalesce("_d", F.lit(0.0))).alias("demand"))
    small = sized.where((F.col("n") >= least) & (F.col("demand") < most_demand))
    held = regions.join(small.select("gate", "root"), ["gate", "root"], "left_semi")
    inside = held.select("gate", "root", "node").unionByName(held.select("gate", "root", F.col("gate").alias("node")).distinct())
    e = cheapest_edges(edges, u, v, cost).select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.col(cost).cast("double").alias("cost"))
    own = e.join(inside.select("gate", "root", F.col("node").alias("u")), "u").join(inside.select("gate", "root", F.col("node").alias("v")), ["gate", "root", "v"])

    dealt = own.select("gate", "root", "u", "v", "cost").repartition("gate", "root").sortWithinPartitions("gate", "root")
    found = dealt.mapInArrow(_round_trips, "gate long, root long, node long, to double, back double")
    both = found.join(held, ["gate", "root", "node"], "left_semi")
    w = F.coalesce("_p", F.lit(0.0))
    t = both.where("to is not null and back is not null").join(layers, "node", "left").groupBy("gate", "root").agg(
        F.count("*").alias("_k"), F.max("to").alias("most_s"), F.sum(w).alias("_w"), F.sum(w * F.col("to")).alias("_wt"), F.sum(w * F.col("back")).alias("_wb"), F.avg("to").alias("_t"), F.avg("back").alias("_b"))
    ok = small.join(t, ["gate", "root"]).where((F.col("_k") == F.col("n")) & (F.col("most_s") < most_s))
    mean = lambda s, plain: F.when(F.col("_w") > 0, F.col(s) / F.col("_w")).otherwise(F.col(plain))
    return ok.select("gate", "root", "n", "people", "demand", mean("_wt", "_t").alias("to_s"), mean("_wb", "_b").alias("from_s"), "most_s")


def maximal_regions(regions: DataFrame) -> DataFrame:
    """Of nested regions (region, node): those inside no larger one; equal ones leave the smallest id."""
    size = regions.groupBy("region").agg(F.count("*").alias("n"))
    a = regions.select("node", F.col("region").alias("a"))
    b = regions.select("node", F.col("region").alias("b"))
    shared = a.join(b, "node").where("a != b").groupBy("a", "b").agg(F.count("*").alias("k"))
    j = shared.join(size.select(F.col("region").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("region").alias("b"), F.col("n").alias("nb")), "b")
    inner = j.where((F.col("k") == F.col("na")) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))).select(F.col("a").alias("region")).distinct()
    return regions.join(inner, "region", "left_anti")


def contract_chains(edges: DataFrame, keep: DataFrame, cut=None, u: str = "u", v: str = "v", length: str = "length") -> DataFrame:
    """(u, v, length): chains of pass-through nodes (one way in, one out, not kept) as single edges."""
    d = degrees(edges, u, v)
    through = d.where((F.col("out") == 1) & (F.col("in") == 1)).join(keep.select("node"), "node", "left_anti").select("node")
    cut = cut or cut_lineage
    cur, left = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(length).cast("double").alias("length"))), cut(through)
    for _ in range(64):
        # Every other pass-through node goes in a round: those whose hash is lower than their neighbours'.
        h = lambda c: F.struct(F.xxhash64(c), c)
        t = left.select("node", F.lit(True).alias("_t"))
        nb = cur.join(t.select(F.col("node").alias("v")), "v", "left_semi").join(t.select(F.col("node").alias("u"), "_t"), "u", "left_semi")
        blocked = nb.select(F.when(h(F.col("u")) < h(F.col("v")), F.col("v")).otherwise(F.col("u")).alias("node")).where("u != v").distinct()
        loops = nb.where("u = v").select(F.col("u").alias("node"))
        go = cut(left.join(blocked, "node", "left_anti").join(loops, "node", "left_anti"))
        if go.isEmpty():
            return cur
        into = cur.join(go.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("v").alias("m"), F.col("u").alias("a"), F.col("length").alias("l1"))
        out = cur.join(go.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("length").alias("l2"))
        merged = into.join(out, "m").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("l1") + F.col("l2")).alias("length"))
        rest = cur.join(go.select(F.col("node").alias("v")), "v", "left_anti").join(go.select(F.col("node").alias("u")), "u", "left_anti")
        cur = cut(rest.unionByName(merged))
        left = cut(left.join(go, "node", "left_anti"))
    raise RuntimeError("chains did not settle")
