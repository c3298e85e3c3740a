"""Shortest paths over a partitioned graph: rounds of relaxation from a frontier, no graph on any one machine.

The state is a table of (source, node, distance). In each round only the rows that the last
round improved go out along their edges, a join on the node; one aggregate keeps the least
distance of each (source, node) and tells which improved. A round's table is written, so
that a lost executor costs a re-read, and the loop ends on an empty frontier: as many
rounds as the longest shortest path has edges. Which edge a node is reached by is settled
afterwards, by one join: of the edges that give its distance exactly, that of the least
link. Results so depend on neither partitions nor the order of rounds.

Keys in ``by`` tell graphs apart that share their nodes, such as the passes of a stochastic
assignment: all passes go through the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import probit_gain
from ..functions.scalar import slot_hash
from ..sources.sinks import cut_lineage, discard
from .graph import connected_components

Cut = Callable[[DataFrame], DataFrame]
#: Rounds of relaxation at most, and doublings of the steps that a walk goes back at a time.
ROUNDS, DOUBLINGS = 10_000, 3
#: Passes, edges of a path at most, and the noise's variation and its absolute size on long edges, in seconds.
PASSES, MOST_HOPS, VARIATION, SIGMA = 25, 120, 0.3, 30.0


def clean_edges(edges: DataFrame, by: Sequence[str] = (), u: str = "u", v: str = "v", cost: str = "cost", link: str = "link_id") -> DataFrame:
    """(by, u, v, cost, link) of edges between present, different nodes; ValueError unless their costs are positive numbers."""
    e = edges.select(*by, F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.col(cost).cast("double").alias("cost"), F.col(link).cast("long").alias("link")).where("u != v")
    if not e.where("cost is null or isnan(cost) or cost <= 0").isEmpty():
        raise ValueError("costs must be positive")
    return e


def within_reach(edges: DataFrame, starts: DataFrame, u: str = "u", v: str = "v", cut: Cut = cut_lineage) -> DataFrame:
    """The edges of those components, taken without direction, that hold a start (src): no path from a start leaves them.

    Rounds read all edges that they are given, so those that no start can reach are best left out first.
    """
    label = connected_components(edges, u, v, cut=cut)
    held = label.join(starts.select(F.col("src").cast("long").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    kept = label.join(held, "root", "left_semi").select(F.col("node").alias(u))
    out = cut(edges.join(kept, u, "left_semi"))
    discard(label)
    return out


def distances(edges: DataFrame, starts: DataFrame, by: Sequence[str] = (), cut: Cut = cut_lineage) -> DataFrame:
    """(by, src, node, dist) of every node that a start (by, src) reaches over edges (by, u, v, cost), itself included."""
    best = cut(starts.select(*by, F.col("src").cast("long").alias("src")).distinct().select(*by, "src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("open")))
    out = edges.select(*by, F.col("u").alias("node"), F.col("v").alias("_to"), "cost")
    for _ in range(ROUNDS):
        frontier = best.where("open")
        if frontier.isEmpty():
            return best.drop("open")
        step = frontier.join(out, [*by, "node"]).select(*by, "src", F.col("_to").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.lit(True).alias("open"))
        # Closed before open, so that a row that is met again at the same distance stays closed.
        least = best.withColumn("open", F.lit(False)).unionByName(step).groupBy(*by, "src", "node").agg(F.min(F.struct("dist", "open")).alias("_m"))
        new = cut(least.select(*by, "src", "node", "_m.dist", "_m.open"))
        discard(best)
        best = new
    raise RuntimeError(f"distances did not settle in {ROUNDS} rounds")


def tree(edges: DataFrame, dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, node, back, link): the edge that each reached node is reached by, of equal ones that of the least link."""
    at = dist.select(*by, "src", F.col("node").alias("v"), F.col("dist").alias("_dv"))
    before = dist.select(*by, "src", F.col("node").alias("u"), F.col("dist").alias("_du"))
    tight = at.join(edges, [*by, "v"]).join(before, [*by, "src", "u"]).where("_du + cost = _dv")
    return tight.groupBy(*by, "src", F.col("v").alias("node")).agg(F.min(F.struct("link", "u")).alias("_e")).select(*by, "src", "node", F.col("_e.u").alias("back"), F.col("_e.link").alias("link"))


def walks(steps: DataFrame, pairs: DataFrame, by: Sequence[str] = (), most: int | None = None, cut: Cut = cut_lineage) -> DataFrame:
    """(by, src, dst, links) of the pairs (by, src, dst) that a tree connects, by at most ``most`` links.

    A pair goes back from its end by up to 2^DOUBLINGS links a round.
    """
    jump = cut(steps.select(*by, "src", "node", "back", F.array("link").alias("links")))
    for _ in range(DOUBLINGS):
        ahead = jump.select(*by, "src", F.col("node").alias("back"), F.col("back").alias("_b"), F.col("links").alias("_l"))
        new = cut(jump.join(ahead, [*by, "src", "back"], "left").select(*by, "src", "node", F.coalesce("_b", "back").alias("back"), F.when(F.col("_l").isNotNull(), F.concat("_l", "links")).otherwise(F.col("links")).alias("links")))
        discard(jump)
        jump = new
    going = cut(pairs.select(*by, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct().withColumn("node", F.col("dst")).withColumn("links", F.array().cast("array<long>")))
    done = []
    for _ in range(ROUNDS):
        done.append(going.where("node = src"))
        left = going.where("node != src")
        if most is not None:
            left = left.where(F.size("links") < most)
        back = jump.select(*by, "src", "node", F.col("back").alias("_b"), F.col("links").alias("_l"))
        going = cut(left.join(back, [*by, "src", "node"]).select(*by, "src", "dst", F.col("_b").alias("node"), F.concat("_l", "links").alias("links")))
        if going.isEmpty():
            break
    else:
        raise RuntimeError(f"walks did not end in {ROUNDS} rounds")
    discard(jump)
    out = reduce(DataFrame.unionByName, done).select(*by, "src", "dst", "links")
    return out if most is None else out.where(F.size("links") <= most)


def paths(edges: DataFrame, pairs: DataFrame, cut: Cut = cut_lineage, **names: str) -> DataFrame:
    """(src, dst, dist, links) of each pair (src, dst) that is connected, links in the path's order; a pair of one node has none.

    Null nodes and loops are no edges, parallel edges count by their costs, repeated pairs as one. ``names`` are the columns
    of ``edges``: u, v, cost and link. An empty table gives an empty result.
    """
    e = cut(clean_edges(edges, **names))
    dist = distances(e, pairs, cut=cut)
    found = walks(tree(e, dist), pairs, cut=cut)
    return found.join(dist.withColumnRenamed("node", "dst"), ["src", "dst"]).select("src", "dst", "dist", "links")


def noise(seed: int, *keys: Column) -> Column:
    """A standard normal number that depends on the seed and the keys alone (Box and Muller's, from two hashes)."""
    a, b = slot_hash(*keys, F.lit("a"), seed=seed), slot_hash(*keys, F.lit("b"), seed=seed)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)


def probit_incidence(edges: DataFrame, pairs: DataFrame, passes: int = PASSES, variation: float = VARIATION, sigma: float = SIGMA, most: int = MOST_HOPS, seed: int = 42, cut: Cut = cut_lineage, **names: str) -> DataFrame:
    """(src, dst, dist, link, weight): the mean cost of a pair's paths over passes, and the share of passes that take each link.

    In each pass every edge's cost is multiplied by exp(gain * variation * noise), the noise drawn once for
    each pass and link and shared by all sources; the gain damps it on long edges, where it comes to ``sigma``.
    Paths are chosen by these costs and count by the unperturbed ones. A pair without a path of at most ``most``
    links in a pass takes its unperturbed path there, whatever its length. Pairs that no path connects and pairs of one
    node have no rows.
    """
    e = cut(clean_edges(edges, **names))
    want = cut(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst").distinct())
    plain = distances(e, want, cut=cut)
    k1 = cut(walks(tree(e, plain), want, cut=cut))
    each = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    drawn = e.select("u", "v", "cost", "link", each)
    gain = probit_gain(F.lit(float(sigma)), F.lit(float(variation)), F.col("cost"))
    moved = cut(drawn.withColumn("cost", F.col("cost") * F.exp(F.lit(float(variation)) * noise(seed, F.col("pass"), F.col("link")) * gain)))
    asked = k1.select("src", "dst", each)
    far = distances(moved, asked, ["pass"], cut)
    found = cut(walks(tree(moved, far, ["pass"]), asked, ["pass"], most, cut))
    lost = asked.join(found.select("pass", "src", "dst"), ["pass", "src", "dst"], "left_anti").join(k1, ["src", "dst"]).select("pass", "src", "dst", "links")
    taken = found.unionByName(lost).select("src", "dst", F.explode("links").alias("link"))
    hits = taken.groupBy("src", "dst", "link").agg(F.count("*").alias("_n"))
    # One cost of a link: parallel edges have links of their own.
    costs = e.groupBy("link").agg(F.min("cost").alias("cost"))
    hits = cut(hits.join(costs, "link"))
    total = hits.groupBy("src", "dst").agg((F.sum(F.col("_n") * F.col("cost")) / passes).alias("dist"))
    return hits.join(total, ["src", "dst"]).select("src", "dst", "dist", "link", (F.col("_n") / passes).alias("weight"))
