"""Origin-destination flows: singly and doubly constrained, their scatter over links, and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio


def self_terms(hist: DataFrame, kernel: Column, zone: str = "zone", weight: str = "w") -> DataFrame:
    """(zone, self): the kernel over a zone's histogram of inner times, a share of its own attraction."""
    return hist.groupBy(zone).agg(F.sum(F.col(weight) * kernel).alias("self"))


def singly_constrained(od: DataFrame, f: Column, src: str = "src", dst: str = "dst", produced: str = "p", attracted: str = "a", selves: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """``od`` with ``flow = scale * p * a * f / sum of a * f over the origin``, 0 where that sum is not positive.

    ``selves`` (zone, mass) adds to the sum an attraction that gets no flow. The sum is an
    aggregate joined back, so an origin with very many pairs is not gathered in one task.
    """
    pull = od.withColumn("_af", F.col(attracted) * f)
    den = pull.groupBy(src).agg(F.sum("_af").alias("_den"))
    if selves is not None:
        den = den.join(selves.select(F.col("zone").alias("_z"), F.col("mass").alias("_m")), F.col(src) == F.col("_z"), "left").select(src, (F.col("_den") + F.coalesce("_m", F.lit(0.0))).alias("_den"))
    out = pull.join(den, src)
    return out.withColumn("flow", F.when(F.col("_den") > 0, F.lit(float(scale)) * F.col(produced) * F.col("_af") / F.col("_den")).otherwise(F.lit(0.0))).drop("_af", "_den")


def doubly_constrained(od: DataFrame, f: Column, src: str = "src", dst: str = "dst", produced: str = "p", attracted: str = "a", sweeps: int = 3, cut=None, tolerance: float | None = None) -> DataFrame:
    """``od`` with flows balanced at both ends by ``sweeps`` rounds of scaling, the origins' totals exact.

    Attractions are scaled to the productions of origins that reach any. A round is two
    aggregates. ``cut`` is called on the table of pairs and on the factors after each round to
    cut the lineage, for example ``DataFrame.checkpoint``; with it, ``tolerance`` ends the rounds when no factor
    changes by more than that part.
    """
    o = od.groupBy(src).agg(F.max(produced).cast("double").alias("O"))
    d = od.groupBy(dst).agg(F.max(attracted).cast("double").alias("A"))
    totals = o.agg(F.sum("O").alias("_so")).crossJoin(d.agg(F.sum("A").alias("_sa")))
    d = d.crossJoin(F.broadcast(totals)).select(dst, safe_ratio(F.col("A") * F.col("_so"), F.col("_sa")).alias("D"))
    cells = od.select(src, dst, f.alias("f")).join(o, src).join(d, dst)
    if cut is not None:
        cells = cut(cells)
        d = cells.groupBy(dst).agg(F.first("D").alias("D"))
    b = d.select(dst, F.lit(1.0).alias("b"))

    def rows(b: DataFrame) -> DataFrame:
        s = cells.join(b, dst).groupBy(src).agg(F.sum(F.col("b") * F.col("D") * F.col("f")).alias("_s"))
        return s.select(src, F.when(F.col("_s") > 0, F.lit(1.0) / F.col("_s")).otherwise(F.lit(0.0)).alias("a_"))

    for _ in range(sweeps):
        a = rows(b)
        s = cells.join(a, src).groupBy(dst).agg(F.sum(F.col("a_") * F.col("O") * F.col("f")).alias("_s"))
        new = s.select(dst, F.when(F.col("_s") > 0, F.lit(1.0) / F.col("_s")).otherwise(F.lit(0.0)).alias("b"))
        if cut is not None:
            new = cut(new)
            if tolerance is not None:
                worst = new.join(b.withColumnRenamed("b", "_b"), dst).agg(F.max(F.abs(safe_ratio(F.col("b") - F.col("_b"), F.col("_b"))))).first()[0]
                b = new
                if worst is None or worst < tolerance:
                    break
                continue
        b = new
    balanced = cells.join(b, dst).join(rows(b), src).withColumn("flow", F.col("a_") * F.col("O") * F.col("b") * F.col("D") * F.col("f"))
    return balanced.select(src, dst, "flow")


def scatter(flows: DataFrame, incidence: DataFrame, links: DataFrame, pair: str = "pair_id", link: str = "link_id", flow: str = "flow", weight: str = "weight") -> DataFrame:
    """(link, flow): flows over the links that their pairs use, 0 for links without any."""
    sums = incidence.join(flows.select(pair, flow), pair).groupBy(link).agg(F.sum(F.col(flow) * F.col(weight)).alias("_f"))
    return links.select(link).join(sums, link, "left").select(link, F.coalesce("_f", F.lit(0.0)).alias(flow))


def balance(flows: DataFrame, src: str = "src", dst: str = "dst", flow: str = "flow") -> DataFrame:
    """(node, generated, consumed, imbalance, ratio): sums at both ends, 0 where there is none."""
    g = flows.groupBy(F.col(src).alias("node")).agg(F.sum(flow).alias("generated"))
    c = flows.groupBy(F.col(dst).alias("node")).agg(F.sum(flow).alias("consumed"))
    j = g.join(c, "node", "full_outer").fillna(0.0, ["generated", "consumed"])
    return j.withColumn("imbalance", F.col("consumed") - F.col("generated")).withColumn("ratio", safe_ratio(F.col("consumed"), F.col("generated"), None))


def relocatable(balances: DataFrame, by: Column | None = None) -> DataFrame:
    """Half the absolute imbalance over what is generated, for all nodes or by a label."""
    live = balances.where((F.col("generated") > 0) | (F.col("consumed") > 0))
    label = F.lit("all") if by is None else by
    return live.groupBy(label.alias("part")).agg(safe_ratio(F.lit(0.5) * F.sum(F.abs("imbalance")), F.sum("generated")).alias("relocatable"))


def trips_by_origin(flows: DataFrame, external: Column, src: str = "src", flow: str = "flow") -> DataFrame:
    """(src, through, internal): flow of each origin to destinations outside and inside."""
    return flows.groupBy(src).agg(F.sum(F.when(external, F.col(flow)).otherwise(0.0)).alias("through"), F.sum(F.when(external, 0.0).otherwise(F.col(flow))).alias("internal"))


def admissible_pairs(nodes: DataFrame, node: str = "node", external: str = "external", allowed: DataFrame | None = None) -> DataFrame:
    """All pairs of different nodes; two external ones only if (src, dst) is in ``allowed``.

    The result has as many rows as there are pairs of nodes: it is the model's own size.
    """
    a = nodes.select(F.col(node).alias("src"), F.col(external).alias("_a"))
    b = nodes.select(F.col(node).alias("dst"), F.col(external).alias("_b"))
    pairs = a.join(b, F.col("src") != F.col("dst"))
    inner = pairs.where(~(F.col("_a") & F.col("_b")))
    if allowed is not None:
        inner = inner.unionByName(pairs.where(F.col("_a") & F.col("_b")).join(allowed.select("src", "dst"), ["src", "dst"], "left_semi").select(*inner.columns))
    return inner.select("src", "dst")


#: Places that are broadcast; more of them are met one part of the origins at a time.
MAX_PLACES = 1_000_000


def ring_masses(origins: DataFrame, places: DataFrame, distance: Column, mass: str, edges: list[float], origin: str = "origin", most: int = MAX_PLACES) -> DataFrame:
    """(origin, ring, mass): attracted mass by ring of distance; the last ring holds all beyond.

    Every origin meets every place, as the masses ask for; sums are made where the pairs are. Up to
    ``most`` places (counted) are broadcast; beyond that they are dealt out in blocks of as many.
    """
    ring = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        ring = F.when(distance < float(edges[i]), F.lit(i)).otherwise(ring)
    blocks = -(-places.count() // most) if most else 1
    if blocks <= 1:
        pairs = origins.crossJoin(F.broadcast(places))
    else:
        dealt = places.withColumn("_block", F.pmod(F.xxhash64(*places.columns), F.lit(blocks)).cast("int"))
        pairs = origins.withColumn("_o_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, F.col("_o_block") == F.col("_block"))
    return pairs.groupBy(origin, ring.alias("ring")).agg(F.sum(mass).alias("mass"))
