"""Operators on large graphs bound to the driver's tables: the tours of orders through their suppliers' days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import biconnected, calibration, datum, kernel_iteration, overlay, routing, spatial
from ..sources import sinks
from ..sources.tables import table
from .bindings import query, r, rounded

# A stop is a supplier, a day and a line status. An order's tour leads through its stops in their order; urgent and
# high orders come back to their first stop.
_STOPS = """stops AS (SELECT DISTINCT l_orderkey AS o, (l_suppkey * 10000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 2 + CAST(l_linestatus = 'F' AS INT) AS s FROM lineitem),
tour AS (SELECT o, s, lead(s) OVER (PARTITION BY o ORDER BY s) AS t, min(s) OVER (PARTITION BY o) AS s0, count(*) OVER (PARTITION BY o) AS k FROM stops),
leg AS (SELECT s AS u, coalesce(t, s0) AS v FROM tour LEFT JOIN orders ON o_orderkey = o WHERE t IS NOT NULL OR (k > 2 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))),
near AS (SELECT DISTINCT u AS a, v AS b FROM leg UNION SELECT v, u FROM leg)"""


def _stop():
    return (F.col("l_suppkey") * 10000 + F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))) * 2 + (F.col("l_linestatus") == "F").cast("int")


def _way():
    """An order's number; lines without an order are one tour, as in SQL."""
    return F.coalesce("l_orderkey", F.lit(-(1 << 63)))


def tours(spark, d):
    """(way, u, v): a row for each leg of each order's tour. An order has a handful of stops, so its lines are dealt out as they are."""
    stops = table(spark, d, "lineitem").select(_way().alias("way"), _stop().alias("s")).repartition("way").groupBy("way").agg(F.array_sort(F.collect_set("s")).alias("s"))
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("way"), F.lit(True).alias("back"))
    k = F.size("s")
    on = F.zip_with(F.slice("s", 1, F.greatest(k - 1, F.lit(0))), F.slice("s", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    home = F.when((k > 2) & F.coalesce("back", F.lit(False)), F.array(F.struct(F.element_at("s", -1).alias("u"), F.element_at("s", 1).alias("v")))).otherwise(F.array().cast("array<struct<u:bigint,v:bigint>>"))
    return stops.join(o, "way", "left").select("way", F.explode(F.concat(on, home)).alias("e")).select("way", "e.u", "e.v")


def legs(spark, d):
    """(u, v): a row for each leg of each order's tour."""
    return tours(spark, d).select("u", "v")


@query(f"""WITH RECURSIVE {_STOPS},
held AS (SELECT DISTINCT (l_suppkey * 10000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 2 + CAST(l_linestatus = 'F' AS INT) AS s FROM lineitem WHERE l_quantity = 50),
paid AS (SELECT (l_suppkey * 10000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 2 + CAST(l_linestatus = 'F' AS INT) AS s, sum(l_extendedprice) AS demand FROM lineitem GROUP BY 1),
hubs AS (SELECT a FROM near GROUP BY a HAVING count(*) > 1),
reach AS (SELECT n.a AS gate, n.b AS x, n.b AS node FROM near n SEMI JOIN hubs h ON h.a = n.a UNION SELECT gate, x, e.b FROM reach JOIN near e ON e.a = node WHERE e.b <> gate),
part AS (SELECT gate, x, min(node) FILTER (EXISTS (FROM near e WHERE e.a = gate AND e.b = node)) AS entry, count(*) AS n, count(held.s) AS protected, sum(demand) AS demand FROM reach LEFT JOIN held ON held.s = node JOIN paid ON paid.s = node GROUP BY ALL),
parts AS (SELECT DISTINCT gate, entry, n, protected, round(demand, 2) AS demand FROM part),
cuts AS (SELECT gate FROM parts GROUP BY gate HAVING count(*) > 1)
SELECT gate, entry, n, demand FROM parts SEMI JOIN cuts USING (gate) WHERE protected = 0""")
def cut_regions(spark, d):
    """The parts of the network that one stop alone connects to its protected stops, for every cut stop at once."""
    li = table(spark, d, "lineitem")
    held = li.where("l_quantity = 50").select(_stop().alias("node"))
    found = biconnected.blocks(legs(spark, d), held, li.select(_stop().alias("node"), F.col("l_extendedprice").alias("demand")), ["demand"])
    return rounded(biconnected.regions(found, sums=["demand"]).where("protected = 0").select("gate", "entry", "n", "demand"), demand=2)


@query(f"""WITH RECURSIVE {_STOPS},
held AS (SELECT DISTINCT (l_suppkey * 10000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 2 + CAST(l_linestatus = 'F' AS INT) AS s FROM lineitem WHERE l_quantity = 50),
hubs AS (SELECT a FROM near GROUP BY a HAVING count(*) > 1),
reach AS (SELECT n.a AS gate, n.b AS x, n.b AS node FROM near n SEMI JOIN hubs h ON h.a = n.a UNION SELECT gate, x, e.b FROM reach JOIN near e ON e.a = node WHERE e.b <> gate),
part AS (SELECT gate, x, node, min(node) FILTER (EXISTS (FROM near e WHERE e.a = gate AND e.b = node)) OVER w AS entry, count(held.s) OVER w AS protected FROM reach LEFT JOIN held ON held.s = node WINDOW w AS (PARTITION BY gate, x)),
cuts AS (SELECT gate FROM part GROUP BY gate HAVING count(DISTINCT entry) > 1)
SELECT DISTINCT gate, entry, node FROM part SEMI JOIN cuts USING (gate) WHERE protected = 0""")
def cut_region_nodes(spark, d):
    """The stops of those parts."""
    members = table(spark, d, "lineitem").select(_way().alias("way"), _stop().alias("node"), (F.col("l_quantity") == 50).alias("protected"))
    return biconnected.unprotected_nodes(tours(spark, d), members)


# Both ways along each leg, at a cost and under a link number that follow from its ends.
_ROADS = f"""{_STOPS}, e AS (SELECT a, b, CAST(abs(a - b) % 97 + 1 AS DOUBLE) AS c, a * 100000000 + b AS link FROM near),
depot AS (SELECT min((l_suppkey * 10000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 2 + CAST(l_linestatus = 'F' AS INT)) AS src FROM lineitem GROUP BY l_suppkey)"""


def roads(spark, d):
    e = legs(spark, d)
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return near.select("u", "v", (F.abs(F.col("u") - F.col("v")) % 97 + 1).cast("double").alias("cost"), (F.col("u") * 100000000 + F.col("v")).alias("link_id"))


def depots(spark, d):
    """A start at each supplier's first stop."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(_stop()).alias("src")).select("src")


@query(f"""WITH RECURSIVE {_ROADS},
w(src, node, dist) USING KEY (src, node) AS (SELECT src, src, 0e0 FROM depot UNION SELECT w.src, e.b, min(w.dist + e.c) FROM w JOIN e ON e.a = w.node LEFT JOIN recurring.w AS o ON o.src = w.src AND o.node = e.b WHERE o.dist IS NULL OR w.dist + e.c < o.dist GROUP BY 1, 2),
tree AS (SELECT v.src, v.node, v.dist, min_by(e.a, e.link) AS back, min(e.link) AS link FROM w v JOIN e ON e.b = v.node JOIN w u ON u.src = v.src AND u.node = e.a AND u.dist + e.c = v.dist GROUP BY ALL),
way AS (SELECT src, src AS node, '' AS links FROM depot UNION ALL SELECT t.src, t.node, CASE WHEN way.links = '' THEN '' ELSE way.links || ',' END || t.link FROM way JOIN tree t ON t.src = way.src AND t.back = way.node)
SELECT tree.src, tree.node AS dst, dist, links FROM tree JOIN way USING (src, node)""")
def stop_paths(spark, d):
    """Distances and links of the shortest paths from each supplier's first stop to every stop that it reaches."""
    starts = sinks.cut_lineage(depots(spark, d))
    e = routing.within_reach(sinks.cut_lineage(roads(spark, d)), starts)
    found = routing.distances(routing.clean_edges(e), starts)
    p = routing.paths(e, found.where("src != node").select("src", F.col("node").alias("dst")))
    return p.select("src", "dst", "dist", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


_PASSES = 4


@query(f"""WITH RECURSIVE {_ROADS}, pass AS (SELECT unnest(range({_PASSES})) AS pass),
hop(src, node, n) USING KEY (src, node) AS (SELECT src, src, 0 FROM depot UNION SELECT hop.src, e.b, any_value(hop.n) + 1 FROM hop JOIN e ON e.a = hop.node LEFT JOIN recurring.hop AS o ON o.src = hop.src AND o.node = e.b WHERE o.n IS NULL GROUP BY 1, 2),
z AS (SELECT pass, a, b, c, link, ('0x' || substr(md5(pass || '|' || link || '|a|42'), 1, 12))::BIGINT / 281474976710656e0 AS h1, ('0x' || substr(md5(pass || '|' || link || '|b|42'), 1, 12))::BIGINT / 281474976710656e0 AS h2 FROM e, pass),
p AS (SELECT pass, a, b, c, link, c * exp(0.3e0 * (sqrt(-2 * ln(1 - h1)) * cos(2 * pi() * h2)) * (30e0 / (30e0 + 0.3e0 * c))) AS moved FROM z),
w(pass, src, node, dist) USING KEY (pass, src, node) AS (SELECT pass, src, src, 0e0 FROM depot, pass UNION SELECT w.pass, w.src, p.b, min(w.dist + p.moved) FROM w JOIN p ON p.a = w.node AND p.pass = w.pass LEFT JOIN recurring.w AS o ON o.pass = w.pass AND o.src = w.src AND o.node = p.b WHERE o.dist IS NULL OR w.dist + p.moved < o.dist GROUP BY 1, 2, 3),
tree AS (SELECT v.pass, v.src, v.node, min_by(p.a, p.link) AS back, min(p.link) AS link FROM w v JOIN p ON p.b = v.node AND p.pass = v.pass JOIN w u ON u.pass = v.pass AND u.src = v.src AND u.node = p.a AND u.dist + p.moved = v.dist GROUP BY ALL),
walk AS (SELECT pass, src, node AS dst, node AS at, -1::BIGINT AS link FROM tree UNION ALL SELECT walk.pass, walk.src, dst, back, tree.link FROM walk JOIN tree ON tree.pass = walk.pass AND tree.src = walk.src AND tree.node = walk.at),
hits AS (SELECT src, dst, link, count(*) AS n FROM walk WHERE link >= 0 GROUP BY ALL)
SELECT src, dst, round(sum(n * c) OVER (PARTITION BY src, dst) / {_PASSES}, 6) AS dist, link, n / {_PASSES}e0 AS weight FROM hits JOIN e USING (link)""")
def stop_incidence(spark, d):
    """Over noisy passes, the mean cost of each depot's paths and the share of passes that take each link."""
    starts = sinks.cut_lineage(depots(spark, d))
    e = routing.within_reach(sinks.cut_lineage(roads(spark, d)), starts)
    reached = routing.distances(routing.clean_edges(e), starts).where("src != node").select("src", F.col("node").alias("dst"))
    return rounded(routing.probit_incidence(e, reached, passes=_PASSES, most=1000), dist=6).withColumn("weight", r("weight", 9))


# Suppliers' places are boxes with a hole, customers' are boxes that lack their upper right quarter.
_SHAPES = """p AS (SELECT s_suppkey, s_suppkey * 37 % 1000 / 10e0 AS x, s_suppkey * 61 % 1000 / 10e0 AS y, CAST(3 + s_suppkey % 7 AS DOUBLE) AS w, CAST(2 + s_suppkey % 5 AS DOUBLE) AS h FROM supplier),
q AS (SELECT c_custkey, c_custkey * 53 % 1000 / 10e0 AS x, c_custkey * 29 % 1000 / 10e0 AS y, CAST(1 + c_custkey % 3 AS DOUBLE) AS w, CAST(1 + c_custkey % 4 AS DOUBLE) AS h FROM customer),
lb AS (SELECT s_suppkey, 1e0 AS sign, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM p UNION ALL SELECT s_suppkey, -1e0, x + w / 4, y + h / 4, x + w / 2, y + h / 2 FROM p),
rb AS (SELECT c_custkey, 1e0 AS sign, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM q UNION ALL SELECT c_custkey, -1e0, x + w / 2, y + h / 2, x + w, y + h FROM q)"""


@query(f"""WITH {_SHAPES}, m AS (SELECT s_suppkey, c_custkey, sum(lb.sign * rb.sign * (least(lb.x1, rb.x1) - greatest(lb.x0, rb.x0)) * (least(lb.y1, rb.y1) - greatest(lb.y0, rb.y0))) AS area
FROM lb JOIN rb ON lb.x0 < rb.x1 AND rb.x0 < lb.x1 AND lb.y0 < rb.y1 AND rb.y0 < lb.y1 GROUP BY ALL)
SELECT s_suppkey, c_custkey, round(area, 6) AS area, round(area / (w * h * 15 / 16), 6) AS share FROM m JOIN p USING (s_suppkey) WHERE area > 0.05""")
def area_overlaps(spark, d):
    """Overlaps of suppliers' places with customers', slivers left out."""

    def shape(df, key, a, b, w, h):
        k = F.col(key)
        df = df.select(key, (k * a % 1000 / F.lit(10.0)).alias("x"), (k * b % 1000 / F.lit(10.0)).alias("y"), w(k).cast("double").alias("w"), h(k).cast("double").alias("h"))
        at = lambda u, v: F.struct((F.col("x") + F.col("w") * u).alias("x"), (F.col("y") + F.col("h") * v).alias("y"))
        return df, lambda *pts: F.array(*(at(float(u), float(v)) for u, v in pts))

    p, ring = shape(table(spark, d, "supplier"), "s_suppkey", 37, 61, lambda k: k % 7 + 3, lambda k: k % 5 + 2)
    p = p.select("s_suppkey", F.array(ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5))).alias("rings"))
    q, ring = shape(table(spark, d, "customer"), "c_custkey", 53, 29, lambda k: k % 3 + 1, lambda k: k % 4 + 1)
    q = q.select("c_custkey", F.array(ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))).alias("rings"))
    found = overlay.overlay(p, q, "s_suppkey", "c_custkey", 5.0, least_area=0.05)
    return found.select("s_suppkey", "c_custkey", r("area").alias("area"), r("left_share").alias("share"))


# --- calibration -------------------------------------------------------------------------

# Zones are nations and market segments on one side and suppliers on the other; times follow from their numbers.
_ZONES = """o AS (SELECT CAST(c_nationkey * 100 + len(c_mktsegment) AS BIGINT) AS src, CAST(count(*) AS DOUBLE) AS O FROM customer GROUP BY 1),
c AS (SELECT src, s_suppkey AS dst, O, 1e0 + s_suppkey % 5 AS D, 60e0 + (src * 131 + s_suppkey * 57 + src * s_suppkey * 7) % 2400 AS t, 0.6e0 * exp(-t / 400e0) + 0.4e0 * exp(-t / 2000e0) AS f FROM o, supplier)"""
_SWEEP = """a{i} AS (SELECT src, 1 / sum(b * f) AS a FROM c JOIN b{j} USING (dst) GROUP BY src), g{i} AS (SELECT src, a / avg(a) OVER () AS a FROM a{i}),
b{i} AS (SELECT dst, any_value(D) / sum(a * O * f) AS b FROM c JOIN g{i} USING (src) GROUP BY dst)"""


def zones(spark, d):
    """(pairs, origins, destinations): as many pairs as there are zones of both kinds, the model's own size."""
    o = table(spark, d, "customer").groupBy((F.col("c_nationkey") * 100 + F.length("c_mktsegment")).cast("long").alias("src")).agg(F.count("*").cast("double").alias("O"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), (F.lit(1.0) + F.col("s_suppkey") % 5).alias("D"))
    pairs = o.select("src").crossJoin(p.select("dst")).withColumn("t", (F.lit(60) + (F.col("src") * 131 + F.col("dst") * 57 + F.col("src") * F.col("dst") * 7) % 2400).cast("double"))
    return pairs, o, p


def trips_by_time(spark, d):
    """(bin, trips): customers times suppliers' size, fewer the farther, in minutes."""
    pairs, o, p = zones(spark, d)
    return pairs.join(o, "src").join(p, "dst").groupBy(F.floor(F.col("t") / 60).cast("long").alias("bin")).agg(F.sum(F.col("O") * F.col("D") * F.exp(-F.col("t") / 500)).alias("trips"))


@query(f"""WITH {_ZONES}, b0 AS (SELECT DISTINCT dst, 1e0 AS b FROM c), {_SWEEP.format(i=1, j=0)}, {_SWEEP.format(i=2, j=1)}, a3 AS (SELECT src, 1 / sum(b * f) AS a FROM c JOIN b2 USING (dst) GROUP BY src)
SELECT CAST(floor(t / 60) AS BIGINT) AS bin, round(sum(O * D * exp(-t / 500)), 4) AS trips, round(sum(O * a * b), 4) AS places, round(sum(O * D * exp(-t / 500)) / sum(O * a * b), 6) AS willing FROM c JOIN a3 USING (src) JOIN b2 USING (dst) GROUP BY 1""")
def kernel_round(spark, d):
    """One round of the kernel iteration: balance, density of places and willingness by time."""
    pairs, o, p = zones(spark, d)
    cells = pairs.withColumn("f", kernel_iteration.kernel(F.col("t"), 0.6, 400.0, 2000.0))
    got = kernel_iteration.willingness(trips_by_time(spark, d), kernel_iteration.density(cells, o, p, 60.0, sweeps=2))
    return rounded(got, trips=4, places=4, willing=6)


@query(f"""WITH {_ZONES}, b0 AS (SELECT DISTINCT dst, 1e0 AS b FROM c), {_SWEEP.format(i=1, j=0)}, {_SWEEP.format(i=2, j=1)}, a3 AS (SELECT src, 1 / sum(b * f) AS a FROM c JOIN b2 USING (dst) GROUP BY src)
SELECT src, dst, round(O * a * b * f, 6) AS flow FROM c JOIN a3 USING (src) JOIN b2 USING (dst)""")
def gauge_fixed_flows(spark, d):
    """Flows by balancing factors that are kept apart and fixed in scale."""
    pairs, o, p = zones(spark, d)
    cells = pairs.select("src", "dst", kernel_iteration.kernel(F.col("t"), 0.6, 400.0, 2000.0).alias("f"))
    a, b = kernel_iteration.balancing_factors(cells, o, p, 2)
    return cells.join(o, "src").join(a, "src").join(b, "dst").select("src", "dst", r(F.col("O") * F.col("a") * F.col("b") * F.col("f")).alias("flow"))


@query()
def kernel_iterated(spark, d):
    """The kernel under which balanced flows have the trips by time of flows that were made with another than the first guess."""
    pairs, o, p = (sinks.cut_lineage(x) for x in zones(spark, d))
    true = pairs.withColumn("f", kernel_iteration.kernel(F.col("t"), 0.7, 300.0, 1500.0))
    a, b = kernel_iteration.balancing_factors(true, o, p, 3)
    trips = sinks.cut_lineage(true.join(o, "src").join(a, "src").join(b, "dst").groupBy(F.floor(F.col("t") / 60).cast("long").alias("bin")).agg(F.sum(F.col("O") * F.col("a") * F.col("b") * F.col("f")).alias("trips")))
    got = kernel_iteration.iterate(pairs, o, p, trips, 60.0, {"w": 0.5, "tau_s": 200.0, "tau_l": 2500.0}, sweeps=3, damping=0.8, tolerance=0.02, rounds=12)
    return spark.createDataFrame([(x["round"], round(x["w"], 3), round(x["tau_s"], 1), round(x["tau_l"], 1)) for x in got.trace], "round int, w double, tau_s double, tau_l double")


_SETS = [(i, 200.0 + 100 * i, 1500.0, 0.3 + 0.2 * i) for i in range(3)]


def assigned(spark, d):
    """(pairs, incidence) of flows by market segment from nations to suppliers."""
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("component"), F.col("c_nationkey").cast("long").alias("src")).agg(F.count("*").cast("double").alias("produced"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"))
    k = F.col("src") * 100_000 + F.col("dst")
    pairs = c.crossJoin(s).select("component", k.alias("pair"), "src", (F.lit(60) + (F.col("src") * 131 + F.col("dst") * 57) % 2400).cast("double").alias("t"), "produced", (F.lit(1.0) + (F.col("dst") + F.length("component")) % 5).alias("attracted"))
    nations = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src")).distinct()
    sees = F.array(F.struct(((F.col("src") * 7 + F.col("dst") * 3) % 12).alias("obs"), F.lit(1.0).alias("share")), F.struct((12 + (F.col("src") + F.col("dst")) % 8).alias("obs"), F.lit(0.5).alias("share")))
    incidence = nations.crossJoin(s).select(k.alias("pair"), F.explode(sees).alias("e")).select("pair", "e.obs", "e.share")
    return pairs, incidence


@query("""WITH s AS (SELECT unnest([0, 1, 2]) AS "set"), c AS (SELECT c_mktsegment AS component, CAST(c_nationkey AS BIGINT) AS src, CAST(count(*) AS DOUBLE) AS produced FROM customer GROUP BY ALL),
p AS (SELECT "set", component, src, s_suppkey AS dst, produced, (1e0 + (s_suppkey + len(component)) % 5) AS attracted, 60e0 + (src * 131 + s_suppkey * 57) % 2400 AS t,
  attracted * ((0.3e0 + 0.2e0 * "set") * exp(-t / (200e0 + 100e0 * "set")) + (1 - (0.3e0 + 0.2e0 * "set")) * exp(-t / 1500e0)) AS af FROM c, supplier, s),
f AS (SELECT *, produced * af / sum(af) OVER (PARTITION BY "set", component, src) AS flow FROM p),
i AS (SELECT *, (src * 7 + dst * 3) % 12 AS obs, 1e0 AS share FROM f UNION ALL SELECT *, 12 + (src + dst) % 8, 0.5e0 FROM f)
SELECT CAST("set" AS INT) AS "set", obs, component, round(sum(flow * share), 6) AS flow FROM i GROUP BY ALL""")
def calibration_flows(spark, d):
    """What each observation would see of each component, for several kernels at once."""
    pairs, incidence = assigned(spark, d)
    sets = spark.createDataFrame(_SETS, "set int, short double, long double, mix double").crossJoin(F.broadcast(pairs.select("component").distinct()))
    return rounded(calibration.predictions(pairs, incidence, sets), flow=6)


@query()
def calibrated_kernels(spark, d):
    """The kernel and the scale that made what was observed, found again from a start away from them."""
    import numpy as np

    pairs, incidence = assigned(spark, d)
    pairs = sinks.cut_lineage(pairs.withColumn("component", F.lit("all")).groupBy("component", "pair", "src", "t").agg(F.sum("produced").alias("produced"), F.max("attracted").alias("attracted")))
    incidence = sinks.cut_lineage(incidence)
    true = spark.createDataFrame([(0, "all", 420.0, 1700.0, 0.65)], "set int, component string, short double, long double, mix double")
    seen = calibration.predictions(pairs, incidence, true).select("obs", (F.col("flow") * 1.25).alias("value"), F.lit(1.0).alias("weight"), (F.col("obs") % 3 == 0).alias("counted"))
    got = calibration.calibrate(pairs, incidence, sinks.cut_lineage(seen), {"all": (300.0, 2200.0, 0.5)}, np.eye(3) * 1e-6, np.eye(1) * 1e-6, points=15, narrowings=2, rounds=6)
    return spark.createDataFrame([(c, *(round(x, 2) for x in k), round(got.scales[c], 3)) for c, k in got.kernels.items()], "component string, short double, long double, mix double, scale double")


# --- places ------------------------------------------------------------------------------


@query("""SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE -10e0 + c_custkey % 400 / 100e0 END, 6) AS lon, round(CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 52e0 + c_custkey % 300 / 100e0 END, 6) AS lat FROM customer""")
def resolved_places(spark, d):
    """Places from columns that hold latitude and longitude, or a grid easting and a latitude, or grid metres."""
    k = F.col("c_custkey")
    lon, lat = F.lit(-10.0) + k % 400 / F.lit(100.0), F.lit(52.0) + k % 300 / F.lit(100.0)
    g = spatial.to_itm(lat, lon)
    a = F.when(k % 4 == 0, lat).when(k % 4 == 1, g["x"]).when(k % 4 == 2, g["y"]).otherwise(F.lit(3.0))
    b = F.when(k % 4 == 0, lon).when(k % 4 == 1, lat).when(k % 4 == 2, g["x"]).otherwise(F.lit(9.0))
    p = table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b")).select("c_custkey", datum.resolved_place(F.col("a"), F.col("b")).alias("p"))
    return p.select("c_custkey", r("p.lon").alias("lon"), r("p.lat").alias("lat"))
