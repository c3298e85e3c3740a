"""Planar and projected geometry without a spatial library: grids, containment, nearest, segments."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage

#: GRS80 ellipsoid, and the transverse Mercator parameters of EPSG:2157.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
ITM = {"lat0": 53.5, "lon0": -8.0, "scale": 0.99982, "east0": 600000.0, "north0": 750000.0}


def _meridian_coefficients() -> tuple[float, list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]


def to_itm(lat: Column, lon: Column) -> Column:
    """(x, y) in metres of the Irish Transverse Mercator grid, by the third-order series."""
    radius, alpha = _meridian_coefficients()
    n = FLATTENING / (2 - FLATTENING)
    k = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi):
        s = F.sin(phi)
        at = lambda x: F.log((F.lit(1.0) + x) / (F.lit(1.0) - x)) / 2
        return F.sinh(at(s) - F.lit(k) * at(F.lit(k) * s))

    def northing(xi, eta):
        out = xi
        for j, a in enumerate(alpha, 1):
            out = out + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        return out

    def easting(xi, eta):
        out = eta
        for j, a in enumerate(alpha, 1):
            out = out + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        return out

    # Each of these is used several times and computed once.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def angles(p):
        t, d = p["t"], p["d"]
        return F.struct(F.atan2(t, F.cos(d)).alias("xi"), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d))).alias("eta"))

    phi0 = math.radians(ITM["lat0"])
    s0 = math.sin(phi0)
    t0 = math.sinh(math.atanh(s0) - k * math.atanh(k * s0))
    xi0 = math.atan(t0)
    m0 = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))
    scale = ITM["scale"] * radius

    def metres(p):
        xi, eta = p["xi"], p["eta"]
        return F.struct((F.lit(ITM["east0"]) + F.lit(scale) * easting(xi, eta)).alias("x"), (F.lit(ITM["north0"]) + F.lit(scale) * (northing(xi, eta) - F.lit(m0))).alias("y"))

    start = F.struct(conformal(F.radians(lat)).alias("t"), F.radians(lon - F.lit(ITM["lon0"])).alias("d"))
    return once(once(start, angles), metres)


def shoelace_area(ring: Column) -> Column:
    """Area of a closed or open ring of (x, y)."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid; the mean of the points for a ring without area."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, nxt, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, e: a + e["c"])
    moment = lambda k: F.aggregate(parts, F.lit(0.0), lambda a, e: a + e[k] * e["c"])
    sx, sy = moment("x"), moment("y")
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
    return F.struct(F.when(total != 0, sx / (total * 3)).otherwise(mean("x")).alias("x"), F.when(total != 0, sy / (total * 3)).otherwise(mean("y")).alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by counting crossings."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, nxt, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]).otherwise(F.lit(1.0))))
    return F.aggregate(crosses, F.lit(0), lambda a, c: a + c.cast("int")) % 2 == 1


def segment_fraction(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Place from 0 to 1 of the foot of a point on a segment."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n > 0, F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = segment_fraction(px, py, x1, y1, x2, y2)
    return F.hypot(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1)))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def pairs_within(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(a, b, distance) of points within ``radius`` of each other, ``a < b``: grid cells meet their neighbours."""
    p = points.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), _cell(F.col(x), radius).alias("cx"), _cell(F.col(y), radius).alias("cy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    q = points.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), F.explode(steps).alias("s")).withColumn("cx", _cell(F.col("bx"), radius) + F.col("s.i")).withColumn("cy", _cell(F.col("by"), radius) + F.col("s.j"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return p.join(q, ["cx", "cy"]).where(F.col("a") < F.col("b")).withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


#: Halvings of a radius at most, and pairs of a cell's points that a point may cost on average.
MAX_HALVINGS, CELL_PAIRS = 24, 8


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius: float, x: str = "x", y: str = "y", others: bool = False) -> DataFrame:
    """(left_key, right_key, distance): nearest right point within ``radius``, ties to the smaller key; null if none.

    With ``others`` a point is not near to that of its own key. Right points of one place are one, with its two smallest keys.
    The search begins with cells so small that few points share one, and those that found nothing within a cell's
    size go on to cells of twice the size, up to the radius. Who goes on has no other point near, so among the points
    of one table each meets a bounded number in a round, however dense they are.
    """
    l = left.select(F.col(left_key).alias("_l"), F.col(x).alias("lx"), F.col(y).alias("ly"))
    places = cut_lineage(right.groupBy(F.col(x).alias("rx"), F.col(y).alias("ry")).agg(F.min(right_key).alias("_k1"), F.max(right_key).alias("_k9")))
    second = right.select(F.col(right_key).alias("_k"), F.col(x).alias("rx"), F.col(y).alias("ry")).join(places.where("_k1 < _k9"), ["rx", "ry"]).where(F.col("_k") > F.col("_k1")).groupBy("rx", "ry").agg(F.min("_k").alias("_k2"))
    places = cut_lineage(places.drop("_k9").join(second, ["rx", "ry"], "left"))
    n, k = places.count(), 0
    while k < MAX_HALVINGS:
        size = radius / 2.0**k
        held = places.groupBy(_cell(F.col("rx"), size), _cell(F.col("ry"), size)).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if held <= CELL_PAIRS * n:
            break
        k += 1
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rest, parts = l, []
    for size in (radius / 2.0**i for i in range(k, -1, -1)):
        q = rest.withColumn("cx", _cell(F.col("lx"), size)).withColumn("cy", _cell(F.col("ly"), size))
        r = places.withColumn("s", F.explode(steps)).withColumn("cx", _cell(F.col("rx"), size) + F.col("s.i")).withColumn("cy", _cell(F.col("ry"), size) + F.col("s.j")).drop("s")
        # Of a place with the point's own key, the other one.
        who = F.when(F.col("_k1") == F.col("_l"), F.col("_k2")).otherwise(F.col("_k1")) if others else F.col("_k1")
        met = q.join(r, ["cx", "cy"]).withColumn("_r", who).withColumn("d", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("_r").isNotNull() & (F.col("d") <= radius))
        found = met.groupBy("_l", "lx", "ly").agg(F.min(F.struct("d", "_r")).alias("b"))
        # Just below the size, so that rounding leaves none out; at the radius itself as asked for.
        done = cut_lineage(found.where(F.col("b.d") <= (radius if size == radius else size * (1 - 1e-9))))
        parts.append(done)
        if size != radius:
            rest = cut_lineage(rest.join(done.select("_l", "lx", "ly"), ["_l", "lx", "ly"], "left_anti"))
    best = reduce(DataFrame.unionByName, parts).groupBy("_l").agg(F.min("b").alias("b"))
    return left.select(left_key).join(best, F.col(left_key) == F.col("_l"), "left").select(left_key, F.col("b._r").alias(right_key), F.col("b.d").alias("distance"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, polygon: str, cell: float, how: str = "inner", x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """(key, polygon) where the point lies in the polygon's ring; with ``left`` a null polygon for points in none.

    Polygons are cut into the grid cells of their bounding boxes, points meet those of their own cell.
    """
    xs, ys = F.transform(F.col(ring), lambda p: p["x"]), F.transform(F.col(ring), lambda p: p["y"])
    span = lambda a: F.sequence(_cell(F.array_min(a), cell), _cell(F.array_max(a), cell))
    g = polygons.select(polygon, ring, F.explode(span(xs)).alias("cx"), ys.alias("_ys")).select(polygon, ring, "cx", F.explode(span(F.col("_ys"))).alias("cy"))
    p = points.select(key, F.col(x).alias("px"), F.col(y).alias("py"), _cell(F.col(x), cell).alias("cx"), _cell(F.col(y), cell).alias("cy"))
    hit = p.join(g, ["cx", "cy"]).where(in_ring(F.col("px"), F.col("py"), F.col(ring))).select(key, polygon)
    return hit if how == "inner" else points.select(key).join(hit, key, "left")


def nearest_any(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius: float, rounds: int = 60, cut=None) -> DataFrame:
    """``nearest`` without a limit: points that find none within ``radius`` search twice as far, and so on."""
    cut = cut or (lambda df: df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist())
    rest, out = left, None
    for k in range(rounds):
        found = cut(nearest(rest, right, left_key, right_key, radius * 2.0**k).where(F.col(right_key).isNotNull()))
        out = found if out is None else out.unionByName(found)
        rest = cut(rest.join(found.select(left_key), left_key, "left_anti"))
        if rest.isEmpty() or right.isEmpty():
            break
    return left.select(left_key).join(out, left_key, "left")


def points_in_polygons_or_nearest(points: DataFrame, polygons: DataFrame, key: str, polygon: str, cell: float, radius: float | None = None) -> DataFrame:
    """(key, polygon): the polygon that holds the point, else the one with the nearest centroid, within ``radius`` if one is given."""
    inside = points_in_polygons(points, polygons, key, polygon, cell, "left")
    centres = polygons.select(polygon, ring_centroid(F.col("ring")).alias("c")).select(F.col(polygon).alias("_near"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    outside = points.join(inside.where(F.col(polygon).isNull()).select(key), key, "left_semi")
    near = (nearest_any(outside, centres, key, "_near", cell) if radius is None else nearest(outside, centres, key, "_near", radius)).select(key, "_near")
    return inside.join(near, key, "left").select(key, F.coalesce(polygon, "_near").alias(polygon))


def boundary_edges(edges: DataFrame, inside: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges with exactly one end among the inside nodes."""
    i = inside.select(F.col("node"), F.lit(True).alias("_in"))
    j = edges.join(i.withColumnsRenamed({"node": u, "_in": "_u"}), u, "left").join(i.withColumnsRenamed({"node": v, "_in": "_v"}), v, "left")
    return j.where(F.col("_u").isNull() != F.col("_v").isNull()).select(*edges.columns)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to a ring; 0 inside."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda p, q: segment_distance(x, y, p["x"], p["y"], q["x"], q["y"]))
    return F.when(in_ring(x, y, ring), F.lit(0.0)).otherwise(F.array_min(edges))


def circle_meets(x: Column, y: Column, radius: Column, ring: Column) -> Column:
    return ring_distance(x, y, ring) <= radius


def sample_in_rings(areas: DataFrame, key: str, n: int, seed: int = 0, ring: str = "ring", tries: int = 12) -> DataFrame:
    """(key, draw, x, y): up to ``n`` uniform points in each ring, by rejection from its box; draws depend on key and seed alone.

    ``tries`` times as many candidates are drawn as points are wanted; a ring that fills less
    than that part of its box gets fewer.
    """
    from ..functions.scalar import slot_hash

    xs, ys = F.transform(F.col(ring), lambda p: p["x"]), F.transform(F.col(ring), lambda p: p["y"])
    c = areas.select(key, ring, F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"), F.explode(F.sequence(F.lit(0), F.lit(n * tries - 1))).alias("draw"))
    u, v = slot_hash(F.col(key), F.col("draw"), F.lit("x"), seed=seed), slot_hash(F.col(key), F.col("draw"), F.lit("y"), seed=seed)
    p = c.withColumn("x", F.col("x0") + u * (F.col("x1") - F.col("x0"))).withColumn("y", F.col("y0") + v * (F.col("y1") - F.col("y0"))).where(in_ring(F.col("x"), F.col("y"), F.col(ring)))
    hit = p.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "x", "y"))), 1, n).alias("s"))
    return hit.select(key, F.posexplode("s").alias("i", "p")).select(key, F.col("i").alias("draw"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def road_points(areas: DataFrame, key: str, n: int, roads: DataFrame, road_key: str, tolerance: float, seed: int = 0, ring: str = "ring", tries: int = 12) -> DataFrame:
    """(key, draw, x, y, off): ``n`` points in each ring, each the first of ``tries`` draws that lies within ``tolerance`` of a road
    point (x, y), or else the draw nearest to one; a point without any road point within four times that has a null ``off``."""
    drawn = sample_in_rings(areas, key, n * tries, seed, ring)
    ids = drawn.select(F.xxhash64(F.col(key), F.col("draw")).alias("_id"), key, "draw", "x", "y")
    off = nearest(ids, roads, "_id", road_key, 4 * tolerance).select(F.col("_id").alias("_i"), F.col("distance").alias("off"))
    j = ids.join(off, F.col("_id") == F.col("_i"), "left").withColumn("_point", F.pmod("draw", F.lit(n)).cast("int"))
    near = F.coalesce(F.col("off") < tolerance, F.lit(False))
    rank = F.struct((~near).alias("far"), F.when(near, F.lit(0.0)).otherwise(F.coalesce("off", F.lit(float("inf")))).alias("off"), F.col("draw").alias("draw"))
    best = j.groupBy(key, "_point").agg(F.min_by(F.struct("x", "y", "off"), rank).alias("p"))
    return best.select(key, F.col("_point").alias("draw"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.off").alias("off"))


def repaired_place(x: Column, y: Column, box: tuple[float, float, float, float] = (-11.0, 51.0, -5.0, 56.0)) -> Column:
    """(lon, lat) of a pair of columns that may hold degrees, degrees in the wrong order, or grid metres; null if none fits."""
    west, south, east, north = box
    ok = lambda a, b: a.between(west, east) & b.between(south, north)
    place = lambda a, b: F.struct(a.cast("double").alias("lon"), b.cast("double").alias("lat"))
    grid = x.between(400_000, 800_000) & y.between(400_000, 1_000_000)
    back = from_itm(x.cast("double"), y.cast("double"))
    return F.when(ok(x, y), place(x, y)).when(ok(y, x), place(y, x)).when(grid, place(back["lon"], back["lat"]))


def from_itm(x: Column, y: Column) -> Column:
    """(lon, lat) of Irish Transverse Mercator metres: the inverse third-order series."""
    n = FLATTENING / (2 - FLATTENING)
    radius, _ = _meridian_coefficients()
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    _, alpha = _meridian_coefficients()
    k = 2 * math.sqrt(n) / (1 + n)
    s0 = math.sin(math.radians(ITM["lat0"]))
    xi0 = math.atan(math.sinh(math.atanh(s0) - k * math.atanh(k * s0)))
    m0 = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))
    scale = ITM["scale"] * radius
    xi, eta = (y - F.lit(ITM["north0"])) / F.lit(scale) + F.lit(m0), (x - F.lit(ITM["east0"])) / F.lit(scale)
    u, v = xi, eta
    for j, b in enumerate(beta, 1):
        u = u - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        v = v - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.struct((F.lit(ITM["lon0"]) + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(lat).alias("lat"))
