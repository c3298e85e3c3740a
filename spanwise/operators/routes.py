"""Routes as rows: predicted times, class times and costs, legs between a core and its outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain, kernels
from ..functions.scalar import haversine_m

#: Seconds at a signal, km/h off the buckets, metres of a mile.
SIGNAL_S = 2.0
UNBUCKETED_KMH = 25.0
MILE_M = 1609.344
#: Classes whose preference splits by speed, the speed in km/h, that of a mile an hour, and the classes of preferences.
SPLIT_CLASSES = ("trunk", "primary", "secondary", "tertiary")
RURAL_ABOVE_KMH = 48.3
PREFERENCE_MPH_KMH = 1.60934
PREFERENCE_CLASSES = (
    "motorway", "trunk", "trunk_rural", "primary", "primary_rural", "secondary", "secondary_rural", "tertiary", "tertiary_rural",
    "unclassified", "residential", "living_street", "service",
)
#: Fixed value: metres that a route may stray from a place on a junction before it comes back to it.
LOOP_M = 500.0
#: Kinds of a route's nodes.
OFF_MODEL, INTERNAL, BOUNDARY = 0, 1, 2


# --- times and costs -------------------------------------------------------------


def _parts(bucket: Column) -> tuple[Column, Column]:
    halves = F.split(bucket, r"\|", 2)
    return F.element_at(halves, 1), F.element_at(halves, 2)


def edge_seconds(length_by_bucket: Column, factors: Column | None = None, unbucketed_m: Column | None = None) -> Column:
    """Seconds on a route's edges: metres by ``class|band`` at the bucket's base speed, times its factor (1 where it has none)."""

    def one(e: Column) -> Column:
        cls, band = _parts(e["key"])
        factor = F.lit(None).cast("double") if factors is None else F.try_element_at(factors, e["key"])
        return domain.edge_seconds(factor, e["value"], domain.base_kmh(cls, band))

    total = F.aggregate(F.map_entries(F.coalesce(length_by_bucket, F.create_map().cast("map<string,double>"))), F.lit(0.0), lambda acc, e: acc + one(e))
    return total if unbucketed_m is None else total + F.coalesce(unbucketed_m, F.lit(0.0)) * F.lit(3.6 / UNBUCKETED_KMH)


def turn_seconds(turns: Column, signals: Column | None = None, signal_s: float = SIGNAL_S, **turn: float) -> Column:
    """Seconds for a route's turns, an array of (angle, degree, uturn), and its signals."""
    cost = lambda t: kernels.turn_penalty(t["angle"], F.coalesce(t["degree"], F.lit(0)), F.coalesce(t["uturn"], F.lit(False)), **turn)
    none = F.array().cast("array<struct<angle:double,degree:int,uturn:boolean>>")
    total = F.aggregate(F.coalesce(turns, none), F.lit(0.0), lambda acc, t: acc + cost(t))
    return total if signals is None else total + F.coalesce(signals, F.lit(0)) * F.lit(float(signal_s))


def route_seconds(length_by_bucket: Column, factors: Column | None, unbucketed_m: Column, turns: Column, signals: Column) -> Column:
    """Predicted seconds of a route: edges, turns and signals."""
    return edge_seconds(length_by_bucket, factors, unbucketed_m) + turn_seconds(turns, signals)


def preference_key(bucket: Column) -> Column:
    """The class that a bucket's preference belongs to: links go with their road, split classes by speed, others fall back to unclassified."""
    cls, band = _parts(bucket)
    road = F.regexp_replace(cls, "_link$", "")
    known = road.isin(*(c for c in PREFERENCE_CLASSES if not c.endswith("_rural")))
    default = F.lit(float(domain.CLASS_KMH["other"]))
    for k, v in domain.CLASS_KMH.items():
        default = F.when(cls == k, F.lit(float(v))).otherwise(default)
    kmh = F.coalesce(band.try_cast("int") * F.lit(PREFERENCE_MPH_KMH), default)
    return F.when(road.isin(*SPLIT_CLASSES), F.concat(road, F.when(kmh > RURAL_ABOVE_KMH, "_rural").otherwise(""))).when(known, road).otherwise("unclassified")


def class_seconds(routes: DataFrame, by: Sequence[str], length_by_bucket: str, measured: DataFrame | None = None) -> DataFrame:
    """(by, preference, seconds) of routes' buckets; ``measured`` (bucket, kmh) goes before the base speed where it is above 0."""
    e = routes.select(*by, F.explode(length_by_bucket).alias("bucket", "metres"))
    if measured is not None:
        e = e.join(measured.select("bucket", "kmh"), "bucket", "left")
    cls, band = _parts(F.col("bucket"))
    kmh = domain.base_kmh(cls, band, F.col("kmh") if measured is not None else None)
    return e.groupBy(*by, preference_key(F.col("bucket")).alias("preference")).agg(F.sum(F.col("metres") * F.lit(3.6) / kmh).alias("seconds"))


def route_cost(times: DataFrame, by: Sequence[str], preferences: DataFrame) -> DataFrame:
    """(by, seconds, cost): a route's time, and its time weighted by (preference, factor); a class without a factor has 1."""
    j = times.join(preferences.select("preference", "factor"), "preference", "left")
    return j.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.sum(F.col("seconds") * F.coalesce("factor", F.lit(1.0))).alias("cost"))


def best_route_point(best: Column, routes: Column) -> Column:
    """(seconds, miles) of the first valid route, of (valid, g_dur, g_dist), that takes the best time; null if none does."""
    ok = lambda x: F.coalesce(x["valid"] & (x["g_dur"] != 0) & (x["g_dist"] != 0) & (F.abs(x["g_dur"] - best) < 1e-6), F.lit(False))
    hit = F.try_element_at(F.filter(routes, ok), F.lit(1))
    return F.when(hit.isNotNull() & (best != 0), F.struct(hit["g_dur"].alias("seconds"), (hit["g_dist"] / F.lit(MILE_M)).alias("miles")))


def first_and_last(points: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """(by, x0, y0, x1, y1, dx, dy): a track's ends and the vector between them."""
    g = points.groupBy(*by).agg(F.min_by(F.struct(x, y), order).alias("a"), F.max_by(F.struct(x, y), order).alias("b"))
    return g.select(*by, F.col(f"a.{x}").alias("x0"), F.col(f"a.{y}").alias("y0"), F.col(f"b.{x}").alias("x1"), F.col(f"b.{y}").alias("y1"), (F.col(f"b.{x}") - F.col(f"a.{x}")).alias("dx"), (F.col(f"b.{y}") - F.col(f"a.{y}")).alias("dy"))


# --- legs between a core and its outside ------------------------------------------


def node_kinds(routes: DataFrame, nodes: DataFrame, by: Sequence[str], ids: str = "ids") -> DataFrame:
    """``routes`` with ``kinds``, the kind of each node of ``ids`` by (node, kind), OFF_MODEL where it is in no table."""
    seen = routes.select(*by, F.posexplode(ids).alias("_at", "node")).join(nodes.select("node", "kind"), "node", "left")
    listed = seen.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("kind", F.lit(OFF_MODEL)).alias("kind")))), lambda s: s["kind"]).alias("kinds"))
    return routes.join(listed, list(by), "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<int>")))


def first_boundary(kinds: Column) -> Column:
    """Place, from 0, of the first boundary node but the route's own first node; null if there is none."""
    at = F.array_position(F.slice(kinds, F.lit(2), F.greatest(F.size(kinds) - 1, F.lit(0))), F.lit(BOUNDARY))
    return F.when(at > 0, at.cast("int"))


def _sum(values: Column, start: Column, stop: Column) -> Column:
    """Sum of values[start:stop], places from 0."""
    return F.aggregate(F.slice(values, start.cast("int") + 1, F.greatest(stop.cast("int") - start.cast("int"), F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def _leg(seconds: Column, anomaly: Column) -> Column:
    """(seconds, anomaly): null seconds where the leg is discarded or has an anomaly."""
    return F.struct(F.when(anomaly.isNull(), seconds).alias("seconds"), anomaly.alias("anomaly"))


def inbound_leg(ids: Column, kinds: Column, durations: Column, total: Column, goal: Column) -> Column:
    """Of a route from outside to a boundary node: seconds to it if it is the first boundary met, null seconds if another is.

    What the route does after the node is taken off the total, which keeps the penalties in it.
    """
    at = first_boundary(kinds)
    anomaly = F.when(F.element_at(kinds, 1) != OFF_MODEL, "origin lies in the core").when(~F.array_contains(ids, goal), "goal is not on the route").when(at.isNull(), "goal is no boundary")
    return _leg(F.when(F.get(ids, at) == goal, total - _sum(durations, at, F.size(durations))), anomaly)


def _walk(ids: Column, kinds: Column, places: Column | None, origin: Column, goal: Column | None) -> Column:
    """The scan of a route from a boundary node: (end, last, core, at), where ``end`` is goal, other, strayed or null
    at the route's end, ``last`` the origin's last place, ``core`` whether inner nodes came since, ``at`` the place of the end."""
    begin = (F.array_position(ids, origin) - 1).cast("int")
    start = F.struct(F.lit(None).cast("string").alias("end"), begin.alias("last"), F.lit(0.0).alias("far"), F.lit(False).alias("core"), begin.alias("at"))

    def step(acc: Column, i: Column) -> Column:
        node, kind = F.get(ids, i), F.get(kinds, i)
        back = (kind == BOUNDARY) & (node == origin)
        strayed = back & (acc["far"] > LOOP_M)
        met = F.lit(False) if goal is None else (kind == BOUNDARY) & (node == goal)
        end = F.when(strayed, "strayed").when(back, F.lit(None)).when(met, "goal").when(kind == BOUNDARY, "other")
        a, b = (F.get(places, begin), F.get(places, i)) if places is not None else (None, None)
        away = F.lit(0.0) if places is None else F.coalesce(haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]), F.lit(0.0))
        go = F.struct(
            end.alias("end"), F.when(back, i).otherwise(acc["last"]).alias("last"),
            F.when(back, F.lit(0.0)).when(kind == BOUNDARY, acc["far"]).otherwise(F.greatest(acc["far"], away)).alias("far"),
            F.when(back, F.lit(False)).otherwise(acc["core"] | (kind == INTERNAL)).alias("core"), i.alias("at"),
        )
        return F.when(acc["end"].isNotNull(), acc).otherwise(go)

    rest = F.when(F.size(ids) > begin + 1, F.sequence(begin + 1, F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, step)


def _start_anomaly(ids: Column, origin: Column) -> Column:
    at = F.array_position(ids, origin)
    return F.when(at == 0, "origin is not on the route").when(at > 2, "origin comes late")


def outbound_leg(ids: Column, kinds: Column, durations: Column, total: Column, origin: Column, places: Column | None = None) -> Column:
    """Of a route from a boundary node to outside: seconds if it meets no other boundary node, null seconds if it does.

    A loop back to the origin within LOOP_M is taken off; one that strays farther is an anomaly. ``places`` are (lat, lon).
    """
    early = _start_anomaly(ids, origin)
    w = _walk(ids, kinds, places, origin, None)
    return _leg(F.when(early.isNull() & w["end"].isNull(), total - _sum(durations, F.lit(0), w["last"])), F.coalesce(early, F.when(w["end"] == "strayed", "returns to its origin from afar")))


def boundary_shortcut(ids: Column, kinds: Column, durations: Column, total: Column, origin: Column, goal: Column, places: Column | None = None) -> Column:
    """Of a route between boundary nodes: seconds if it reaches the goal first, without inner nodes; null seconds if not."""
    early = F.coalesce(_start_anomaly(ids, origin), F.when(~F.array_contains(ids, goal), "goal is not on the route"))
    w = _walk(ids, kinds, places, origin, goal)
    late = F.when(w["end"] == "strayed", "returns to its origin from afar").when(w["end"].isNull(), "goal is no boundary")
    keep = (w["end"] == "goal") & ~w["core"]
    return _leg(F.when(early.isNull() & keep, total - _sum(durations, w["at"], F.size(durations)) - _sum(durations, F.lit(0), w["last"])), F.coalesce(early, late))


def transits_core(kinds: Column) -> Column:
    """Whether a route between outside places passes a boundary node; null if an end of it lies in the core."""
    ends = (F.element_at(kinds, 1) == OFF_MODEL) & (F.element_at(kinds, -1) == OFF_MODEL)
    return F.when(ends, F.array_contains(kinds, F.lit(BOUNDARY)))


def refuse_anomalies(routes: DataFrame, leg: str) -> DataFrame:
    """``routes`` as they are; reading one whose leg has an anomaly raises an error."""
    fault = F.col(f"{leg}.anomaly")
    return routes.where(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("route for review: "), fault)).cast("boolean")).otherwise(F.lit(True)))


def timed_pairs(origins: DataFrame, goals: DataFrame, times: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, seconds) of each origin with each other goal that a table of times has; the times stand for a routing service."""
    a, b = origins.select(F.col(origins.columns[0]).alias(src)).distinct(), goals.select(F.col(goals.columns[0]).alias(dst)).distinct()
    return times.where(F.col(src) != F.col(dst)).join(a, src, "left_semi").join(b, dst, "left_semi").select(src, dst, "seconds")
