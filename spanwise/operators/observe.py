"""Observation counts: sessions, usability, directions, link totals, residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pearson_z, poisson_deviance, safe_ratio, seconds_between


def dedupe_events(events: DataFrame, keys: Sequence[str] = ("session_id", "event_type", "timestamp")) -> DataFrame:
    return events.dropDuplicates(list(keys))


def sessions(events: DataFrame, session: str, start: Column, end: Column, event_type: str, direction: str, counted: str = "car", single: Column | None = None) -> DataFrame:
    """A row for each session: duration, counts by direction and in all, nulled where a single observer cannot tell.

    A dual session keeps all. A single one without events knows nothing; with events one
    way it knows that way only; with both it is contradictory and knows nothing.
    """
    mine = F.col(event_type) == counted
    s = events.groupBy(session).agg(
        F.min(start).alias("start"), F.max(end).alias("end"),
        F.count_if(mine & (F.col(direction) == "with")).alias("_w"), F.count_if(mine & (F.col(direction) == "against")).alias("_a"),
        (F.max(single.cast("int")) == 1 if single is not None else F.lit(False)).alias("single"),
    )
    w, a, one = F.col("_w"), F.col("_a"), F.col("single")
    return s.select(
        session, "start", "end", seconds_between(F.col("start"), F.col("end")).alias("seconds"), "single",
        F.when(~one | ((w > 0) & (a == 0)), w).alias("with"),
        F.when(~one | ((a > 0) & (w == 0)), a).alias("against"),
        F.when(~one, w + a).alias("total"),
    )


def usable(df: DataFrame, seconds: str, required: Sequence[str], least_s: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """Sessions that are long enough and complete, and one row that counts each reason for leaving one out."""
    short = F.coalesce(F.col(seconds) < least_s, F.lit(True))
    keep = ~short
    for c in required:
        keep = keep & F.col(c).isNotNull()
    report = df.agg(F.count("*").alias("all"), F.count_if(short).alias("short"), *(F.count_if(~short & F.col(c).isNull()).alias(f"no_{c}") for c in required))
    return df.where(keep), report


def combine_by_link(df: DataFrame, by: Sequence[str], value: str, sigma: str, detail: Sequence[str] = ()) -> DataFrame:
    """Inverse-variance mean of each link's estimates; ``detail`` columns are kept as a list of observations."""
    q = safe_ratio(F.lit(1.0), F.col(sigma) * F.col(sigma))
    extra = [F.collect_list(F.struct(*detail)).alias("observations")] if detail else []
    s = df.groupBy(*by).agg(F.sum(q * F.col(value)).alias("_x"), F.sum(q).alias("_q"), F.count("*").alias("n"), *extra)
    return s.select(*by, safe_ratio(F.col("_x"), F.col("_q"), None).alias("mean"), (F.lit(1.0) / F.sqrt(F.when(F.col("_q") > 0, F.col("_q")))).alias("sigma"), "n", *(["observations"] if detail else []))


def predicted_count(model: DataFrame, shape: DataFrame, slot: Sequence[str], seconds: Column) -> DataFrame:
    """Model flows by component times the hour's fraction, for so many seconds; a slot without a fraction is 1/24."""
    j = model.join(shape, ["component", *slot], "left")
    return j.withColumn("predicted", seconds / F.lit(3600.0) * F.col("flow") * F.coalesce("fraction", F.lit(1.0 / 24)))


def residuals(df: DataFrame, predicted: str, n_effective: str) -> DataFrame:
    """``df`` with the Pearson z and the Poisson deviance of each observation."""
    return df.withColumn("z", pearson_z(F.col(predicted), F.col(n_effective))).withColumn("deviance", poisson_deviance(F.col(predicted), F.col(n_effective)))


def chi_square(df: DataFrame, by: Sequence[str] = (), z: str = "z") -> DataFrame:
    """Counts and squares of z: n, chi2, mean square, extremes, mean size, and how many exceed 2 and 3."""
    c = F.col(z)
    return df.groupBy(*by).agg(F.count(z).alias("n"), F.sum(c * c).alias("chi2"), F.avg(c * c).alias("mean_z2"), F.min(c).alias("min_z"), F.max(c).alias("max_z"), F.max(F.abs(c)).alias("max_abs_z"), F.avg(F.abs(c)).alias("mean_abs_z"), F.count_if(F.abs(c) > 2).alias("over_2"), F.count_if(F.abs(c) > 3).alias("over_3"))


def slot_chi_square(df: DataFrame, slot: Sequence[str], r: str, sigma: str, prior_sigma: str, slope: str) -> DataFrame:
    """Chi-square where a slot's observations share an uncertain fraction, by the rank-one inverse of its covariance."""
    q = F.lit(1.0) / (F.col(sigma) * F.col(sigma))
    s = df.groupBy(*slot).agg(F.sum(q * F.col(r) * F.col(r)).alias("rr"), F.sum(q * F.col(r) * F.col(slope)).alias("rs"), F.sum(q * F.col(slope) * F.col(slope)).alias("ss"), F.max(prior_sigma).alias("p"), F.count("*").alias("n"))
    v = F.col("p") * F.col("p")
    return s.select(*slot, "n", (F.col("rr") - v * F.col("rs") * F.col("rs") / (F.lit(1.0) + v * F.col("ss"))).alias("chi2"))


def recent_fix(events: DataFrame, fixes: DataFrame, session: str, ts: str, fix_ts: str, within_s: float = 60.0) -> DataFrame:
    """Each event with the latest fix of its session at or before it, if within so many seconds.

    Times are cut into windows of that length, so an event meets the fixes of two windows
    and not of a whole session.
    """
    def cell(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(within_s * 1e6)).cast("long")

    # Equal event rows are counted and put back at the end: each stays, and none needs a number.
    once = events.select(F.struct(*events.columns).alias("_id")).groupBy("_id").agg(F.count("*").alias("_n"))
    e = once.select("_id", "_n", F.col(f"_id.{session}").alias("_key"), F.col(f"_id.{ts}").alias("_at"))
    e = e.withColumn("_cell", F.explode(F.array(cell("_at"), cell("_at") - 1)))
    f = fixes.select(F.col(session).alias("_s"), F.col(fix_ts).alias("_t"), F.struct(*fixes.columns).alias("_fix"), cell(fix_ts).alias("_c"))
    gap = seconds_between(F.col("_t"), F.col("_at"))
    j = e.join(f, (F.col("_key") == F.col("_s")) & (F.col("_cell") == F.col("_c")) & (gap >= 0) & (gap <= within_s), "left")
    # Of fixes at one time the greatest as a text.
    best = j.groupBy("_id").agg(F.max("_n").alias("_n"), F.max_by("_fix", F.struct("_t", F.to_json("_fix"))).alias("fix"))
    return best.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int")))).select("_id.*", "fix")


def map_match(points: DataFrame, edges: DataFrame, session: str = "session_id", accuracy: str = "accuracy", reach: float = 200.0) -> DataFrame:
    """(session, edge, rmse): of each track, the edge with the least accuracy-weighted squared distance.

    ``points`` has x and y in metres, ``edges`` edge, x1, y1, x2 and y2. Edges within
    ``reach`` of any point of a track, found by grid cells, are compared on all its points;
    a track without such an edge has no row.
    """
    from .spatial import segment_distance

    cell = lambda c: F.floor(c / F.lit(float(reach))).cast("long")
    span = lambda a, b: F.sequence(cell(F.least(a, b)) - 1, cell(F.greatest(a, b)) + 1)
    spread = edges.select("edge", F.explode(span("x1", "x2")).alias("cx"), "y1", "y2").select("edge", "cx", F.explode(span("y1", "y2")).alias("cy"))
    near = points.select(session, cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")).distinct().join(spread, ["cx", "cy"]).select(session, "edge").distinct()
    q = F.lit(1.0) / (F.col(accuracy) * F.col(accuracy))
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    cost = points.join(near.join(edges, "edge"), session).groupBy(session, "edge").agg(F.sum(d * d * q).alias("cost"), F.sum(q).alias("q"))
    best = cost.groupBy(session).agg(F.min_by(F.struct("edge", "cost", "q"), F.struct("cost", "edge")).alias("b"))
    return best.select(session, F.col("b.edge").alias("edge"), F.sqrt(F.col("b.cost") / F.col("b.q")).alias("rmse"))


def site_readout(sites: DataFrame, link_flows: DataFrame, site: str = "site", links: str = "links") -> DataFrame:
    """(site, flow): modelled flow summed over each site's list of (u, v) links, 0 for links without any."""
    one = sites.select(site, F.explode(links).alias("l")).select(site, F.col("l.u").alias("u"), F.col("l.v").alias("v"))
    return one.join(link_flows.select("u", "v", "flow"), ["u", "v"], "left").groupBy(site).agg(F.sum(F.coalesce("flow", F.lit(0.0))).alias("flow"))
