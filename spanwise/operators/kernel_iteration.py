"""A kernel found from trip lengths alone: balance, density of places, willingness, refit, and again.

Trips by length are the places that could be reached at that length, times the willingness
to go so far. The places count by the balancing factors, which depend on the kernel, so
the two are found together: a round balances flows under the present kernel, sums the
density of places by time, divides the observed trips by it, refits the kernel to that
willingness, and goes part of the way there. Balancing and histograms are aggregates over
the pairs; each round's factors are written and the round before's deleted; the driver
sees a row for each time bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage, discard
from .calibrate import damped, levenberg_marquardt

Cut = Callable[[DataFrame], DataFrame]
#: Rounds at most, sweeps of a round's balance, the part of the way that a round goes, and the relative change that ends it.
ROUNDS, SWEEPS, DAMPING, TOLERANCE = 30, 3, 0.5, 0.01


def balancing_factors(cells: DataFrame, origins: DataFrame, destinations: DataFrame, sweeps: int = SWEEPS, cut: Cut = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """(src, a) and (dst, b) of sampled cells (src, dst, f): a = 1 / sum of b f by origin, b = D / sum of a O f by destination.

    ``origins`` are (src, O), ``destinations`` (dst, D). Only the product of a and b means anything, so after each
    sweep a is scaled to a mean of 1 over the origins that reach anything, which fixes the gauge and keeps factors
    from drifting; a last step scales a so that the cells' sums by origin hold. Factors of what nothing reaches are 0.
    """
    inverse = lambda top, s: F.when(F.col(s) > 0, top / F.col(s)).otherwise(F.lit(0.0))
    massed = cut(cells.join(origins.select("src", F.col("O").cast("double").alias("O")), "src").join(destinations.select("dst", F.col("D").cast("double").alias("D")), "dst").select("src", "dst", "f", "O", "D"))
    b = massed.select("dst").distinct().withColumn("b", F.lit(1.0))

    def rows(b: DataFrame) -> DataFrame:
        return massed.join(b, "dst").groupBy("src").agg(F.sum(F.col("b") * F.col("f")).alias("_s")).select("src", inverse(F.lit(1.0), "_s").alias("a"))

    for _ in range(sweeps):
        a = cut(rows(b))
        mean = a.where("a > 0").agg(F.avg("a").alias("_mean"))  # one row
        scaled = a.crossJoin(F.broadcast(mean)).select("src", F.coalesce(F.col("a") / F.col("_mean"), F.lit(0.0)).alias("a"))
        s = massed.join(scaled, "src").groupBy("dst").agg(F.sum(F.col("a") * F.col("O") * F.col("f")).alias("_s"), F.first("D").alias("D"))
        new = cut(s.select("dst", inverse(F.col("D"), "_s").alias("b")))
        discard(a, b)
        b = new
    a = cut(rows(b))
    discard(massed)
    return a, b


def mean_reach(cells: DataFrame) -> DataFrame:
    """(src, reach): the mean of f over each origin's sampled cells; where that is none, the median of the others'."""
    own = cells.groupBy("src").agg(F.avg("f").alias("_m"))
    middle = own.where("_m > 0").agg(F.expr("percentile(_m, 0.5)").alias("_mid"))  # one row
    return own.crossJoin(F.broadcast(middle)).select("src", F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.col("_mid")).alias("reach"))


def density(cells: DataFrame, origins: DataFrame, destinations: DataFrame, width: float, doubly: bool = True, sweeps: int = SWEEPS, cut: Cut = cut_lineage) -> DataFrame:
    """(bin, places): what could be reached in each time bin under the cells' kernel values ``f``: O a b, or O / reach where only origins bind.

    ``cells`` are (src, dst, t, f), ``bin`` is floor(t / width).
    """
    slot = F.floor(F.col("t") / F.lit(float(width))).cast("long").alias("bin")
    o = origins.select("src", F.col("O").cast("double").alias("O"))
    if doubly:
        a, b = balancing_factors(cells, origins, destinations, sweeps, cut)
        return cells.join(o, "src").join(a, "src").join(b, "dst").groupBy(slot).agg(F.sum(F.col("O") * F.col("a") * F.col("b")).alias("places"))
    n = cells.groupBy("src").agg(F.count("*").alias("_n"))
    return cells.join(o, "src").join(mean_reach(cells), "src").join(n, "src").groupBy(slot).agg(F.sum(F.col("O") / F.col("reach") / F.col("_n")).alias("places"))


def willingness(trips: DataFrame, places: DataFrame) -> DataFrame:
    """(bin, trips, places, willing): trips (bin, trips) by place; bins without either are left out."""
    j = trips.join(places, "bin").where("trips > 0 and places > 0")
    return j.select("bin", "trips", "places", (F.col("trips") / F.col("places")).alias("willing"))


def kernel(t: Column, w: float, tau_s: float, tau_l: float) -> Column:
    return F.lit(w) * F.exp(-t / F.lit(tau_s)) + F.lit(1 - w) * F.exp(-t / F.lit(tau_l))


def fit_warm(t: np.ndarray, y: np.ndarray, weight: np.ndarray, start: dict[str, float]) -> dict[str, float]:
    """{log_a, w, tau_s, tau_l} of a scaled mix of two exponentials through weighted logs, from where the last fit ended."""
    root = np.sqrt(weight / weight.max())

    def parts(p):
        ts = np.exp(np.clip(p[2], -50, 50))
        return 1 / (1 + np.exp(-np.clip(p[1], -50, 50))), ts, ts + np.exp(np.clip(p[3], -50, 50))

    def residual(p):
        mix, ts, tl = parts(p)
        return root * (np.log(np.maximum(mix * np.exp(-t / ts) + (1 - mix) * np.exp(-t / tl), 1e-300)) + p[0] - np.log(y))

    w = min(max(start["w"], 1e-4), 1 - 1e-4)
    level = float(np.average(np.log(y) - np.log(np.maximum(w * np.exp(-t / start["tau_s"]) + (1 - w) * np.exp(-t / start["tau_l"]), 1e-300)), weights=weight))
    p, _ = levenberg_marquardt(residual, np.array([level, np.log(w / (1 - w)), np.log(start["tau_s"]), np.log(max(start["tau_l"] - start["tau_s"], 1e-3))]))
    mix, ts, tl = parts(p)
    return {"log_a": float(p[0]), "w": float(mix), "tau_s": float(ts), "tau_l": float(tl)}


def fit_single(t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """The same for one exponential, a weighted line through the logs."""
    a = np.column_stack((np.ones(len(t)), t)) * np.sqrt(weight)[:, None]
    level, slope = np.linalg.lstsq(a, np.log(y) * np.sqrt(weight), rcond=None)[0]
    return {"log_a": float(level), "w": 1.0, "tau_s": float(-1 / min(slope, -1e-12)), "tau_l": 1e9}


@dataclass
class Found:
    """The kernel, whether it settled, and each round's fit and change; where it did not settle, the rounds' medians."""

    kernel: dict[str, float]
    converged: bool
    trace: list[dict[str, float]] = field(default_factory=list)


def iterate(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, trips: DataFrame, width: float, start: dict[str, float], doubly: bool = True, single: bool = False, factor: Column | None = None, rounds: int = ROUNDS, sweeps: int = SWEEPS, damping: float = DAMPING, tolerance: float = TOLERANCE, bins: int = 100_000, cut: Cut = cut_lineage, keys: Sequence[str] = ("w", "tau_s", "tau_l")) -> Found:
    """The kernel under which balanced flows over ``pairs`` (src, dst, t) have the observed ``trips`` (bin, trips) by time.

    ``factor`` is a known part of the kernel, a Column of the pair's t, such as a drive share. The first round starts at ``start``
    (w, tau_s, tau_l). ValueError if no bin has both trips and places, or beyond ``bins`` bins.
    """
    now, out = dict(start), Found({}, False)
    part = F.lit(1.0) if factor is None else factor
    for i in range(rounds):
        cells = pairs.select("src", "dst", "t", (kernel(F.col("t"), *(now[k] for k in keys)) * part).alias("f"))
        seen = willingness(trips, density(cells, origins, destinations, width, doubly, sweeps, cut)).orderBy("bin").limit(bins + 1).collect()
        if not seen or len(seen) > bins:
            raise ValueError(f"{len(seen)} time bins; between 1 and {bins} are needed")
        at = np.array([r["bin"] for r in seen]) * width + width / 2
        y, weight = np.array([r["willing"] for r in seen]), np.array([r["trips"] for r in seen])
        if factor is not None:
            known = {r["bin"]: r["k"] for r in pairs.groupBy(F.floor(F.col("t") / F.lit(float(width))).cast("long").alias("bin")).agg(F.avg(factor).alias("k")).limit(bins + 1).collect()}
            y = y / np.array([known[r["bin"]] for r in seen])
        new = fit_single(at, y, weight) if single else fit_warm(at, y, weight, now)
        change = max(abs(new[k] - now[k]) / max(abs(now[k]), 1e-9) for k in keys)
        out.trace.append({"round": i, **new, "change": change})
        now = damped({k: now[k] for k in keys}, {k: new[k] for k in keys}, damping)
        if change < tolerance:
            out.converged = True
            break
    out.kernel = {k: now[k] for k in keys} if out.converged else {k: median(r[k] for r in out.trace) for k in keys}
    return out
