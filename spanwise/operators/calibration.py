"""The nested calibration: kernels by Powell's method outside, component scales by a convex solve inside.

A component's flows follow its willingness kernel; an observation sees the flows that pass it.
For given kernels the predictions are linear in the components' scales, so these are
solved for, and only the kernels are searched. All kernels that a line search tries are
evaluated by one Spark job (``predictions``): pairs meet the sets by a broadcast of bounded size,
denominators are aggregates by origin, and what reaches the driver is a number for each set,
observation and component. The solves and the steps of the search are small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage

#: Parameter sets of a job, and numbers that it may return to the driver.
MAX_SETS, MAX_NUMBERS = 10_000, 5_000_000
#: Standard deviations of the logs of a kernel's short time, of that of its long time, and of the logit of its mix.
FLOORS = (0.182, 0.693, 0.693)

Kernel = tuple[float, float, float]


def to_internal(kernel: Kernel) -> np.ndarray:
    """(short time, long time, mix) as logs and a logit."""
    short, long, mix = kernel
    mix = min(max(mix, 1e-6), 1 - 1e-6)
    return np.array([np.log(max(short, 1e-4)), np.log(max(long, 1e-4)), np.log(mix / (1 - mix))])


def from_internal(x: np.ndarray) -> Kernel:
    """The kernel, its long time no shorter than its short one."""
    x = np.clip(x, -100, 100)
    return float(np.exp(x[0])), float(np.exp(max(x[0], x[1]))), float(1 / (1 + np.exp(-x[2])))


def mixed_exponential(t: Column) -> Column:
    """The share of those willing to go ``t`` by a set's columns short, long and mix."""
    return F.col("mix") * F.exp(-t / F.col("short")) + (1 - F.col("mix")) * F.exp(-t / F.col("long"))


def predictions(pairs: DataFrame, incidence: DataFrame, sets: DataFrame, factor: Column | None = None) -> DataFrame:
    """(set, obs, component, flow): singly constrained flows past each observation, for each set of kernels.

    ``pairs`` are (component, pair, src, t, produced, attracted), ``incidence`` (pair, obs, share), ``sets``
    (set, component, short, long, mix), at most MAX_SETS sets. ``factor`` multiplies the kernel, a Column of ``pairs``.
    An origin that reaches nothing sends nothing.
    """
    if sets.select("set").distinct().limit(MAX_SETS + 1).count() > MAX_SETS:
        raise ValueError(f"a job takes {MAX_SETS} parameter sets")
    return _flows(*folded(pairs, incidence, factor), sets)


def folded(pairs: DataFrame, incidence: DataFrame, factor: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What kernels need to know: (component, src, t, attracted) and (component, src, t, obs, seen), sums over pairs of equal time."""
    pull = F.col("attracted") if factor is None else F.col("attracted") * factor
    reach = pairs.groupBy("component", "src", "t").agg(F.sum(pull).alias("attracted"))
    seen = pairs.withColumn("_pull", F.col("produced") * pull).join(incidence, "pair").groupBy("component", "src", "t", "obs").agg(F.sum(F.col("_pull") * F.col("share")).alias("seen"))
    return reach, seen


def _flows(reach: DataFrame, seen: DataFrame, sets: DataFrame) -> DataFrame:
    """``predictions`` of folded tables."""
    f, sets = mixed_exponential(F.col("t")), F.broadcast(sets)
    den = reach.join(sets, "component").groupBy("set", "component", "src").agg(F.sum(F.col("attracted") * f).alias("_den"))
    num = seen.join(sets, "component").groupBy("set", "component", "src", "obs").agg(F.sum(F.col("seen") * f).alias("_num"))
    flow = num.join(den, ["set", "component", "src"]).withColumn("_f", F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0)))
    return flow.groupBy("set", "obs", "component").agg(F.sum("_f").alias("flow"))


def scale_precision(sampling: np.ndarray, common: float, split: float) -> np.ndarray:
    """Precision of the scales about 1: loose (``common``) where all move together, elsewhere the sampling covariance and ``split``."""
    n = len(sampling)
    u = np.full((n, n), 1 / n)
    off = np.eye(n) - u
    out = np.linalg.pinv(off @ sampling @ off + common**2 * u + split**2 * off)
    return (out + out.T) / 2


def kernel_precision(sampling: Sequence[np.ndarray], floors: Sequence[float] = FLOORS) -> np.ndarray:
    """Block-diagonal precision of the kernels' internal parameters: of each, its covariance on top of the floors."""
    n = len(floors)
    out = np.zeros((n * len(sampling), n * len(sampling)))
    for i, c in enumerate(sampling):
        block = np.linalg.pinv(np.asarray(c, float) + np.diag(np.square(floors)))
        out[n * i : n * (i + 1), n * i : n * (i + 1)] = (block + block.T) / 2
    return out


@dataclass
class Observations:
    """What was seen: ``value`` with a Gaussian ``weight``, or as a count where ``counted``."""

    value: np.ndarray
    weight: np.ndarray
    counted: np.ndarray

    def misfit(self, flow: np.ndarray, scales: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted squares and Poisson deviance, with gradient and Hessian by the scales."""
        m, c = flow @ scales, self.counted
        r = m - self.value
        p, n = np.maximum(m[c], 1e-30), self.value[c]
        with np.errstate(divide="ignore", invalid="ignore"):
            deviance = 2 * np.where(n > 0, n * np.log(n / p) + p - n, p)
        w = np.where(c, 0.0, self.weight)
        slope, curve = 2 * w * r, 2 * w
        slope[c], curve[c] = 2 * (1 - n / p), 2 * n / p**2
        return float(w @ (r * r) + deviance.sum()), flow.T @ slope, (flow.T * curve) @ flow

    def solve(self, flow: np.ndarray, precision: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, float]:
        """Scales above 0 of the least misfit plus their prior about 1, by damped Newton steps with backtracking, and that misfit."""

        def whole(k):
            v, g, h = self.misfit(flow, k)
            d = k - 1
            return v + d @ precision @ d, g + 2 * precision @ d, h + 2 * precision

        k = np.ones(flow.shape[1]) if start is None else np.maximum(start, 1e-30)
        value, g, h = whole(k)
        for _ in range(rounds):
            damp = 1e-9 * (np.trace(h) / len(k) + 1)
            step, t = np.linalg.lstsq(h + damp * np.eye(len(k)), -g, rcond=None)[0], 1.0
            for _ in range(40):
                near = np.maximum(k + t * step, 1e-30)
                trial = whole(near)
                if trial[0] < value - 1e-12 * abs(value):
                    break
                t /= 2
            else:
                break
            moved = np.abs(near - k).max()
            k, (value, g, h) = near, trial
            if moved < 1e-10 * np.abs(k).max():
                break
        return k, self.misfit(flow, k)[0]


def powell_batched(score: Callable[[np.ndarray], np.ndarray], x: np.ndarray, reach: float = 0.7, points: int = 9, narrowings: int = 3, rounds: int = 20, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Powell's method whose line searches evaluate ``points`` places at a time: ``score`` takes rows of parameters.

    A line is searched on an even grid around the best place, which is then narrowed to its
    neighbours; a direction that turned out well replaces the one that gained most.
    """
    x = np.asarray(x, float)
    dirs, best = np.eye(len(x)), float(score(x[None])[0])

    def line(at: np.ndarray, d: np.ndarray, value: float) -> tuple[np.ndarray, float]:
        mid, half = 0.0, reach
        for _ in range(narrowings):
            t = np.linspace(mid - half, mid + half, points)
            v = score(at + t[:, None] * d)
            i = int(np.nanargmin(v))
            edge = i in (0, points - 1)
            if v[i] < value:
                mid, value = float(t[i]), float(v[i])
            # At the edge the range moves on, else it closes in.
            half = half if edge and v[i] <= value else 2 * half / (points - 1)
        return at + mid * d, value

    for _ in range(rounds):
        start, first, drop, worst = x.copy(), best, 0.0, 0
        for i, d in enumerate(dirs):
            before = best
            x, best = line(x, d, best)
            if before - best > drop:
                drop, worst = before - best, i
        if first - best <= tol * (abs(first) + abs(best)) + 1e-12:
            break
        move = x - start
        if np.abs(move).max() > 0:
            x, best = line(x, move / np.linalg.norm(move), best)
            dirs[worst] = move / np.linalg.norm(move)
        reach = max(reach / 2, 0.05)
    return x, best


@dataclass
class Fit:
    """Kernels and scales by component, the objective there, and how many sets and jobs it took."""

    kernels: dict[str, Kernel]
    scales: dict[str, float]
    objective: float
    jobs: int
    sets: int
    trace: list[float] = field(default_factory=list)


def calibrate(pairs: DataFrame, incidence: DataFrame, observed: DataFrame, start: Mapping[str, Kernel], kernel_prior: np.ndarray, scale_prior: np.ndarray, anchor: Mapping[str, Kernel] | None = None, factor: Column | None = None, **search) -> Fit:
    """Kernels of the least misfit plus their prior about ``anchor`` (by default ``start``), each with its own best scales.

    ``observed`` is (obs, value, weight, counted): a value with a Gaussian weight, or a count. Tables are folded to sums by
    origin and time once, and jobs read these. ValueError if an observation has no value, or if a job would return more than
    MAX_NUMBERS numbers.
    """
    names = list(start)
    rows = observed.select("obs", F.col("value").cast("double"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce("counted", F.lit(False)).alias("counted")).orderBy("obs").limit(MAX_NUMBERS + 1).collect()
    if not rows or any(r["value"] is None or not np.isfinite(r["value"]) for r in rows):
        raise ValueError("observations need values")
    seen = Observations(np.array([r["value"] for r in rows]), np.array([r["weight"] for r in rows]), np.array([r["counted"] for r in rows]))
    place, column = {r["obs"]: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(names)}
    x0 = np.concatenate([to_internal(start[c]) for c in names])
    centre = np.concatenate([to_internal((anchor or start)[c]) for c in names])
    # Jobs read sums by origin and time, written once, in which nothing of single pairs is left.
    reach, past = (cut_lineage(x) for x in folded(pairs, incidence, factor))
    out = Fit({}, {}, np.inf, 0, 0)
    warm: list[np.ndarray | None] = [None]

    def score(x: np.ndarray) -> np.ndarray:
        if len(x) > MAX_SETS:
            raise ValueError(f"a job takes {MAX_SETS} parameter sets")
        if len(x) * len(rows) * len(names) > MAX_NUMBERS:
            raise ValueError(f"more than {MAX_NUMBERS} numbers in a job")
        out.jobs, out.sets = out.jobs + 1, out.sets + len(x)
        table = [(i, c, *from_internal(p[3 * j : 3 * j + 3])) for i, p in enumerate(x) for j, c in enumerate(names)]
        sets = pairs.sparkSession.createDataFrame(table, "set int, component string, short double, long double, mix double")
        flow = np.zeros((len(x), len(rows), len(names)))
        for r in _flows(reach, past, sets).collect():
            if r["obs"] in place:
                flow[r["set"], place[r["obs"]], column[r["component"]]] = r["flow"]
        values = np.empty(len(x))
        for i, p in enumerate(x):
            k, misfit = seen.solve(flow[i], scale_prior, warm[0])
            d = p - centre
            values[i] = misfit + d @ kernel_prior @ d
            if values[i] < out.objective:
                out.objective, warm[0] = float(values[i]), k
                out.kernels = {c: from_internal(p[3 * j : 3 * j + 3]) for j, c in enumerate(names)}
                out.scales = dict(zip(names, k.tolist()))
        out.trace.append(out.objective)
        return values

    powell_batched(score, x0, **search)
    return out
