"""A calibration's objective, summed in Spark for many parameter sets at once, and its search by narrowing grids.

The objective of a parameter set is the deviance of the counts that it predicts, plus the
squared standardised distances of the parameters, or of their logs, from their priors. All
sets of a round are evaluated in one job: observations are read once and meet the sets by a
broadcast of bounded size; sums are made where the rows are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import gaussian_z, poisson_deviance

#: Parameter sets of a round.
MAX_SETS = 10_000
#: A parameter's prior: its mean, its standard deviation, and whether both are of its log.
Prior = tuple[float, float, bool]


def parameter_grid(spark: SparkSession, axes: Mapping[str, list[float]]) -> DataFrame:
    """A row for each combination of the axes' values; ValueError beyond MAX_SETS."""
    sets = list(itertools.product(*axes.values()))
    if len(sets) > MAX_SETS:
        raise ValueError(f"{len(sets)} parameter sets; a round takes {MAX_SETS}")
    return spark.createDataFrame([tuple(map(float, s)) for s in sets], ", ".join(f"{c} double" for c in axes))


def prior_penalty(priors: Mapping[str, Prior]) -> Column:
    """Sum of squared standardised distances from the priors."""
    out = F.lit(0.0)
    for name, (mean, sd, of_log) in priors.items():
        z = gaussian_z(F.log(F.col(name)) if of_log else F.col(name), F.lit(float(mean)), F.lit(float(sd)))
        out = out + z * z
    return out


def objective(observations: DataFrame, sets: DataFrame, predicted: Column, n_effective: Column, priors: Mapping[str, Prior], weight: Column | None = None) -> DataFrame:
    """(parameters, deviance, penalty, objective) of each parameter set; ``predicted`` is a Column of an observation's and a set's columns."""
    w = F.lit(1.0) if weight is None else weight
    names = sets.columns
    sums = observations.crossJoin(F.broadcast(sets)).groupBy(*names).agg(F.sum(w * poisson_deviance(predicted, n_effective)).alias("deviance"))
    scored = sums.withColumn("penalty", prior_penalty(priors))
    return scored.withColumn("objective", F.col("deviance") + F.col("penalty"))


def search(observations: DataFrame, axes: Mapping[str, tuple[float, float]], predicted: Column, n_effective: Column, priors: Mapping[str, Prior], points: int = 9, rounds: int = 8, weight: Column | None = None) -> dict[str, float]:
    """The parameters of the least objective, by grids that narrow around the best set; one Spark job and one row a round."""
    spark = observations.sparkSession
    low = {k: float(a) for k, (a, _) in axes.items()}
    high = {k: float(b) for k, (_, b) in axes.items()}
    bounds = dict(axes)
    best: dict[str, float] = {}
    for _ in range(rounds):
        grid = parameter_grid(spark, {k: np.linspace(low[k], high[k], points).tolist() for k in axes})
        top = objective(observations, grid, predicted, n_effective, priors, weight).where("objective is not null and not isnan(objective)").orderBy("objective", *axes).limit(1).first()
        if top is None:
            raise ValueError("no observations, or no parameter set with an objective")
        best = {k: top[k] for k in axes}
        for k, (a, b) in bounds.items():
            step = (high[k] - low[k]) / (points - 1)
            low[k], high[k] = max(a, best[k] - step), min(b, best[k] + step)
    return best


def legs(observations: DataFrame, by: str, sets: DataFrame, predicted: Column, n_effective: Column) -> DataFrame:
    """(leg, parameters, deviance, n): the objective's data part by leg."""
    g = observations.crossJoin(F.broadcast(sets)).groupBy(F.col(by).alias("leg"), *sets.columns)
    return g.agg(F.sum(poisson_deviance(predicted, n_effective)).alias("deviance"), F.count("*").alias("n"))


def sweep(score: Callable[[dict[str, float]], float], at: Mapping[str, float], steps: Mapping[str, list[float]]) -> list[tuple[str, float, float]]:
    """(parameter, value, score): one parameter at a time along its steps, the others as they are."""
    return [(k, v, score({**at, k: v})) for k, values in steps.items() for v in values]


# --- fits of factors and curves ----------------------------------------------------

#: A batch's residuals, their derivatives by the parameters, and weights, at given parameters.
Residuals = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sums(df: DataFrame, residuals: Residuals, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted square of the residuals, and the means of J'Wr and J'WJ; one job, n * (n + 1) + 2 numbers."""
    n = len(theta)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + n + n * n)
        for f in frames:
            r, j, w = residuals(f, theta)
            total += np.concatenate(([w @ (r * r), w.sum()], j.T @ (w * r), ((j * w[:, None]).T @ j).ravel()))
        yield pd.DataFrame({"part": [total.tolist()]})

    parts = df.mapInPandas(run, "part array<double>").select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    v = np.zeros(2 + n + n * n)
    for row in parts.collect():
        v[row["at"]] = row["x"]
    w = v[1] or 1.0
    return v[0] / w, v[2 : 2 + n] / w, v[2 + n :].reshape(n, n) / w


def fit_logs(df: DataFrame, residuals: Residuals, n: int, ridge: float, low: float, high: float, rounds: int = 40, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """(log factors, loss): least mean square of residuals plus ``ridge`` times the squares of the logs, within bounds.

    Damped Gauss-Newton; each round is one aggregate over the rows, which are cached for them.
    """
    df = df.persist()
    try:
        theta, damp = np.zeros(n), 1e-3
        loss, g, h = _sums(df, residuals, theta)
        loss += ridge * float(theta @ theta)
        for _ in range(rounds):
            a = h + ridge * np.eye(n)
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-9)), -(g + ridge * theta), rcond=None)[0]
            new = np.clip(theta + step, low, high)
            other, g2, h2 = _sums(df, residuals, new)
            other += ridge * float(new @ new)
            if other < loss:
                done = loss - other <= tolerance * max(loss, 1e-30)
                theta, loss, g, h, damp = new, other, g2, h2, damp / 3
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e9 or np.abs(new - theta).max() < 1e-12:
                    break
        return theta, loss
    finally:
        df.unpersist()


def active_buckets(routes: DataFrame, length_by_bucket: str, weight: Column, least_km: float) -> list[str]:
    """Buckets with enough weighted length to tell their factor, in order; at most one for each class and band."""
    long = routes.select(weight.alias("w"), F.explode(length_by_bucket).alias("bucket", "metres"))
    kept = long.groupBy("bucket").agg(F.sum(F.col("w") * F.col("metres")).alias("m")).where(F.col("m") >= least_km * 1000).orderBy("bucket")
    return [x["bucket"] for x in kept.select("bucket").collect()]


def fit_bucket_factors(routes: DataFrame, length_by_bucket: str, other_seconds: Column, observed: Column, weight: Column, least_km: float, ridge: float = 1e-3, low: float = -2.0, high: float = 2.0) -> tuple[dict[str, float], float]:
    """(factor of each active bucket, loss): logs of predicted over observed times, least in weighted squares.

    A prediction is each active bucket's base seconds times its factor, the other buckets' seconds, and ``other_seconds``.
    """
    from .routes import edge_seconds

    active = active_buckets(routes, length_by_bucket, weight, least_km)
    at = lambda b: F.coalesce(F.try_element_at(length_by_bucket, F.lit(b)), F.lit(0.0))
    own = F.array(*(edge_seconds(F.create_map(F.lit(b), at(b))) for b in active)).cast("array<double>")
    fixed = edge_seconds(F.map_filter(length_by_bucket, lambda k, v: ~k.isin(*active))) + other_seconds
    rows = routes.select(own.alias("own"), fixed.alias("fixed"), F.log(observed).alias("goal"), weight.cast("double").alias("w"))

    def residuals(f: pd.DataFrame, theta: np.ndarray):
        x = np.array(f["own"].tolist(), float).reshape(len(f), len(theta)) * np.exp(theta)
        total = x.sum(axis=1) + f["fixed"].to_numpy(float)
        return np.log(total) - f["goal"].to_numpy(float), x / total[:, None], f["w"].to_numpy(float)

    theta, loss = fit_logs(rows, residuals, len(active), ridge, low, high)
    return dict(zip(active, np.exp(theta).tolist())), loss


def fit_preferences(pairs: DataFrame, chosen: str, other: str, classes: list[str], margin: float, ridge: float = 1e-3, low: float = np.log(0.33), high: float = np.log(3.0)) -> tuple[dict[str, float], float]:
    """(factor of each class, loss): a chosen route's cost below the faster one's by ``margin`` in logs, least in squared shortfalls.

    ``chosen`` and ``other`` are maps of seconds by class.
    """
    vector = lambda c: F.array(*(F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0.0)) for k in classes))
    rows = pairs.select(vector(chosen).alias("a"), vector(other).alias("b"))

    def residuals(f: pd.DataFrame, theta: np.ndarray):
        a, b = (np.array(f[c].tolist(), float).reshape(len(f), len(theta)) * np.exp(theta) for c in ("a", "b"))
        s, t = np.maximum(a.sum(axis=1), 1e-9), np.maximum(b.sum(axis=1), 1e-9)
        short = np.log(s) - np.log(t) + margin
        return np.maximum(short, 0.0), np.where((short > 0)[:, None], a / s[:, None] - b / t[:, None], 0.0), np.ones(len(f))

    theta, loss = fit_logs(rows, residuals, len(classes), ridge, low, high)
    return dict(zip(classes, np.exp(theta).tolist())), loss


def fit_share_curve(df: DataFrame, distance: str, outcome: str, weight: str, cap: float, bins: int = 2000, start: tuple[float, float, float] = (0.58, 1.0, 1.3), low: tuple[float, float, float] = (0.2, 0.1, 0.5), high: tuple[float, float, float] = (0.98, 30.0, 6.0)) -> tuple[float, float, float]:
    """(plateau, scale, shape) of ``plateau * (1 - exp(-(d / scale) ** shape))``, the most likely for weighted outcomes of 0 or 1.

    Rows are summed into narrow bins of distance, at their mean; only those reach the driver.
    """
    from .calibrate import powell

    own = df.where((F.col(distance) <= cap) & (F.col(weight) > 0))
    b = F.floor(F.col(distance) / F.lit(cap) * bins)
    w, d, y = F.col(weight), F.col(distance), F.col(outcome)
    rows = own.groupBy(b.alias("b")).agg(F.sum(w).alias("w"), (F.sum(w * d) / F.sum(w)).alias("d"), F.sum(w * y).alias("y")).collect()
    ws, ds, ys = (np.array([x[c] for x in rows], float) for c in ("w", "d", "y"))
    lo, hi = np.array(low), np.array(high)

    def loss(x: np.ndarray) -> float:
        p = np.clip(x, lo, hi)
        out = ((x - p) ** 2).sum() * ws.sum()  # outside the bounds
        share = np.clip(p[0] * (1 - np.exp(-((ds / p[1]) ** p[2]))), 1e-9, 1 - 1e-9)
        return float(out - (ys * np.log(share) + (ws - ys) * np.log(1 - share)).sum())

    best = np.clip(powell(loss, np.array(start, float)), lo, hi)
    return tuple(float(x) for x in best)
