"""The nested calibration and the kernel iteration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import calibration, kernel_iteration
from spanwise.plans import networks
from spanwise.sources import sinks

ROOT = "/root/testdata/sf0.001"


def test_inner_solve_is_the_minimum():
    rng = np.random.default_rng(0)
    flow, counted = rng.uniform(0, 10, (30, 3)), np.arange(30) % 2 == 0
    seen = calibration.Observations(np.where(counted, rng.poisson(flow @ [1.2, 0.7, 1.0]), flow @ [1.2, 0.7, 1.0]).astype(float), rng.uniform(0.5, 2, 30), counted)
    prior = calibration.scale_precision(np.diag([0.01, 0.02, 0.03]), 0.5, 0.1)
    k, _ = seen.solve(flow, prior)
    whole = lambda x: seen.misfit(flow, x)[0] + (x - 1) @ prior @ (x - 1)
    assert all(whole(k) <= whole(np.maximum(k + rng.normal(size=3) * s, 1e-9)) for s in (1e-3, 1e-2, 0.1) for _ in range(30))
    again, _ = seen.solve(flow, prior, start=k * 3)
    assert again == pytest.approx(k, rel=1e-6)
    v, g, h = seen.misfit(flow, k)
    e = 1e-6
    assert g == pytest.approx([(seen.misfit(flow, k + e * d)[0] - seen.misfit(flow, k - e * d)[0]) / (2 * e) for d in np.eye(3)], rel=1e-4, abs=1e-3)
    assert h == pytest.approx(np.array([(seen.misfit(flow, k + e * d)[1] - seen.misfit(flow, k - e * d)[1]) / (2 * e) for d in np.eye(3)]), rel=1e-3, abs=1e-2)


def test_priors():
    p = calibration.scale_precision(np.diag([0.04, 0.04]), 0.5, 0.1)
    together, apart = np.array([1, 1]) / 2**0.5, np.array([1, -1]) / 2**0.5
    assert together @ p @ together == pytest.approx(1 / 0.25) and apart @ p @ apart == pytest.approx(1 / 0.05)
    blocks = calibration.kernel_precision([np.zeros((3, 3)), np.eye(3)])
    assert blocks.shape == (6, 6) and blocks[0, 0] == pytest.approx(1 / 0.182**2) and blocks[3, 3] == pytest.approx(1 / (1 + 0.182**2)) and not blocks[:3, 3:].any()


def test_powell_in_batches():
    calls = []

    def score(x):
        calls.append(len(x))
        return ((x[:, 0] - 1.3) ** 2 + 10 * (x[:, 1] + 0.4 - x[:, 0]) ** 2) + np.abs(x[:, 2])

    x, v = calibration.powell_batched(score, np.zeros(3), rounds=60, tol=1e-12)
    assert x == pytest.approx([1.3, 0.9, 0.0], abs=0.02) and v < 1e-3 and set(calls[1:]) == {9}


def test_calibration_finds_what_made_the_flows(spark):
    r = networks.calibrated_kernels(spark, ROOT).first()
    assert r["short"] == pytest.approx(420, rel=0.1) and r["mix"] == pytest.approx(0.65, abs=0.07) and r["scale"] == pytest.approx(1.25, abs=0.02)


def test_a_tight_prior_holds_the_kernel(spark):
    pairs, incidence = (sinks.cut_lineage(x) for x in networks.assigned(spark, ROOT))
    pairs = pairs.where("component = 'BUILDING'")
    seen = spark.createDataFrame([(i, 5.0, 1.0, False) for i in range(20)], "obs long, value double, weight double, counted boolean")
    got = calibration.calibrate(pairs, incidence, seen, {"BUILDING": (300.0, 900.0, 0.5)}, np.eye(3) * 1e9, np.eye(1) * 1e9, rounds=1, points=5, narrowings=1)
    assert got.kernels["BUILDING"] == pytest.approx((300, 900, 0.5)) and got.scales["BUILDING"] == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        calibration.calibrate(pairs, incidence, seen.withColumn("value", F.lit(None)), {"BUILDING": (300.0, 900.0, 0.5)}, np.eye(3), np.eye(1))


def test_kernel_iteration_converges_to_the_kernel_that_made_the_trips(spark):
    rows = networks.kernel_iterated(spark, ROOT).orderBy("round").collect()
    assert rows[-1]["w"] == pytest.approx(0.7, abs=0.1) and rows[-1]["tau_s"] == pytest.approx(300, rel=0.15) and rows[-1]["tau_l"] == pytest.approx(1500, rel=0.2)
    assert len(rows) < 12


def test_balancing_factors_hold_sums_and_gauge(spark):
    rng = np.random.default_rng(1)
    f = rng.uniform(0.1, 1, (4, 6))
    cells = [(i, j, float(f[i, j])) for i in range(4) for j in range(6)] + [(9, 0, 0.0), (9, 1, 0.0)]
    df = spark.createDataFrame(cells, "src long, dst long, f double")
    o = spark.createDataFrame([(i, 10.0 + i) for i in (0, 1, 2, 3, 9)], "src long, O double")
    d = spark.createDataFrame([(j, 5.0 + j) for j in range(6)], "dst long, D double")
    flows = []
    for scale in (1.0, 1000.0):
        a, b = kernel_iteration.balancing_factors(df, o, d.withColumn("D", F.col("D") * scale), 30)
        a, b = {r["src"]: r["a"] for r in a.collect()}, {r["dst"]: r["b"] for r in b.collect()}
        assert a[9] == 0
        flows.append(np.array([[(10 + i) * a[i] * b[j] * f[i, j] for j in range(6)] for i in range(4)]))
    assert flows[0] == pytest.approx(flows[1]) and flows[0].sum(axis=1) == pytest.approx([10, 11, 12, 13])
    assert flows[0].sum(axis=0) / flows[0].sum() == pytest.approx(np.arange(5, 11) / 45, rel=1e-6)


def test_single_exponential_and_singly_constrained(spark):
    pairs, o, p = (sinks.cut_lineage(x) for x in networks.zones(spark, ROOT))
    cells = pairs.withColumn("f", kernel_iteration.kernel(F.col("t"), 1.0, 500.0, 1e9))
    places = kernel_iteration.density(cells, o, p, 60.0, doubly=False)
    slot = F.floor(F.col("t") / 60).cast("long").alias("bin")
    trips = sinks.cut_lineage(places.join(cells.groupBy(slot).agg(F.avg("f").alias("m")), "bin").select("bin", (F.col("places") * F.col("m")).alias("trips")))
    got = kernel_iteration.iterate(pairs, o, p, trips, 60.0, {"w": 1.0, "tau_s": 800.0, "tau_l": 1e9}, doubly=False, single=True, damping=1.0, rounds=10)
    assert got.kernel["tau_s"] == pytest.approx(500, rel=0.05)
    with pytest.raises(ValueError):
        kernel_iteration.iterate(pairs, o, p, trips.limit(0), 60.0, {"w": 1.0, "tau_s": 800.0, "tau_l": 1e9})


def test_jobs_read_sums_and_not_pairs(spark):
    """Pairs of one origin and time are one row, whatever their number."""
    pairs = spark.range(1000).selectExpr("'c' AS component", "id AS pair", "id % 2 AS src", "CAST(id % 5 AS DOUBLE) AS t", "3.0D AS produced", "1.0D + id % 3 AS attracted")
    incidence = spark.range(1000).selectExpr("id AS pair", "id % 3 AS obs", "0.5D AS share")
    reach, seen = calibration.folded(pairs, incidence)
    assert reach.count() == 10 and seen.count() == 30
    sets = spark.createDataFrame([(0, "c", 1.0, 4.0, 0.5)], "set int, component string, short double, long double, mix double")
    got = {r["obs"]: r["flow"] for r in calibration.predictions(pairs, incidence, sets).collect()}
    f = [0.5 * np.exp(-t) + 0.5 * np.exp(-t / 4) for t in range(5)]
    den = [sum((1 + i % 3) * f[i % 5] for i in range(1000) if i % 2 == s) for s in (0, 1)]
    assert got == pytest.approx({o: sum(3 * (1 + i % 3) * f[i % 5] * 0.5 / den[i % 2] for i in range(1000) if i % 3 == o) for o in range(3)})
