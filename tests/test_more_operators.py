import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import scalar
from spanwise.operators import flows, graph, observe, sampling, spatial, weighted
from spanwise.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ring(*pts):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))


def test_curves(spark):
    assert [one(spark, scalar.interpolate_loglog(F.lit(x), [1, 10, 100], [2, 20, 20])) for x in (0.5, 3.0, 50.0, 1000.0)] == [2, pytest.approx(6), pytest.approx(20), 20]
    df = spark.range(101).selectExpr("'a' as k", "id / 100.0D as x", "2.0D as y")
    n = weighted.trapezoid_normalise(df, "x", "y", ["k"])
    assert {round(r["density"], 9) for r in n.collect()} == {1.0}
    assert weighted.curve_quantile(n, "x", ["k"], 0.305).first()["quantile"] == pytest.approx(0.305)
    h = weighted.weighted_histogram(df, ["k"], F.col("x"), F.col("y"), [0, 0.5, 1]).orderBy("bin").collect()
    assert [(r["bin"], r["mass"]) for r in h] == [(0, 100.0), (1, 102.0)]
    assert one(spark, scalar.tilted(F.lit(2.0), F.lit(1.0), F.lit(math.log(3.0)))) == pytest.approx(6)


def test_places(spark):
    g = spatial.to_itm(F.lit(53.35), F.lit(-6.26))
    back = one(spark, spatial.from_itm(g["x"], g["y"]))
    assert (back["lat"], back["lon"]) == (pytest.approx(53.35, abs=1e-8), pytest.approx(-6.26, abs=1e-8))
    for x, y in ((-6.26, 53.35), (53.35, -6.26), (715_830.0, 734_697.0)):
        p = one(spark, spatial.repaired_place(F.lit(x), F.lit(y)))
        assert (p["lat"], p["lon"]) == (pytest.approx(53.35, abs=0.02), pytest.approx(-6.26, abs=0.02))
    assert one(spark, spatial.repaired_place(F.lit(0.0), F.lit(0.0))) is None
    sq = ring((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, spatial.ring_distance(F.lit(5.0), F.lit(1.0), sq)) == 3 and one(spark, spatial.ring_distance(F.lit(1.0), F.lit(1.0), sq)) == 0
    assert one(spark, spatial.circle_meets(F.lit(5.0), F.lit(1.0), F.lit(3.0), sq))
    areas = spark.range(3).select(F.col("id").alias("k"), ring((0, 0), (4, 0), (0, 4)).alias("ring"))
    a, b = (spatial.sample_in_rings(areas.repartition(n), "k", 20, seed=2).orderBy("k", "draw").collect() for n in (1, 3))
    assert a == b and len(a) == 60 and all(r["x"] + r["y"] <= 4 for r in a)


def test_graph_edits(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (3, 4, 2.0), (4, 5, 4.0), (5, 1, 1.0), (1, 5, 9.0)], "u long, v long, length double")
    kept = graph.contract_chains(e, spark.createDataFrame([(1,), (5,)], "node long"), cut=sinks.cut_lineage)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 5, 9.0), (1, 5, 12.0), (5, 1, 1.0)]
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    nodes, edges = graph.edit(n, e, spark.createDataFrame([(3,)], "node long"), spark.createDataFrame([(1, 2, 7.0)], "u long, v long, length double"), spark.createDataFrame([(2, 4, 1.5)], "u long, v long, length double"))
    assert nodes.count() == 4 and sorted(tuple(r) for r in edges.collect()) == [(1, 2, 7.0), (1, 5, 9.0), (2, 4, 1.5), (4, 5, 4.0), (5, 1, 1.0)]
    star = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "u long, v long")
    r = graph.regions_behind(star, spark.createDataFrame([(3,), (4,)], "node long"), spark.createDataFrame([(1,)], "node long"), cut=sinks.cut_lineage)
    assert sorted((x["gate"], x["node"]) for x in r.collect()) == [(3, 4), (3, 5)]
    nested = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9), ("d", 9)], "region string, node int")
    assert sorted((x["region"], x["node"]) for x in graph.maximal_regions(nested).collect()) == [("a", 1), ("a", 2), ("c", 9)]
    ends = graph.dead_end_edges(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long"), spark.createDataFrame([(3,)], "node long"))
    assert [tuple(x)[:2] for x in ends.select("u", "v").collect()] == [(2, 3)]


def test_sites(spark):
    s = spark.createDataFrame([("x", [(1, 2), (2, 1)]), ("y", [(9, 9)])], "site string, links array<struct<u:long,v:long>>")
    got = observe.site_readout(s, spark.createDataFrame([(1, 2, 5.0), (2, 1, 2.0)], "u long, v long, flow double"))
    assert {r["site"]: r["flow"] for r in got.collect()} == {"x": 7.0, "y": 0.0}


def test_long_paths_are_whole():
    n = 10_050
    g = graph._Graph(np.arange(n), np.arange(n) + 1, np.ones(n), np.arange(n))
    dist, by, prev = g.search(0, g.cost)
    assert dist[n] == n and len(g.path(n, by, prev)) == n


def test_too_many_gates(spark):
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    with pytest.raises(ValueError):
        graph.regions_behind(edges, spark.range(3, 10_004).withColumnRenamed("id", "node"), edges.select(F.col("u").alias("node")))


def test_recent_fix_keeps_equal_events(spark):
    e = spark.createDataFrame([("a", 100, "x"), ("a", 100, "x"), ("a", 500, "y")], "s string, t int, v string").select("s", F.timestamp_seconds("t").alias("ts"), "v")
    f = spark.createDataFrame([("a", 90, 1), ("a", 99, 2), ("a", 99, 3), ("b", 100, 4)], "s string, t int, n int").select("s", F.timestamp_seconds("t").alias("at"), "n")
    got = sorted((r["v"], r["fix"]["n"] if r["fix"] else None) for r in observe.recent_fix(e, f, "s", "ts", "at").collect())
    assert got == [("x", 3), ("x", 3), ("y", None)]


def test_running_weights_and_medians_by_group(spark):
    rows = [(g, float((i * 7919) % 100), float(i % 3)) for g in ("a", "b", None) for i in range(500 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = {(r["g"], r["x"]): (r["cum"], r["total"]) for r in weighted.running_weight(df, "x", "w", ["g"]).collect()}
    for g in ("a", "b", None):
        own = [(x, w) for k, x, w in rows if k == g]
        for x in {x for x, _ in own}:
            assert got[(g, x)] == (sum(w for y, w in own if y <= x), sum(w for _, w in own))
    m = {r["g"]: r["median"] for r in weighted.medians(df, "x", ["g"]).collect()}
    import statistics

    assert m == {g: statistics.median(x for k, x, _ in rows if k == g) for g in ("a", "b", None)}


def test_ring_masses_in_blocks(spark):
    o = spark.createDataFrame([(i, float(i)) for i in range(6)], "origin int, x double")
    p = spark.createDataFrame([(float(i), 1.0 + i) for i in range(25)], "y double, m double")
    d = F.abs(F.col("x") - F.col("y"))
    a, b = (sorted(map(tuple, flows.ring_masses(o, p, d, "m", [2.0, 9.0], most=n).collect())) for n in (100, 4))
    assert a == b and len(a) == 18


def test_ranks_by_group(spark):
    rows = [(g, float((i * 37) % 11), i) for g in ("a", None, "b") for i in range(300 if g == "a" else 5)] + [("c", None, 1), ("c", 2.0, 2)]
    got = sampling.ranks(spark.createDataFrame(rows, "g string, x double, i int"), ["g"], [F.col("x"), F.col("i")]).collect()
    for g in ("a", None, "b"):
        own = sorted((x, i) for k, x, i in rows if k == g)
        assert [(r["x"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == own
        assert {r["size"] for r in got if r["g"] == g} == {len(own)}
    assert sorted(r["rank"] for r in got if r["g"] == "c") == [0, 1]


def test_pairs_of_a_kind_are_one_row_with_all_their_mass(spark):
    from spanwise.plans import bindings, more  # noqa: F401  bindings loads the others
    from spanwise.sources.tables import table

    d = "/root/testdata/sf0.01"
    got = more._timed(spark, d).selectExpr("count(*)", "sum(m)").first()
    pairs = table(spark, d, "customer").join(table(spark, d, "supplier"), F.expr("s_suppkey % 10 = c_custkey % 10")).selectExpr("count(*)", "sum((c_custkey % 5) * (s_suppkey % 3))").first()
    assert got[0] < pairs[0] and got[1] == pairs[1]
    assert more._timed(spark, d).groupBy("o", "g").count().where("count > 1").isEmpty()


def test_weighted_quantile_of_odd_weights(spark):
    """Values without a number come last, weights may be null or below 0, and a group without a weight has no row."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(60)) if rng.random() < 0.9 else None, rng.choice([1.0, 2.0, 5.0, -1.0, None])) for _ in range(600)]
    rows += [("n", None, 3.0), ("n", 2.0, 1.0), ("z", 1.0, None), (None, 4.0, 1.0)]
    for p in (0.0, 0.3, 0.5, 1.0):
        exp = {}
        for g in {r[0] for r in rows}:
            own, run = [r for r in rows if r[0] == g], 0.0
            total, hits = sum(r[2] or 0.0 for r in own), []
            for x in sorted({r[1] for r in own}, key=lambda v: (v is None, v)):
                run += sum(r[2] or 0.0 for r in own if r[1] == x)
                hits += [x] if run >= p * total else []
            if g != "z":
                exp[g] = min((h for h in hits if h is not None), default=None)
        got = weighted.weighted_quantile(spark.createDataFrame(rows, "g string, x double, w double"), "x", "w", p, ["g"]).collect()
        assert {r["g"]: r["quantile"] for r in got if r["g"] != "z"} == exp


def test_small_regions_share_a_batch(spark):
    """Round trips of many regions, one without a way back, by no group of their own."""
    e = [(1, 10, 2.0), (10, 1, 1.0), (10, 11, 3.0), (11, 10, 4.0), (2, 20, 1.0), (20, 21, 1.0), (21, 20, 1.0)]
    edges = spark.createDataFrame(e, "u long, v long, cost double")
    regions = spark.createDataFrame([(1, 10, 10), (1, 10, 11), (2, 20, 20), (2, 20, 21)], "gate long, root long, node long")
    nodes = spark.createDataFrame([(10, 1.0, 1.0), (11, 1.0, 3.0)], "node long, jobs double, people double")
    got = graph.feasible_regions(regions, edges, nodes, "jobs", "people")
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 10, 2, 4.0, 2.0, (2 + 15) / 4, (1 + 15) / 4, 5.0)]


def test_nearest_of_dense_points(spark):
    """Dense points, copies of one place and lone ones, by comparing all; points of dense cells meet few others."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(400)] + [(400 + i, 0.5, 0.5) for i in range(20)] + [(500 + i, rng.random() * 9, rng.random() * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, x double, y double")
    for others in (True, False):
        exp = {}
        for i, x, y in rows:
            near = min((math.hypot(x - u, y - v), j) for j, u, v in rows if not (others and i == j))
            exp[i] = (near[1], near[0]) if near[0] <= 1 else (None, None)
        got = spatial.nearest(df, df.withColumnRenamed("a", "b"), "a", "b", 1.0, others=others).collect()
        assert {r["a"]: (r["b"], r["distance"] if r["distance"] is None else pytest.approx(r["distance"], abs=1e-12)) for r in got} == exp
