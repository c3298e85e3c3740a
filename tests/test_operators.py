"""Operators without SQL of their own, invariants and edges."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions import domain, kernels, scalar
from spanwise.operators import apportion, calibrate, codes, flows, graph, matching, observe, relational, sampling, spatial, weighted
from spanwise.sources import sinks, tables
from spanwise.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


# Parking: tags, area and expected spaces.
PARKING = [
    ({"parking": "street_side", "access": "private", "capacity": "4"}, 11.0, 0), ({"parking": "street_side", "access": "yes", "capacity": "36"}, 914.0, 36),
    ({"parking": "multi-storey", "capacity": "400"}, 1500.0, 400), ({"building": "parking", "building:levels": "3"}, 1500.0, 150), ({}, 2000.0, 66.667),
    ({"parking": "surface"}, 600.0, 20), ({"parking": "street_side"}, 130.0, 10), ({"parking": "surface", "capacity": "120"}, 250.0, 8.333),
    ({"access": "no", "capacity": "50"}, 1500.0, 0), ({"access": "permit"}, 1500.0, 0), ({"parking": "surface"}, 0.0, 0), ({}, None, 0),
    ({"access": "customers", "capacity": "20"}, 500.0, 20), ({"access": "customers", "capacity": "50"}, 1500.0, 50),
]


def test_parking(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(PARKING)], "i int, tags map<string,string>, area double")
    got = {r["i"]: r["n"] for r in df.select("i", domain.parking_spaces(F.col("tags"), F.col("area")).alias("n")).collect()}
    assert all(got[i] == pytest.approx(n, abs=1e-3) for i, (_, _, n) in enumerate(PARKING))


def test_schools(spark):
    cases = [(None, "Scoil Mhuire NS", "primary"), (None, "Coláiste na hInse", "secondary"), ("secondary", "X NS", "secondary"), ("special", None, "sen"), (None, "Primary College", "unknown"), (None, None, "unknown"), (None, "Preschool", "primary")]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n string")
    got = {r["i"]: (r["c"], r["e"]) for r in df.select("i", domain.school_class(F.col("t"), F.col("n")).alias("c"), domain.school_enrolment(F.col("t"), F.col("n"), F.lit(None)).alias("e")).collect()}
    assert [got[i][0] for i in range(len(cases))] == [c for _, _, c in cases]
    assert [got[i][1] for i in range(len(cases))] == [170, 575, 575, 80, 170, 170, 170]


def test_speeds(spark):
    for tag, kmh in (("30 mph", 48.28032), ("50", 50), ("gb:nsl_single", 96.54), ("none", 140), ("de:urban", 50), ("walk", 0), (None, 0), ("", 0)):
        assert one(spark, domain.limit_kmh(F.lit(tag))) == pytest.approx(kmh)
    assert [one(spark, domain.speed_band(F.lit(x))) for x in (48.28, 50.0, 0.0, 20.0)] == ["30", "30", "untagged", "other"]
    for c in ("motorway", "service", "other"):
        for b in domain.BANDS:
            back = one(spark, domain.bucket_of_index(domain.bucket_index(*lit(c, b))))
            assert (back["cls"], back["band"]) == (c, b)
    assert one(spark, domain.base_kmh(*lit("primary", "untagged"))) == 65 and one(spark, domain.base_kmh(*lit("primary", "30"))) == pytest.approx(30 * 1.609344 * 0.8)
    assert one(spark, domain.edge_seconds(F.lit(None), F.lit(1000.0), F.lit(36.0))) == pytest.approx(100)


def test_kernels(spark):
    t = 600.0
    miles = math.exp(-5.6726 + 0.9591 * math.log(t) + 0.02319 * math.log(t) ** 2)
    assert one(spark, kernels.equivalent_miles(F.lit(t))) == pytest.approx(miles)
    p, d0, k = kernels.DRIVE_SHARE["retail"]
    share = p * (1 - math.exp(-((miles / d0) ** k)))
    assert one(spark, kernels.drive_share(F.lit(miles), "retail")) == pytest.approx(share) == one(spark, kernels.drive_share(F.lit(miles), F.lit("retail")))
    assert one(spark, kernels.willingness(*lit(t, 0.6, 200.0, 100.0), "retail")) == pytest.approx(share * math.exp(-t / 200))  # the long one is never the shorter
    assert one(spark, kernels.willingness(*lit(0.0, 0.6, 200.0, 900.0), "retail")) == 0
    h = 1e-3
    slope = (one(spark, kernels.equivalent_miles(F.lit(t + h))) - one(spark, kernels.equivalent_miles(F.lit(t - h)))) / (2 * h)
    assert one(spark, kernels.equivalent_miles_slope(F.lit(t))) == pytest.approx(slope, rel=1e-5)
    assert one(spark, kernels.expit(kernels.logit(F.lit(0.3)))) == pytest.approx(0.3) and one(spark, kernels.tanner(F.lit(7.0), 2.0, 7.0)) == pytest.approx(1)
    assert one(spark, kernels.turn_penalty(*lit(0.0, 2, False))) == 0 and one(spark, kernels.turn_penalty(*lit(90.0, 3, True))) > 20


def test_scalars(spark):
    edges = [0, 1, 5]
    assert [one(spark, scalar.bin_left_closed(F.lit(x), edges)) for x in (-1.0, 0.0, 1.0, 4.9, 5.0)] == [None, 0, 1, 1, None]
    assert one(spark, scalar.bin_last_closed(F.lit(5.0), edges)) == 1
    assert one(spark, scalar.slot_label(*lit(1, 9))) == "Sat 0900" and one(spark, scalar.slot_label(F.lit(None).cast("int"), F.lit(9))) == ""
    assert one(spark, scalar.duration_seconds(F.lit("1234s"))) == 1234 and one(spark, scalar.duration_seconds(F.lit("x"))) is None
    assert one(spark, scalar.heading_change(*lit(350.0, 20.0))) == pytest.approx(30)
    assert one(spark, scalar.jeffreys_sigma(F.lit(2))) == 1.581 and one(spark, scalar.jeffreys_sigma(F.lit(None).cast("int"))) is None
    assert one(spark, scalar.is_missing(F.lit(" NA "))) and not one(spark, scalar.is_missing(F.lit("N")))
    assert one(spark, scalar.name_tokens(F.lit("Saint Áine's & Co, Town"))) == ["st", "aines", "and", "co"]
    assert one(spark, scalar.parse_weights(F.lit("A=1,B=0.5"))) == {"A": 1.0, "B": 0.5}
    assert one(spark, scalar.parse_pair_key(scalar.pair_key(*lit(3, 9)))) == (3, 9)
    assert one(spark, scalar.poisson_deviance(*lit(2.0, 0.5))) == 4 and one(spark, scalar.pearson_z(*lit(6.0, 4.0))) == 1


def test_weights(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), ("a", 2.0, 3.0), ("a", 4.0, None)], "k string, w double, m double")
    got = weighted.weighted_counts(df, ["k"], "w", "m").collect()
    assert [(r["k"], r["n"], r["weighted"]) for r in got] == [("a", 2, 6.0), (None, 1, 2.0)]
    assert weighted.weight_label("w", "m") == "w*m" and weighted.weight_label("w", F.lit(1)) == "w*mult" and weighted.weight_label(None, None) == "n"
    with pytest.raises(ValueError):
        weighted.effective_weight(df, "none")


@pytest.mark.parametrize("n", [1, 7, 400])
def test_weighted_quantile_over_ranges(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(100) / 7, rng.randrange(1, 5) * 1.0) for _ in range(n)]
    got = weighted.weighted_quantile(spark.createDataFrame(rows, "x double, w double"), "x", "w", 0.3).first()["quantile"]
    total, cum = sum(w for _, w in rows), 0
    for x, w in sorted(rows):
        cum += w
        if cum >= 0.3 * total - 1e-9:
            break
    assert got == x


def test_shares_sum_to_one(spark):
    df = spark.range(50).selectExpr("id % 3 as g", "id * 1.0D as v")
    assert all(r["s"] == pytest.approx(1) for r in weighted.normalise(df, "v", ["g"]).groupBy("g").agg(F.sum("share").alias("s")).collect())
    mad = weighted.mad_sigma(df, "v", ["g"]).collect()
    assert len(mad) == 3 and all(r["sigma"] > 0 for r in mad)
    main = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 1.0)], "bin int, mass double")
    tail = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 3.0)], "bin int, mass double")
    assert [r["mass"] for r in weighted.splice_tail(main, tail, 1).orderBy("bin").collect()] == [5.0, 1.0, 3.0]


def test_apportion_conserves(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 10.0, 3.0), ("b", 6.0, 0.0), ("b", 6.0, 0.0), (None, 4.0, None)], "g string, t double, w double")
    got = {r["g"]: r["s"] for r in apportion.apportion(df, ["g"], "t", "w").groupBy("g").agg(F.sum("part").alias("s")).collect()}
    assert got == {"a": 10.0, "b": 6.0, None: 4.0}
    bad = apportion.generation_scales(spark.createDataFrame([("x", 0.0)], "l string, v double"), spark.range(3).withColumn("p", F.lit(1)), "l", "v", "p", {"x": 1.0})
    with pytest.raises(Exception, match="layer without mass"):
        bad.collect()


def test_codes(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "x"), (9, None)], "c int, s string")
    assert [r["code"] for r in codes.stray_codes(df, "c", [1], [2]).collect()] == [9]
    with pytest.raises(ValueError):
        codes.assert_no_stray_codes(df, "c", [1, 2])
    assert codes.assert_no_stray_codes(df, "c", [1, 2], [9]) is df
    kept, dropped = codes.require_present(codes.clean_missing(df), ["s"])
    assert kept.count() == 1 and dropped.first()["dropped"] == 2
    flags = spark.createDataFrame([("v", 1, 0, 1)], "variable string, y2001 int, y2002 int, y2003 int")
    assert codes.years_available(flags, "variable", ["y2001", "y2002", "y2003"]).first()["years"] == ["y2001", "y2003"]
    dim = spark.createDataFrame([("7", 1.0), ("08", 2.0)], "code string, v double")
    assert {r["k"]: r["v"] for r in codes.lookup_unpadded(spark.createDataFrame([("007",), ("08",), ("9",)], "k string"), dim, "k", "code", "v").collect()} == {"007": 1.0, "08": 2.0, "9": None}


def test_furness_agrees_with_matrix(spark):
    rng = np.random.default_rng(2)
    o, d, f = rng.uniform(1, 5, 6), rng.uniform(1, 5, 5), rng.uniform(0.1, 1, (6, 5))
    od = spark.createDataFrame([(i, j, float(o[i]), float(d[j]), float(f[i, j])) for i in range(6) for j in range(5)], "src int, dst int, p double, a double, f double")
    got = flows.doubly_constrained(od, F.col("f"), sweeps=40, cut=sinks.cut_lineage, tolerance=1e-10)
    t = np.zeros((6, 5))
    for r in got.collect():
        t[r["src"], r["dst"]] = r["flow"]
    ref = calibrate.furness(o, d, f)
    assert np.allclose(t, ref, atol=1e-6) and np.allclose(t.sum(axis=1), o) and np.allclose(t.sum(axis=0), d * o.sum() / d.sum(), atol=1e-6)


def test_observations(spark):
    ev = spark.createDataFrame([("s", "car", "with", 0), ("s", "gps", None, 90), ("t", "car", "with", 5), ("t", "car", "against", 8), ("u", "gps", None, 1)], "session string, kind string, direction string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["session"]: r for r in observe.sessions(ev, "session", F.col("ts"), F.col("ts"), "kind", "direction", single=F.lit(True)).collect()}
    assert (got["s"]["with"], got["s"]["against"], got["s"]["total"], got["s"]["seconds"]) == (1, None, None, 90.0)
    assert got["t"]["with"] is None and got["u"]["with"] is None
    keep, report = observe.usable(observe.sessions(ev, "session", F.col("ts"), F.col("ts"), "kind", "direction"), "seconds", ["total"])
    assert [r["session"] for r in keep.collect()] == ["s"] and report.first()["short"] == 2
    comb = observe.combine_by_link(spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 2.0)], "l int, x double, s double"), ["l"], "x", "s", ["x"]).first()
    assert comb["mean"] == pytest.approx(12) and comb["sigma"] == pytest.approx(math.sqrt(0.8)) and len(comb["observations"]) == 2
    shape = spark.createDataFrame([("res", 0, 0.5)], "component string, hour int, fraction double")
    model = spark.createDataFrame([("res", 0, 100.0), ("res", 1, 100.0)], "component string, hour int, flow double")
    pred = {r["hour"]: r["predicted"] for r in observe.predicted_count(model, shape, ["hour"], F.lit(3600.0)).collect()}
    assert pred == {0: 50.0, 1: pytest.approx(100 / 24)}
    slots = spark.createDataFrame([(0, 1.0, 1.0, 0.5, 2.0), (0, -2.0, 1.0, 0.5, 1.0)], "h int, r double, s double, p double, g double")
    r, g = np.array([1.0, -2.0]), np.array([2.0, 1.0])
    cov = np.eye(2) + 0.25 * np.outer(g, g)
    assert observe.slot_chi_square(slots, ["h"], "r", "s", "p", "g").first()["chi2"] == pytest.approx(r @ np.linalg.solve(cov, r))


def test_map_match(spark):
    pts = spark.createDataFrame([("s", float(i), 1.0, 5.0) for i in range(5)], "session_id string, x double, y double, accuracy double")
    edges = spark.createDataFrame([("near", 0.0, 0.0, 10.0, 0.0), ("far", 0.0, 9.0, 10.0, 9.0)], "edge string, x1 double, y1 double, x2 double, y2 double")
    got = observe.map_match(pts, edges).first()
    assert got["edge"] == "near" and got["rmse"] == pytest.approx(1)


def test_relational(spark):
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 30, 60, 90, 170, 175)))
    assert [p["x"] for p in one(spark, relational.thin_by_distance(pts, 80))] == [0, 90, 170, 175]
    cells = one(spark, relational.jsonstat_cells(F.array(*map(F.lit, [1.0, None, 3.0, 4.0, 5.0, 6.0])), [2, 3]))
    assert [(c["index"], c["value"]) for c in cells] == [([0, 0], 1.0), ([0, 2], 3.0), ([1, 0], 4.0), ([1, 1], 5.0), ([1, 2], 6.0)]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    got = relational.replace_component(base, spark.createDataFrame([(3, "b"), (4, "a")], "k int, c string"), "c", "b").collect()
    assert sorted((r["k"], r["c"]) for r in got) == [(1, "a"), (3, "b")]
    assert relational.sum_by_key([base.withColumn("v", F.lit(1)), base.where("k = 1").withColumn("v", F.lit(5))], "k", "v").orderBy("k").collect() == [(1, 6), (2, 1)]
    assert one(spark, relational.overlap_ratio(F.array(*lit(1, 2, 2)), F.array(*lit(2)))) == 0.5


def test_matching(spark):
    assert one(spark, matching.ratcliff_obershelp(*lit("abcd", "bcde"))) == pytest.approx(0.75)
    line = one(spark, matching.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(p["lat"], p["lon"]) for p in line] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    pts = spark.createDataFrame([(1, 0.0, 0.0, "A School"), (2, 100.0, 0.0, None), (3, 200.0, 0.0, "a-school"), (4, 900.0, 0.0, None), (5, 950.0, 0.0, None)], "id long, x double, y double, name string")
    cl = matching.clusters(pts, "id", 150, cut=sinks.cut_lineage)
    assert {r["id"]: r["cluster"] for r in cl.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    kept = matching.one_of_each_name(pts.join(cl, "id"), "cluster", "name", "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 4]
    for a, b, same in [
        ("St Matthew's Primary School", "St Malachy's Primary School", False), ("St. Patrick's P.S.", "Saint Patricks Primary School, Armagh", True), ("St Patrick's Primary School", "Saint Patricks PS, Armagh", True),
        ("St Patrick's", "St Patrick's (Glen)", False), ("Royal School Prep", "Royal School", False), ("Scoil Naomh Bríd", "SCOIL BRID", True), ("The Primary School", "Primary School", False), ("Ballyclare High", "Ballyclair High", True), (None, "x", None),
    ]:
        assert one(spark, matching.same_establishment(F.lit(a).cast("string"), F.lit(b))) is same, (a, b)
    assert [r["value"] for r in matching.share_total(spark.createDataFrame([("i", 9.0), ("i", 9.0), ("j", 4.0)], "g string, t double"), "g", "t").orderBy("g").collect()] == [4.5, 4.5, 4.0]


def test_space(spark):
    g = one(spark, spatial.to_itm(*lit(53.5, -8.0)))
    assert (g["x"], g["y"]) == (pytest.approx(600000, abs=1e-6), pytest.approx(750000, abs=1e-6))
    a, b = one(spark, spatial.to_itm(*lit(53.35, -6.26))), one(spark, spatial.to_itm(*lit(53.351, -6.26)))
    assert a["x"] == pytest.approx(715_830, abs=500) and a["y"] == pytest.approx(734_697, abs=500)
    assert math.hypot(a["x"] - b["x"], a["y"] - b["y"]) == pytest.approx(111.3, abs=0.3)
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))))
    assert one(spark, spatial.shoelace_area(ring)) == 8
    c = one(spark, spatial.ring_centroid(ring))
    assert (c["x"], c["y"]) == (2, 1)
    assert one(spark, spatial.in_ring(*lit(1.0, 1.0), ring)) and not one(spark, spatial.in_ring(*lit(5.0, 1.0), ring))
    assert one(spark, spatial.segment_fraction(*lit(3.0, 5.0, 0.0, 0.0, 4.0, 0.0))) == 0.75 and one(spark, spatial.segment_distance(*lit(3.0, 5.0, 0.0, 0.0, 4.0, 0.0))) == 5
    polys = spark.createDataFrame([("p",)], "poly string").withColumn("ring", ring)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 6.0, 1.0), (3, 99.0, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["poly"] for r in spatial.points_in_polygons_or_nearest(pts, polys, "id", "poly", 1.0, 10.0).collect()}
    assert got == {1: "p", 2: "p", 3: None}
    far = pts.unionByName(spark.createDataFrame([(4, 1e7, -1e7)], "id int, x double, y double"))
    assert {r["id"]: r["poly"] for r in spatial.points_in_polygons_or_nearest(far, polys, "id", "poly", 1.0).collect()} == {1: "p", 2: "p", 3: "p", 4: "p"}
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "u int, v int")
    assert [tuple(r) for r in spatial.boundary_edges(e, spark.createDataFrame([(1,), (2,)], "node int")).collect()] == [(2, 3)]


def test_graphs(spark):
    rng = random.Random(4)
    e = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 9) * 1.0, i) for i in range(50)]
    df = spark.createDataFrame(e, "u long, v long, cost double, link_id long")
    best = {(i, j): (0.0 if i == j else math.inf) for i in range(12) for j in range(12)}
    for u, v, c, _ in e:
        best[u, v] = min(best[u, v], c)
    for k in range(12):
        for i in range(12):
            for j in range(12):
                best[i, j] = min(best[i, j], best[i, k] + best[k, j])
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12) if i != j], "src long, dst long")
    got = {(r["src"], r["dst"]): r for r in graph.shortest_paths(df, pairs).collect()}
    assert {k: r["dist"] for k, r in got.items()} == {k: v for k, v in best.items() if k[0] != k[1] and v < math.inf}
    cost = {i: c for _, _, c, i in e}
    assert all(sum(cost[x] for x in r["links"]) == r["dist"] for r in got.values())
    a, b = (graph.random_path_incidence(x, pairs.repartition(n), passes=5).orderBy("src", "dst", "link").collect() for x, n in ((df, 2), (df, 7)))
    assert a == b and all(0 < r["weight"] <= 1 for r in a)
    assert graph.articulation_points([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)]) == {3, 4}
    nodes = spark.createDataFrame([(1, 10.0, 1.0), (2, 30.0, 2.0), (3, 5.0, 9.0)], "node int, pop double, mu double")
    m = {r["node"]: (r["pop"], r["mu"]) for r in graph.collapse(nodes, spark.createDataFrame([(2, 1)], "node int, into int"), ["pop"], ["mu"], "pop").collect()}
    assert m == {1: (40.0, 1.75), 3: (5.0, 9.0)}
    assert {r["node"]: (r["out"], r["in"]) for r in graph.degrees(spark.createDataFrame([(1, 2), (1, 3)], "u int, v int")).collect()} == {1: (2, 0), 2: (0, 1), 3: (0, 1)}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g", "cast((id * 7919) % 1000 as double) as len")
    a, b = (sorted(r["id"] for r in sampling.quota_sample(df.repartition(n), ["g"], "id", "len", 20, seed=1).collect()) for n in (2, 9))
    assert a == b and len(a) == 60
    assert one(spark, sampling.carried_quotas(F.array(*lit(1, 10, 10, 10)), 20)) == [1, 6, 6, 7]
    assert [r["id"] for r in sampling.strided(df, ["id"], 3, 4).collect()] == [0, 3, 6, 9]
    assert 30 < sampling.hash_sample(df, ["id"], 0.1).count() < 80
    boot = sampling.bootstrap_multiplicities(df, ["g"], "id", 3)
    assert {r["s"] for r in boot.groupBy("g", "replicate").agg(F.sum("multiplicity").alias("s")).collect()} <= {166, 167}
    cov = sampling.bootstrap_covariance(df.withColumn("c", F.col("id") % 2), boot, ["g", "id"], "c", "len")
    assert cov.count() == 4


def test_solvers():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3))
    y = x @ np.array([1.0, 0.0, 2.0]) - 0.5 * x[:, 1]
    assert np.allclose(calibrate.least_squares(x.T @ x, x.T @ y), [1, -0.5, 2])
    nn = calibrate.nonnegative_least_squares(x.T @ x, x.T @ y)
    assert nn[1] == 0 and (nn >= 0).all()
    g = x.T @ x @ nn - x.T @ y
    assert np.allclose(g[nn > 0], 0, atol=1e-8) and (g[nn == 0] >= -1e-8).all()
    assert np.allclose(calibrate.powell(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1 - 0.5 * p[0]) ** 2, np.zeros(2)), [3, 0.5], atol=1e-3)
    p, cov = calibrate.levenberg_marquardt(lambda p: p[0] * np.exp(-p[1] * np.arange(20)) - 2 * np.exp(-0.3 * np.arange(20)), np.array([1.0, 1.0]))
    assert np.allclose(p, [2, 0.3], atol=1e-5) and cov.shape == (2, 2)
    t = np.linspace(20, 4000, 120)
    w = 0.6 * np.exp(-t / 200) + 0.4 * np.exp(-t / 1500)
    fit, _ = calibrate.fit_double_exponential(t, w, np.ones_like(t), [(0.5, 100, 1000), (0.7, 300, 2000)])
    assert np.allclose(fit, [0.6, 200, 1500], rtol=1e-2)
    c = rng.uniform(0.5, 2, (60, 2))
    k = np.array([1.5, 0.7])
    got = calibrate.solve_scales(c, np.arange(60) % 2 == 0, c @ k, np.ones(60))
    assert np.allclose(got, k, rtol=1e-4)
    lx = np.log(np.linspace(100, 9000, 50))
    ly = -5 + 0.9 * lx + 0.02 * lx**2
    sums = np.array([50, lx.sum(), (lx**2).sum(), (lx**3).sum(), (lx**4).sum(), ly.sum(), (lx * ly).sum(), (lx**2 * ly).sum()])
    assert np.allclose(calibrate.loglog_polynomial(sums), [-5, 0.9, 0.02], atol=1e-5)
    assert calibrate.damped({"w": 0.0, "tau": 1.0}, {"w": 1.0, "tau": 100.0}, 0.5) == {"w": 0.5, "tau": 10.0}


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(2001, 1, "a,b"), (2002, 2, 'q"x')], "SurveyYear int, v int, s string")
    sinks.write_table(df, f"{p}/t", partition_by=["SurveyYear"])
    assert tables.scan(spark, f"{p}/t", ["v"], [2002]).collect() == [(2,)]
    with pytest.raises(ValueError):
        tables.load(spark, f"{p}/t")
    assert tables.load(spark, f"{p}/t", whole=True, max_rows=1).count() == 1
    assert tables.catalogue(spark, f"{p}/t").count() >= 2 and tables.resolve(["trip", "tripx", "day"], "da") == "day"
    with pytest.raises(ValueError):
        tables.resolve(["trip1", "trip2"], "trip")
    sinks.write_table(df, f"{p}/c", "csv")
    assert sorted(r["s"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{p}/c").collect()) == ["a,b", 'q"x']
    (tmp_path / "l.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "a", "n": 2}\n{"k": "b", "n"')
    assert tables.json_lines(spark, f"{p}/l.jsonl", "k string, n int").count() == 2
    assert tables.keyed_json_lines(spark, f"{p}/l.jsonl", "k string, n int", ["k"], "n").collect() == [("a", 2)]
    sinks.write_cache(df, f"{p}/cache", df)
    assert sinks.read_cache(spark, f"{p}/cache", df.repartition(3)).count() == 2
    with pytest.raises(ValueError):
        sinks.read_cache(spark, f"{p}/cache", df.limit(1))
    (tmp_path / "e.csv").write_text("session_id,session_label,session_mode,session_start,session_end,event_type,timestamp,direction,directionMode,lat,lng,gps_accuracy_m\nab,\"x, y\",dual,2026-01-01T00:00:00.000Z,2026-01-01T01:00:00.000Z,car,2026-01-01T00:00:05.000Z,with,both,,,\n")
    row = tables.events_csv(spark, f"{p}/e.csv").first()
    assert row["session_label"] == "x, y" and row["lat"] is None and row["source_file"].endswith("e.csv")
    (tmp_path / "c.json").write_text('{"id": ["a", "b"], "size": [2, 2], "value": [1, null, 3, 4]}')
    assert sorted((tuple(r["index"]), r["value"]) for r in tables.jsonstat(spark, f"{p}/c.json", [2, 2]).collect()) == [((0, 0), 1.0), ((1, 0), 3.0), ((1, 1), 4.0)]
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": [{"properties": {"code": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1]]]}}, {"properties": {"code": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[2,0],[2,2]]], [[[5,5],[6,5],[6,6]]]]}}]}')
    rings = tables.geojson_features(spark, f"{p}/g.json", "code: string").collect()
    assert sorted((r["code"], r["part"], len(r["ring"])) for r in rings) == [("A", 0, 3), ("B", 0, 3), ("B", 1, 3)]
    assert '"Feature"' in sinks.geojson(tables.geojson_features(spark, f"{p}/g.json", "code: string"), "ring", ["code"]).first()["value"]
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="2"/><node id="3" lat="2" lon="2"/><node id="4" lat="9" lon="9"><tag k="shop" v="y"/></node><way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="amenity" v="parking"/></way><way id="11"><nd ref="3"/><nd ref="4"/></way></osm>')
    nodes, ways = tables.osm_nodes(spark, f"{p}/m.osm"), tables.osm_ways(spark, f"{p}/m.osm")
    assert nodes.count() == 4 and ways.count() == 2 and nodes.where("id = 4").first()["tags"] == {"shop": "y"}
    ring = tables.closed_rings(ways, nodes).first()
    assert ring["id"] == 10 and ring["tags"] == {"amenity": "parking"} and [(q["x"], q["y"]) for q in ring["ring"]] == [(0, 0), (2, 0), (2, 2), (0, 0)]
    assert [r["id"] for r in tables.ways_touching(ways, nodes.where("id = 4")).collect()] == [11]
    assert tables.way_points(ways.where("id = 11"), nodes).first()["lat"] == 5.5


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType())])
    rows = spark.createDataFrame([("a", 10, 1.0), ("a", 10, 1.0), ("a", 25, 2.0), ("b", 4000, 5.0)], "k string, t int, v double").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in", schema)
    got = events.run_to_path(events.hourly(events.dedupe(stream, "ts", ["k", "ts"]), "ts", ["k"], F.col("v"), None), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r["k"], r["hour"], r["n"], r["total"]) for r in got.collect()) == [("a", 0, 2, 3.0), ("b", 1, 1, 5.0)]
    assert sorted(r["n"] for r in events.sessions(rows, "ts", ["k"]).collect()) == [1, 3]
    assert events.thin(rows, "ts", ["k"], "20 seconds").count() == 3
    fixes = rows.select("k", F.col("ts").alias("fix_ts"))
    latest = [(r["v"], r["fix"]["fix_ts"].second) for r in events.recent_fix(rows.where("v = 2"), fixes, "k", "ts", "fix_ts").collect()]
    assert latest == [(2.0, 25)]
    both = events.recent_fix(stream, events.read_events(spark, f"{tmp_path}/in", schema).select("k", F.col("ts").alias("fix_ts")), "k", "ts", "fix_ts", delay="1 second")
    got = events.run_to_path(both, f"{tmp_path}/fixes", f"{tmp_path}/cp3", "append").collect()
    assert {(r["k"], r["v"]): r["fix"]["fix_ts"].second for r in got if r["k"] == "a"} == {("a", 1.0): 10, ("a", 2.0): 25}
    with pytest.raises(ValueError):
        events.run_to_path(both, f"{tmp_path}/x", f"{tmp_path}/y", "update")


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    path, schema = f"{tmp_path}/up", T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    rounds = [[(k, "old") for k in range(200)], [(5, "new"), (900, "new")], []]
    for n, own in enumerate(rounds):
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = events.read_events(spark, f"{tmp_path}/in/*", schema, recursiveFileLookup="true")
        events.upsert_sink(stream, path, ["k"], "version", f"{tmp_path}/cp").awaitTermination()
    got = {r["k"]: (r["v"], r["version"]) for r in events.read_upserted(spark, path).collect()}
    assert len(got) == 201 and got[5] == got[900] == ("new", 1) and got[6] == ("old", 0)
    assert len(os.listdir(f"{path}/data/version=1")) <= 2 * 2 + 2  # two buckets, and marker files


def test_upserts_keep_files_bounded(spark, tmp_path):
    """Ten batches, one repeated: each key has its last row, and files do not grow with batches."""
    path, schema = f"{tmp_path}/up", T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    last = {}
    for n in range(10):
        own = {k: n for k in range(n, 40 + 3 * n, 1 + n % 3)}
        last |= own
        batch = spark.createDataFrame(list(own.items()), schema)
        for _ in range(2 if n == 6 else 1):
            events._upsert(batch, n, path, ["k"], "version", 4, 2)
    got = {r["k"]: (r["v"], r["version"]) for r in events.read_upserted(spark, path).collect()}
    assert got == {k: (v, v) for k, v in last.items()}
    files = [f for _, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 2 * 4 and len(os.listdir(f"{path}/manifest")) == 2
    with pytest.raises(ValueError):
        events.read_upserted(spark, f"{tmp_path}/none")


def test_no_two_kept_fixes_are_close(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.LongType())])
    batches = [[("a", 0, 1), ("a", 5, 2), ("a", 20, 3), ("b", 3, 4), (None, 4, 5)], [("a", 39, 6), ("a", 40, 7), ("a", 41, 8), ("b", 22, 9), ("b", 23, 10)], [("a", 30, 11), ("a", 700, 12), ("b", 2000, 13)], [("a", 2100, 14), ("b", 2019, 15)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, t int, v long").select("k", F.timestamp_seconds(F.col("t") + 100_000).alias("ts"), "v").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = events.read_events(spark, f"{tmp_path}/in/*", schema, maxFilesPerTrigger=1)
    got = events.run_to_path(events.thin_exact(stream, "ts", ["k"], ["v"]), f"{tmp_path}/out", f"{tmp_path}/cp", "append")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", 1), ("a", 3), ("a", 7), ("a", 12), ("a", 14), ("b", 4), ("b", 10), ("b", 13)]


@pytest.mark.parametrize("small", [0, 200_000])
def test_components_of_a_long_winding_path_settle(spark, small):
    from spanwise.operators import graph

    order = list(range(1500))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (7000, 7001), (7001, 7001)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(edges, small=small).collect()}
    assert got == dict.fromkeys(range(1500), 0) | {7000: 7000, 7001: 7000}


def test_clusters_along_a_line_and_of_odd_points(spark):
    rows = [(k, 0.0009 * k, 0.0) for k in range(300)] + [(900, 5.0, 5.0), (901, 5.0, 5.0011), (902, 5.00069, 5.0), (903, None, 0.0), (904, float("nan"), 0.0), (905, float("nan"), 0.0)]
    got = {r["id"]: r["cluster"] for r in matching.clusters(spark.createDataFrame(rows, "id long, x double, y double"), "id", 0.001).collect()}
    assert got == dict.fromkeys(range(300), 0) | {900: 900, 901: 901, 902: 900, 903: 903, 904: 904, 905: 905}


def test_kept_fixes_go_by_rows_and_one_timer(spark, tmp_path):
    """A timer that expires before its key is done is set on; nulls of other columns come last and stay."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType())])
    batches = [[(1, 0, None), (1, 0, 2.0), (2, 0, None)], [(1, 25, 3.0), (3, 900, None)], [(1, 44, 4.0), (1, 45, None), (2, 19, 5.0), (3, 2000, 6.0)], [(1, 1999, 7.0), (1, 2010, 8.0), (1, 2019, 9.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, t int, v double").select("k", F.timestamp_seconds(F.col("t") + 100_000).alias("ts"), "v").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = events.read_events(spark, f"{tmp_path}/in/*", schema, maxFilesPerTrigger=1)
    thinned = events.thin_exact(stream, "ts", ["k"], ["v"])
    plan = thinned._jdf.queryExecution().logical().toString()
    assert "TransformWithStateInPySpark" in plan and "_micros" in plan
    got = events.run_to_path(thinned, f"{tmp_path}/out", f"{tmp_path}/cp", "append")
    assert got.schema["ts"].dataType == T.TimestampType()
    rows = sorted((r["k"], int(r["t"]) - 100_000, r["v"]) for r in got.select("k", F.unix_seconds("ts").alias("t"), "v").collect())
    assert [(k, t) for k, t, _ in rows] == [(1, 0), (1, 25), (1, 45), (1, 1999), (1, 2019), (2, 0), (3, 900), (3, 2000)]
    assert (1, 0, 2.0) in rows and (2, 0, None) in rows and (1, 45, None) in rows
