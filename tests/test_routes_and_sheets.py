"""Routes, population levels, Monte-Carlo histograms, regions, sheets and graph files."""

import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from spanwise.functions import domain
from spanwise import explore
from spanwise.operators import graph, montecarlo, population, relational, routes, sampling, tuning
from spanwise.sources import sheets, sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*x):
    return F.array(*(F.lit(i) for i in x))


def test_route_seconds(spark):
    buckets = F.create_map(F.lit("primary|untagged"), F.lit(650.0), F.lit("residential|30"), F.lit(100.0))
    factors = F.create_map(F.lit("primary|untagged"), F.lit(2.0))
    own = 2 * 650 * 3.6 / 65 + 100 * 3.6 / (30 * 1.609344 * 0.8)
    assert one(spark, routes.edge_seconds(buckets, factors, F.lit(25.0))) == pytest.approx(own + 25 * 3.6 / 25)
    turn = F.array(F.struct(F.lit(90.0).alias("angle"), F.lit(4).alias("degree"), F.lit(False).alias("uturn")))
    b = 1.075
    assert one(spark, routes.turn_seconds(turn, F.lit(3))) == pytest.approx(7.5 / (1 + math.exp(-(13 * b * 90 / 180 - 6.5 / b))) + 6)
    for bucket, key in (("trunk_link|60", "trunk_rural"), ("primary|30", "primary"), ("secondary|untagged", "secondary_rural"), ("secondary_link|other", "secondary"), ("road|other", "unclassified"), ("motorway|70", "motorway"), ("motorway_link|40", "motorway"), ("tertiary|untagged", "tertiary")):
        assert one(spark, routes.preference_key(F.lit(bucket))) == key, bucket


def test_class_times_and_cost(spark):
    r = spark.createDataFrame([(1, {"primary|untagged": 650.0, "primary_link|untagged": 300.0, "service|untagged": 15.0})], "id int, b map<string,double>")
    t = routes.class_seconds(r, ["id"], "b", spark.createDataFrame([("service|untagged", 30.0), ("primary|untagged", 0.0)], "bucket string, kmh double"))
    assert {x["preference"]: pytest.approx(x["seconds"]) for x in t.collect()} == {"primary_rural": 36.0, "primary": 36.0, "service": 1.8}
    c = routes.route_cost(t, ["id"], spark.createDataFrame([("primary", 0.5)], "preference string, factor double")).first()
    assert c["seconds"] == pytest.approx(73.8) and c["cost"] == pytest.approx(55.8)


def test_best_route_point(spark):
    way = "array<struct<valid:boolean,g_dur:double,g_dist:double>>"
    df = spark.createDataFrame([(60.0, [(False, 60.0, 1.0), (True, 61.0, 2.0), (True, 60.0, 1609.344), (True, 60.0, 9.0)]), (None, []), (5.0, [(True, 6.0, 1.0)])], f"best double, ways {way}")
    got = [r["p"] for r in df.select(routes.best_route_point(F.col("best"), F.col("ways")).alias("p")).collect()]
    assert got[0]["seconds"] == 60 and got[0]["miles"] == 1 and got[1:] == [None, None]


def kinds(*k):
    return F.array(*(F.lit(i) for i in k))


def test_legs(spark):
    leg = lambda c: (lambda v: (v["seconds"], v["anomaly"]))(one(spark, c))
    d = arr(1.0, 2.0, 4.0)
    inbound = lambda ids, k, goal: leg(routes.inbound_leg(arr(*ids), kinds(*k), d, F.lit(10.0), F.lit(goal)))
    assert inbound((9, 8, 5, 4), (0, 0, 2, 1), 5) == (6.0, None)
    assert inbound((9, 6, 5, 4), (0, 2, 2, 1), 5) == (None, None)
    assert inbound((9, 8, 7, 4), (0, 0, 0, 1), 5)[1] == "goal is not on the route"
    assert inbound((9, 8, 5, 4), (1, 0, 2, 1), 5)[1] == "origin lies in the core"
    assert inbound((9, 8, 5, 5), (0, 0, 0, 0), 5)[1] == "goal is no boundary"
    outbound = lambda ids, k, o=5, p=None: leg(routes.outbound_leg(arr(*ids), kinds(*k), d, F.lit(10.0), F.lit(o), p))
    assert outbound((5, 8, 9, 9), (2, 0, 0, 0)) == (10.0, None) and outbound((8, 5, 9, 9), (0, 2, 0, 0)) == (9.0, None)
    assert outbound((5, 6, 9, 9), (2, 2, 0, 0)) == (None, None) and outbound((5, 8, 5, 9), (2, 0, 2, 0)) == (7.0, None)
    assert outbound((7, 8, 5, 9), (0, 0, 2, 0))[1] == "origin comes late" and outbound((7, 8, 9, 9), (0, 0, 0, 0))[1] == "origin is not on the route"
    places = lambda *lat: F.array(*(F.struct(F.lit(x).alias("lat"), F.lit(-6.0).alias("lon")) for x in lat))
    assert outbound((5, 8, 5, 9), (2, 0, 2, 0), 5, places(53.0, 53.01, 53.0, 53.0))[1] == "returns to its origin from afar"
    assert outbound((5, 8, 5, 9), (2, 0, 2, 0), 5, places(53.0, 53.001, 53.0, 54.0)) == (7.0, None)
    short = lambda ids, k: leg(routes.boundary_shortcut(arr(*ids), kinds(*k), d, F.lit(10.0), F.lit(5), F.lit(6)))
    assert short((5, 8, 6, 4), (2, 0, 2, 1)) == (6.0, None) and short((5, 4, 6, 9), (2, 1, 2, 0)) == (None, None)
    assert short((5, 7, 6, 9), (2, 2, 2, 0)) == (None, None) and short((5, 4, 5, 6), (2, 1, 2, 2)) == (7.0, None)
    assert short((5, 8, 9, 9), (2, 0, 0, 0))[1] == "goal is not on the route" and short((5, 8, 6, 9), (2, 0, 0, 0))[1] == "goal is no boundary"
    assert one(spark, routes.transits_core(kinds(0, 2, 0))) is True and one(spark, routes.transits_core(kinds(0, 1, 0))) is False and one(spark, routes.transits_core(kinds(1, 2, 0))) is None
    assert one(spark, routes.first_boundary(kinds(2, 0, 2, 2))) == 2 and one(spark, routes.first_boundary(kinds(2, 0))) is None
    df = spark.createDataFrame([(1, [4, 5, 6]), (2, [])], "id int, ids array<long>")
    got = routes.node_kinds(df, spark.createDataFrame([(4, 2), (6, 1)], "node long, kind int"), ["id"])
    assert {r["id"]: r["kinds"] for r in got.collect()} == {1: [2, 0, 1], 2: []}
    bad = got.withColumn("leg", F.struct(F.lit("odd").alias("anomaly")))
    with pytest.raises(Exception, match="for review"):
        routes.refuse_anomalies(bad, "leg").collect()


def test_population(spark):
    academic = {15: 1.0, 16: 0.8, 17: 0.5}
    share = lambda code, student=True: tuple(one(spark, population.level_shares(F.lit(code), F.lit(student), academic)))
    assert share(4) == (1, 0, 0) and share(5, False) == (0, 1, 0) and share(6) == pytest.approx((0, 0.9, 0.1)) and share(7) == pytest.approx((0, 0.65, 0.35))
    assert share(7, False) == (0, 0, 0) and share(11) == (0, 0, 1) and share(2) == (0, 0, 0)
    df = spark.createDataFrame([(16, "school", 30.0), (16, "college", 10.0), (16, "other", 99.0), (17, "none", 5.0)], "age int, kind string, n double")
    assert {r["age"]: r["share"] for r in population.academic_shares(df, "age", "kind", "n", ["school"], ["college"]).collect()} == {16: 0.75, 17: 0.0}
    people = spark.createDataFrame([(4, False, 2.0, 7.0), (4, False, 1.0, 0.0), (6, True, 1.0, 14.0), (6, False, 9.0, 99.0), (8, True, 3.0, 1.0)], "code int, ft boolean, w double, t double")
    rates = population.own_vehicle_rates(people, "code", F.col("ft"), F.col("w"), F.col("t"))
    assert {r["code"]: pytest.approx(r["rate"]) for r in rates.collect()} == {4: 1 / 3, 6: 2.0, 8: 0.1085}
    levels = {r["level"]: r["rate"] for r in population.level_rates(people, rates, "code", F.col("ft"), F.col("w"), academic).collect()}
    assert levels["primary"] == pytest.approx(1 / 3) and levels["secondary"] == pytest.approx((2.0 * 0.9 + 0.1085 * 3 * 0.25) / (0.9 + 0.75))
    b = population.blended_level(spark.createDataFrame([(1.0, 3.0), (2.0, 1.0)], "l double, p double"), "l", "p", F.lit(0.5)).first()
    assert (b["level"], b["multiplier"]) == (1.25, 2.5) and b["sigma"] == pytest.approx(math.sqrt(2) * math.sqrt(0.1875) / 1.25)


def test_histograms_approach_the_exact_ones(spark):
    o = spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "src long, weight double")
    g = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "dst long, weight double")
    pairs = o.crossJoin(g.withColumnRenamed("weight", "w2")).withColumn("seconds", F.col("src") * 40.0 + F.col("dst")).withColumn("far", F.abs(F.col("src") - F.col("dst")).cast("double")).withColumn("pair_id", F.col("src") * 100 + F.col("dst"))
    edges = [0.0, 200.0, 400.0, 800.0]
    mass = F.col("weight") * F.col("w2")
    exact = {r["bin"]: r["n"] for r in montecarlo.exact_banded_histogram(pairs, mass, edges).collect()}
    near = {r["bin"]: r["n"] for r in montecarlo.banded_histogram(pairs, "far", mass, [0.0, 3.0, 10.0], edges, draws=4000).collect()}
    assert sum(near.values()) == pytest.approx(sum(exact.values())) and all(near[b] == pytest.approx(exact[b], rel=0.1) for b in exact)
    plain = {r["bin"]: r["n"] for r in montecarlo.outer_histogram(o, g, pairs, edges, 40, 30).collect()}
    assert sum(plain.values()) == 40 * 30 * 30 and all(plain[b] / 36000 == pytest.approx(exact[b] / sum(exact.values()), rel=0.1) for b in exact)
    again = {r["bin"]: r["n"] for r in montecarlo.outer_histogram(o.repartition(5), g, pairs, edges, 40, 30).collect()}
    assert again == plain


def test_weighted_draws_and_pair_pool(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.0, 1e-9, 5.0, 1000.0, 0.5])], "k long, w double")
    n = {r["k"]: r["count"] for r in sampling.draw_weighted(df, "k", "w", 5000, 3).groupBy("k").count().collect()}
    assert sum(n.values()) == 5000 and n[3] > 4900 and 0 not in n
    pool = montecarlo.pair_pool(spark.range(30).withColumnRenamed("id", "k"), "k", 200).collect()
    assert len(pool) == len({(r["low"], r["high"]) for r in pool}) == 200 and all(r["low"] < r["high"] for r in pool)
    assert montecarlo.pair_pool(spark.range(3).withColumnRenamed("id", "k"), "k", 50).count() == 3
    assert montecarlo.pair_pool(spark.range(1).withColumnRenamed("id", "k"), "k", 5).count() == 0


def test_regions(spark):
    e = [(0, 1, 5.0), (1, 0, 6.0), (1, 2, 10.0), (2, 1, 10.0), (2, 3, 10.0), (3, 2, 20.0), (0, 9, 1.0), (9, 0, 1.0), (9, 8, 1.0), (8, 9, 1.0), (8, 0, 2.0), (0, 8, 2.0), (1, 5, 99.0), (5, 1, 9.0), (5, 6, 1.0)]
    edges = spark.createDataFrame(e, "u long, v long, cost double")
    regions = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (1, 5, 5), (1, 5, 6), (0, 9, 9)], "gate long, root long, node long")
    nodes = spark.createDataFrame([(2, 1.0, 10.0), (3, 2.0, 30.0), (5, 0.0, 0.0)], "node long, jobs double, people double")
    got = graph.feasible_regions(regions, edges, nodes, "jobs", "people").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2, 40.0, 3.0, 17.5, 25.0, 20.0)]
    assert graph.feasible_regions(regions, edges, nodes, "jobs", "people", most_demand=3.0).count() == 0
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, root long")
    assert {r["node"] for r in graph.unprotected(comps, spark.createDataFrame([(2,)], "node long")).collect()} == {5, 6}
    links = spark.createDataFrame([(1, 2, "a"), (5, 6, "b"), (7, 8, "c")], "u long, v long, n string")
    assert [tuple(r) for r in graph.touched(links, spark.createDataFrame([(1,), (6,)], "node long")).orderBy("n").collect()] == [(1, 2, "a", True, False), (5, 6, "b", False, True)]
    pairs = graph.virtual_pairs(spark.createDataFrame([(1, 2, 5.0)], "src long, dst long, dist double"), spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"), 99.0)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2, 5.0, True), (3, 4, 99.0, False)]


def test_poi_weights_and_queries(spark):
    w = lambda **t: one(spark, domain.poi_weight(F.create_map(*(F.lit(x) for k, v in t.items() for x in (k, v)))))
    assert [w(amenity="hospital"), w(amenity="cafe"), w(shop="supermarket"), w(shop="kiosk"), w(office="any"), w(amenity="bench", shop="kiosk"), w(name="x")] == [5.0, 1.0, 1.5, 1.0, 2.0, None, None]
    q = lambda *a: tuple(one(spark, domain.geocode_queries(*(F.lit(x).cast("string") for x in a))))
    assert q("N", "NI", "T", "1 A St", "BT1", None, None) == (["N, T, Northern Ireland", "1 A St, T, BT1, Northern Ireland", "BT1"], 2)
    assert q("N", "RoI", None, "L", None, "Cork", None) == (["N, Cork, Ireland", "L, Cork, Ireland"], -2) and q("N", "RoI", None, None, None, None, "E1") == (["E1, Ireland"], 0)


XLSX = {
    "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Other" r:id="rId1"/><sheet name="Data" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="worksheets/b.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>Ref </t></si><si><r><t>Na</t></r><r><t>me</t></r></si></sst>',
    "xl/worksheets/a.xml": '<worksheet xmlns="m"><sheetData/></worksheet>',
    "xl/worksheets/b.xml": '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
    '<row r="3"><c r="A3"><v>17</v></c><c r="C3" t="str"><v>x</v></c></row><row r="4"><c r="C4"><v>2</v></c></row></sheetData></worksheet>',
}


def test_sheets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, text in XLSX.items():
            z.writestr(name, text)
    sheet = sheets.rows(spark, str(tmp_path / "b.xlsx"), "Data")
    assert [r["cells"] for r in sheet.orderBy("row").collect()] == [["Title"], ["Ref ", None, "Name"], ["17", None, "x"], [None, None, "2"]]
    assert [r["record"] for r in sheets.with_header(sheet, "Ref").collect()] == [{"Ref": "17", "Name": "x"}]
    with pytest.raises(Exception, match="no header row"):
        sheets.with_header(sheet, "Nothing").collect()
    row = lambda *c: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{x}</text:p></table:table-cell>" for x in c) + "</table:table-row>"
    body = row("Site 5") + "".join(row(f"{h:02d}:00:00", *(h * 10 + d for d in range(6)), "n/a") for h in range(24)) + row("00:00:00", *range(7)) + '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    with zipfile.ZipFile(tmp_path / "c.ods", "w") as z:
        z.writestr("content.xml", f'<o:doc xmlns:o="o" xmlns:table="t" xmlns:text="x"><table:table table:name="S5">{body}</table:table></o:doc>')
    got = {r["hour"]: r["counts"] for r in sheets.first_section(sheets.rows(spark, str(tmp_path / "c.ods"), "S5")).collect()}
    assert got == {h: [*(h * 10 + d for d in range(6)), 0] for h in range(24)}
    with pytest.raises(Exception, match="no sheet"):
        sheets.rows(spark, str(tmp_path / "c.ods"), "S6").collect()


def test_graph_files_and_history(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(1, 0.5), (2, 1.5)], "node long, x double"), spark.createDataFrame([(1, 2, "A & B"), (2, 1, None)], "u long, v long, name string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert [t.count() for t in sinks.read_graph(spark, str(tmp_path / "g"))] == [2, 2]
    text = "\n".join(r["line"] for r in sorted(sinks.graphml(nodes, edges).collect(), key=lambda r: r["part"]))
    os.makedirs(tmp_path / "x")
    (tmp_path / "x" / "g.graphml").write_text(text)
    got = tables.graphml_edges(spark, str(tmp_path / "x" / "g.graphml"), "name").collect()
    assert {(r["u"], r["v"]): r["value"] for r in got} == {("1", "2"): "A & B", ("2", "1"): None}
    h = spark.createDataFrame([(0, "aa1"), (1, "ab2"), (2, "aa3")], "line int, id string")
    assert tuple(tables.history_entry(h).first()) == ((2, "aa3"), (1, "ab2")) and tuple(tables.history_entry(h, "ab").first()) == ((1, "ab2"), (0, "aa1"))
    assert tables.history_entry(h, "aa1").first()["previous"] is None
    with pytest.raises(Exception, match="no entry"):
        tables.history_entry(h, "zz").collect()


def test_factor_fits(spark):
    rows = spark.createDataFrame([({"primary|untagged": 100.0 * i, "road|30": 50.0 + i}, 3.0) for i in range(1, 60)], "b map<string,double>, other double")
    t = routes.edge_seconds(F.col("b"), F.create_map(F.lit("primary|untagged"), F.lit(1.7))) + F.col("other")
    got, loss = tuning.fit_bucket_factors(rows, "b", F.col("other"), t, F.lit(2.0), 10.0, ridge=0.0)
    assert got == {"primary|untagged": pytest.approx(1.7, abs=1e-3)} and loss < 1e-8  # the other bucket is too short to tell
    assert tuning.fit_bucket_factors(rows, "b", F.col("other"), t, F.lit(2.0), 10.0, ridge=10.0)[0]["primary|untagged"] == pytest.approx(1, abs=0.1)
    tied = spark.createDataFrame([({"a": 10.0}, {"b": 9.0})] * 5, "x map<string,double>, y map<string,double>")
    f, loss = tuning.fit_preferences(tied, "x", "y", ["a", "b"], 0.0, ridge=1e-6)
    assert f["a"] * 10 <= f["b"] * 9 * 1.001 and 0.33 <= f["a"] <= 1 <= f["b"] <= 3
    o = spark.createDataFrame([(10.5, 2.0), (20.5, 4.0)], "n double, base double")
    best = tuning.search(o, {"k": (0.0, 50.0)}, F.col("k") * F.col("base"), F.col("n"), {"k": (math.log(5.0), 100.0, True)}, rounds=10)
    assert best["k"] == pytest.approx(5, abs=0.01)
    assert tuning.sweep(lambda p: p["a"] + p["b"], {"a": 1.0, "b": 2.0}, {"a": [5.0]}) == [("a", 5.0, 7.0)]
    with pytest.raises(ValueError):
        tuning.parameter_grid(spark, {"a": list(range(200)), "b": list(range(200))})


def test_assignments_and_absent_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    none = spark.createDataFrame([], "session_id string, u long, v long")
    new = spark.createDataFrame([("s", 2, 1)], "session_id string, u long, v long")
    ok = spark.createDataFrame([("s", None, 4)], "session_id string, with_count int, against_count int")
    assert [tuple(r) for r in relational.assign_links(none, new, edges, ok).collect()] == [("s", 2, 1)]
    with pytest.raises(Exception, match="no such edge"):
        relational.assign_links(none, new, edges, spark.createDataFrame([("s", 3, None)], ok.schema)).collect()
    with pytest.raises(Exception, match="no such edge"):
        relational.assign_links(none, spark.createDataFrame([("t", 7, 8)], none.schema), edges, ok).collect()
    with pytest.warns(UserWarning, match="absent"):
        assert tables.generation_rates(spark, f"{tmp_path}/no.json", f"{tmp_path}/no.json") is None
    (tmp_path / "r.json").write_text('{"rates": {"a": 2.0}}')
    with pytest.warns(UserWarning, match="absent"):
        assert tuple(tables.generation_rates(spark, f"{tmp_path}/r.json", f"{tmp_path}/no.json").first()) == ("a", 2.0)
    with pytest.warns(UserWarning, match="absent"):
        assert tables.base_speeds(spark, f"{tmp_path}/no.json").count() == 0
    (tmp_path / "b.json").write_text('{"speeds": {"road|30": {"harmonic_kmh": 22.5}, "x|20": {"harmonic_kmh": 0}}}')
    assert [tuple(r) for r in tables.base_speeds(spark, f"{tmp_path}/b.json").collect()] == [("road|30", 22.5)]


def test_explorer(spark, tmp_path):
    spark.range(5).selectExpr("id", "id % 2 as kind", "2000 + id as SurveyYear").write.parquet(f"{tmp_path}/people.parquet")
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/x")
    go = lambda *a: explore.answer(spark, [str(tmp_path / "flat"), *a]).collect()
    os.makedirs(tmp_path / "flat")
    part = next(f for f in os.listdir(f"{tmp_path}/people.parquet") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/people.parquet/{part}", f"{tmp_path}/flat/people.parquet")
    assert [r["name"] for r in go("--tables")] == ["people"] and {r["variable"] for r in go("--table", "peo", "--vars")} == {"id", "kind", "SurveyYear"}
    rows = go("--table", "people", "--levels", "kind")
    assert [r["kind"] for r in rows] == sorted(r["kind"] for r in rows) and len(go("--table", "people", "--head", "1")) == 1
    with pytest.raises(ValueError):
        go("--table", "people")
    with pytest.raises(ValueError):
        go("--table", "nobody", "--vars")
