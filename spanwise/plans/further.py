"""Operators on files, networks, groups and observations bound to the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar
from .. import explore
from ..operators import apportion, calibrate, codes, graph, matching, observe, relational, sampling, spatial, tuning, weighted
from ..sources import sinks, tables
from ..sources.tables import table
from ..streaming import events as streaming
from .bindings import query, r, rounded, ts
from .more import d_

# --- files ---------------------------------------------------------------------------


def _text_file(df, column: str, name: str) -> str:
    """A folder with the texts of one column as lines."""
    path = sinks.shared_folder(df.sparkSession, name)
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
    return path


@query("SELECT CAST(event_id AS VARCHAR) AS session_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(user_id AS INT) AS gps_accuracy_m, round(value, 2) AS lat FROM events")
def event_logs(spark, d):
    """Observation logs as CSV, read by their schema."""
    e = table(spark, d, "events")
    none = F.lit(None).cast("string")
    at = F.date_format(ts("ts"), "yyyy-MM-dd HH:mm:ss")
    path = sinks.shared_folder(spark, "logs")
    row = e.select(F.col("event_id").cast("string").alias("session_id"), none.alias("session_label"), none.alias("session_mode"), none.alias("session_start"), none.alias("session_end"), "event_type", at.alias("timestamp"), none.alias("direction"), none.alias("directionMode"), r("value", 2).alias("lat"), F.lit(0.5).alias("lng"), F.col("user_id").cast("int").alias("gps_accuracy_m"))
    sinks.write_table(row, path, "csv")
    got = tables.events_csv(spark, path)
    return got.select("session_id", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "gps_accuracy_m", "lat")


@query("SELECT CAST(n_nationkey % 24 AS INT) AS hour, CAST(n_nationkey AS VARCHAR) AS share FROM nation")
def hourly_profile(spark, d):
    """An hourly profile whose hours are clock times."""
    n = table(spark, d, "nation")
    path = sinks.shared_folder(spark, "profile")
    sinks.write_table(n.select(F.format_string("%02d:00", (F.col("n_nationkey") % 24).cast("int")).alias("hour"), F.col("n_nationkey").cast("string").alias("share")), path, "csv")
    return tables.profile_csv(spark, path).select("hour", "share")


@query("SELECT p_brand AS code, p_type AS label, CAST(count(*) * 1000 AS DOUBLE) AS count FROM part WHERE p_size % 10 <> 0 GROUP BY ALL")
def code_counts(spark, d):
    """(code, label, count) by position; rows without a number are left out."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type", (F.col("p_size") % 10 == 0).alias("bare")).agg(F.count("*").alias("n"))
    number = F.when(F.col("bare"), "n/a").otherwise(F.concat(F.col("n").cast("string"), F.lit(",000")))
    path = sinks.shared_folder(spark, "codes")
    p.select("p_brand", "p_type", number.alias("n")).write.mode("overwrite").option("header", "false").csv(path)
    return tables.code_counts_csv(spark, path)


@query("SELECT 'c_custkey' AS variable, 'own' AS description UNION ALL SELECT 'c_name', 'any' UNION ALL SELECT 'c_acctbal', NULL")
def variable_descriptions(spark, d):
    """Columns with their table's own description, or else any table's."""
    cols = spark.createDataFrame([("c_custkey",), ("c_name",), ("c_acctbal",)], "variable string")
    known = spark.createDataFrame([("c_custkey", "own", "Customer"), ("c_custkey", "other", "Aaa"), ("c_name", "any", "Aaa"), ("c_name", "later", "Bbb")], "variable string, description string, table string")
    return tables.variables(cols, known, "customer")


@query("SELECT n_name AS variable, CASE WHEN n_regionkey = 0 THEN ['y1'] WHEN n_nationkey % 2 = 0 THEN ['y1', 'y2'] ELSE ['y2'] END[1] AS first, CAST(CASE WHEN n_regionkey <> 0 AND n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM nation")
def variable_years(spark, d):
    """Years that each variable is flagged for."""
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    f = table(spark, d, "nation").select(F.col("n_name").alias("variable"), ((g == 0) | (k % 2 == 0)).cast("int").alias("y1"), ((g != 0)).cast("int").alias("y2"))
    return codes.years_available(f, "variable", ["y1", "y2"]).select("variable", F.element_at("years", 1).alias("first"), F.size("years").alias("n"))


@query("SELECT CAST(i // 6 AS INT) AS a, CAST(i // 2 % 3 AS INT) AS b, CAST(i % 2 AS INT) AS c, i * 1.5e0 AS value FROM range(24) t(i) WHERE i % 5 <> 0")
def cube_cells(spark, d):
    """Cells of a dense cube, nulls left out."""
    path = _text_file(spark.range(1).select(F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(i % 5 != 0, i * d_(1.5))).alias("value")), {"ignoreNullFields": "false"}).alias("line")), "line", "cube")
    got = tables.jsonstat(spark, path, [4, 3, 2])
    return got.select(F.col("index")[0].alias("a"), F.col("index")[1].alias("b"), F.col("index")[2].alias("c"), "value")


@query("SELECT n_nationkey AS code, CAST(0 AS INT) AS part, CAST(4 AS INT) AS points, CAST((1 + n_regionkey) * (1 + n_regionkey) / 2e0 AS DOUBLE) AS area FROM nation")
def area_features(spark, d):
    """Areas written as GeoJSON features and read again as rings."""
    k, s = F.col("n_nationkey"), (F.col("n_regionkey") + 1).cast("double")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a = table(spark, d, "nation").select(k.cast("int").alias("code"), F.array(pt(k, F.lit(0)), pt(k + s, F.lit(0)), pt(k, s), pt(k, F.lit(0))).alias("ring"))
    lines = sinks.geojson(a, "ring", ["code"]).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("value")), F.lit("]}")).alias("line"))
    got = tables.geojson_features(spark, _text_file(lines.coalesce(1), "line", "areas"), "code int")
    return got.select("code", F.col("part").cast("int").alias("part"), F.size("ring").alias("points"), r(F.abs(spatial.shoelace_area(F.col("ring"))), 6).alias("area"))


@query("SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS total, CAST(count(*) AS INT) AS rings FROM nation GROUP BY ALL")
def dissolved_areas(spark, d):
    """Parents with summed columns and all their areas' rings."""
    k = F.col("n_nationkey").cast("double")
    ring = F.array(*(F.struct((k + x).alias("x"), d_(y).alias("y")) for x, y in ((0.0, 0), (0.5, 0), (0.0, 1))))
    got = tables.dissolve(table(spark, d, "nation").withColumn("ring", ring), "n_regionkey", ["n_nationkey"])
    return got.select("n_regionkey", F.col("n_nationkey").alias("total"), F.size("rings").alias("rings"))


def _ways(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("l_suppkey")).alias("refs"))
    return li.withColumn("tags", F.create_map(F.lit("n"), F.size("refs").cast("string")))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey % 9 = 0")
def ways_touching(spark, d):
    """Ways with any node of a set."""
    return tables.ways_touching(_ways(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).where("id % 9 = 0")).select("id")


@query("SELECT l_orderkey AS id, round(avg(l_suppkey), 6) AS lon, round(avg(l_suppkey % 10), 6) AS lat FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def way_points(spark, d):
    """Each way as the mean of its nodes."""
    s = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(s.alias("id"), s.cast("double").alias("lon"), (s % 10).cast("double").alias("lat"))
    return rounded(tables.way_points(_ways(spark, d), nodes).select("id", "lon", "lat"), lon=6, lat=6)


# --- groups and observations -----------------------------------------------------------


@query("SELECT c_nationkey, round(sum(c_acctbal * CASE c_mktsegment WHEN 'BUILDING' THEN 1e0 WHEN 'MACHINERY' THEN 2e0 WHEN 'HOUSEHOLD' THEN 0.5e0 END) / sum(c_acctbal), 6) AS index FROM (SELECT c_nationkey, c_mktsegment, abs(c_acctbal) + 1 AS c_acctbal FROM customer) GROUP BY ALL")
def share_indexes(spark, d):
    """Sums over bands of the band's share and its factor."""
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", (F.abs("c_acctbal") + 1).alias("v"))
    return rounded(apportion.share_index(c, ["c_nationkey"], "c_mktsegment", "v", {"BUILDING": 1, "MACHINERY": 2, "HOUSEHOLD": 0.5}), index=6)


@query("SELECT c_nationkey, round(sum(c_custkey * c_acctbal) / sum(c_acctbal), 6) AS x, round(sum(c_custkey % 7 * c_acctbal) / sum(c_acctbal), 6) AS y FROM (SELECT c_nationkey, c_custkey, abs(c_acctbal) + 1 AS c_acctbal FROM customer) GROUP BY ALL")
def weighted_centroids(spark, d):
    """Weighted mean places."""
    k = F.col("c_custkey")
    return rounded(apportion.weighted_centroid(table(spark, d, "customer"), ["c_nationkey"], k.cast("double"), (k % 7).cast("double"), F.abs("c_acctbal") + 1), x=6, y=6)


@query("SELECT o_orderkey, o_custkey, round(coalesce(f, 0e0), 2) AS flow, round(o_totalprice - coalesce(f, 0e0), 2) AS residual FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal AS f FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def observed_against_flow(spark, d):
    """Observations with the modelled flow of their link, 0 where there is none."""
    f = table(spark, d, "customer").where("c_custkey % 3 = 0")
    o = codes.lookup(table(spark, d, "orders"), f, "o_custkey", "c_custkey", "c_acctbal", 0.0, "flow")
    return o.select("o_orderkey", "o_custkey", r("flow", 2).alias("flow"), r(F.col("o_totalprice") - F.col("flow"), 2).alias("residual"))


@query("SELECT event_id, round(user_id * 60 / 3600e0 * value * CASE WHEN hour(ts) < 20 THEN (hour(ts) + 1) / 100e0 ELSE 1e0 / 24 END, 9) AS predicted FROM events")
def predicted_counts(spark, d):
    """Model flows times the hour's fraction; an hour without one has a 24th."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("flow"), F.hour(ts("ts")).alias("hour"), F.lit("all").alias("component"))
    shape = spark.range(20).select(F.lit("all").alias("component"), F.col("id").cast("int").alias("hour"), ((F.col("id") + 1) / d_(100)).alias("fraction"))
    return observe.predicted_count(e, shape, ["hour"], F.col("user_id") * 60).select("event_id", r("predicted", 9).alias("predicted"))


@query("""SELECT hour, n, round(rr - v * rs * rs / (1 + v * ss), 6) AS chi2 FROM (SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n, 0.04e0 AS v, sum(x * x / (s * s)) AS rr, sum(x * g / (s * s)) AS rs, sum(g * g / (s * s)) AS ss
FROM (SELECT ts, value - 10 AS x, 2e0 + user_id % 5 AS s, 1e0 + event_id % 3 AS g FROM events) GROUP BY ALL)""")
def slot_chi_squares(spark, d):
    """Chi-squares of slots whose observations share an uncertain fraction."""
    e = table(spark, d, "events").select(F.hour(ts("ts")).alias("hour"), (F.col("value") - 10).alias("x"), (d_(2) + F.col("user_id") % 5).alias("s"), (d_(1) + F.col("event_id") % 3).alias("g"), d_(0.2).alias("prior"))
    return rounded(observe.slot_chi_square(e, ["hour"], "x", "s", "prior", "g"), chi2=6)


@query("SELECT CAST(1 AS INT) AS outcome, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem UNION ALL SELECT 2, round(regr_slope(l_tax, l_quantity), 9) FROM lineitem")
def many_outcomes(spark, d):
    """One design, several outcomes: normal equations from one aggregate, solved on the driver."""
    li = table(spark, d, "lineitem").select(F.lit(1.0).alias("one"), "l_quantity", "l_extendedprice", "l_tax")
    b = calibrate.least_squares(*calibrate.matrix_of(weighted.normal_equations(li, ["one", "l_quantity"], ["l_extendedprice", "l_tax"]), 2, 2))
    return spark.createDataFrame([(1, round(float(b[1, 0]), 4)), (2, round(float(b[1, 1]), 9))], "outcome int, slope double")


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS up, 0e0 AS down FROM lineitem")
def nonnegative_fit(spark, d):
    """Least squares without negative rates: a regressor that would be negative gets none."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    s = li.agg(F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("a"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("b")).first()
    x = calibrate.nonnegative_least_squares(np.array([[s["a"], 0.0], [0.0, s["a"]]]), np.array([s["b"], -s["b"]]))
    return spark.createDataFrame([(round(float(x[0]), 4), float(x[1]))], "up double, down double")


@query("""WITH t AS (SELECT c_custkey % 2 AS h, c_nationkey % 2 AS k, abs(c_acctbal) + 1 AS v FROM customer) SELECT k AS i, CAST(round(ln(sum(v)), 9) AS DOUBLE) AS total FROM t GROUP BY k""")
def bootstrap_point(spark, d):
    """Log totals of components when each cluster is drawn once: what the bootstrap's replicates scatter around."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2).alias("h"), (F.col("c_nationkey") % 2).alias("k"), (F.abs("c_acctbal") + 1).alias("v"))
    once = c.select("c_custkey").distinct().withColumn("replicate", F.lit(0)).withColumn("multiplicity", F.lit(1))
    both = once.unionByName(once.withColumn("replicate", F.lit(1)))
    zero = sampling.bootstrap_covariance(c, both, ["c_custkey"], "k", "v").agg(F.max(F.abs("covariance")).alias("z"))  # equal replicates do not scatter
    return c.groupBy(F.col("k").alias("i")).agg(F.log(F.sum("v")).alias("t")).crossJoin(F.broadcast(zero)).select("i", r(F.col("t") + F.col("z"), 9).alias("total"))


@query("""SELECT CAST(k AS BIGINT) AS k, name FROM (SELECT min(c_custkey) AS k, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS name FROM customer GROUP BY c_nationkey, c_mktsegment)""")
def one_of_each_name(spark, d):
    """Of each cluster a row for each distinct name."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), "c_custkey", F.col("c_mktsegment").alias("name"))
    kept = matching.one_of_each_name(c, "cluster", "name", "c_custkey")
    return kept.select(F.col("c_custkey").cast("long").alias("k"), scalar.bare_name(F.col("name")).alias("name"))


@query("""WITH n AS (SELECT c_custkey, c_custkey % 5 + 2 AS k FROM customer) SELECT c_custkey, CAST(CASE WHEN (k - 1) % 3 = 0 THEN (k - 1) // 3 + 1 ELSE (k - 1) // 3 + 2 END AS INT) AS kept FROM n""")
def thinned_tracks(spark, d):
    """Tracks of points a unit apart, thinned to three units and the end."""
    n = (F.col("c_custkey") % 5 + 2).cast("int")
    line = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("double").alias("x"), d_(0).alias("y")))
    return table(spark, d, "customer").select("c_custkey", F.size(relational.thin_by_distance(line, 3.0)).alias("kept"))


# --- networks --------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS u, CAST(n_nationkey + 100 AS BIGINT) AS v FROM nation WHERE n_nationkey % 3 = 0")
def dead_ends(spark, d):
    """Edges into absorbed termini."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation")
    ring = n.select(k.alias("u"), ((k + 1) % 25).alias("v"))
    spur = n.where("n_nationkey % 3 = 0").select(k.alias("u"), (k + 100).alias("v"))
    edges = ring.unionByName(spur).unionByName(spur.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return graph.dead_end_edges(edges, spur.select(F.col("v").alias("node"))).select("u", "v")


@query("SELECT CAST(n_nationkey AS BIGINT) AS u, CAST((n_nationkey + 5) % 25 AS BIGINT) AS v, 5e0 * n_nationkey + 10e0 AS length FROM nation WHERE n_nationkey % 5 = 0")
def contracted_chains(spark, d):
    """Chains of pass-through nodes as single edges."""
    k = F.col("n_nationkey").cast("long")
    e = table(spark, d, "nation").select(k.alias("u"), ((k + 1) % 25).alias("v"), k.cast("double").alias("length"))
    return graph.contract_chains(e, table(spark, d, "nation").where("n_nationkey % 5 = 0").select(k.alias("node")), cut=sinks.cut_lineage).select("u", "v", "length")


@query("SELECT CAST(0 AS BIGINT) AS gate, CAST(100 AS BIGINT) AS root, CAST(n_nationkey + 100 AS BIGINT) AS node FROM nation WHERE n_nationkey < 5")
def regions_behind_gates(spark, d):
    """Parts of a network that one node alone connects to its protected places."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation")
    ring = n.select(k.alias("u"), ((k + 1) % 25).alias("v"))
    tail = n.where("n_nationkey < 5").select(F.when(k == 0, F.lit(0)).otherwise(k + 99).cast("long").alias("u"), (k + 100).alias("v"))
    edges = ring.unionByName(tail)
    found = graph.regions_behind(edges, spark.range(1).select(F.col("id").alias("node")), n.where("n_nationkey = 7").select(k.alias("node")), cut=sinks.cut_lineage)
    return found.select(F.col("gate").cast("long").alias("gate"), F.col("root").cast("long").alias("root"), "node")


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS node FROM nation")
def maximal_regions(spark, d):
    """Of nested regions those inside no larger one."""
    k, g = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    n = table(spark, d, "nation")
    whole = n.select(g.alias("region"), k.alias("node"))
    return graph.maximal_regions(whole.unionByName(n.where("n_nationkey % 2 = 0").select((g + 100).alias("region"), k.alias("node"))).unionByName(whole.withColumn("region", F.col("region") + 200)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS u, CAST((n_nationkey + 1) % 25 AS BIGINT) AS v, CASE WHEN n_nationkey = 3 THEN 9e0 ELSE 1e0 END AS cost FROM nation WHERE n_nationkey NOT IN (9, 10) UNION ALL SELECT 500, 501, 2e0")
def edited_network(spark, d):
    """A network without some nodes, with an edge's cost overridden and an edge added."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation")
    edges = n.select(k.alias("u"), ((k + 1) % 25).alias("v"), F.lit(1.0).alias("cost"))
    few = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    _, out = graph.edit(n.select(k.alias("node")), edges, few([(10,)], "node long"), few([(3, 4, 9.0)], "u long, v long, cost double"), few([(500, 501, 2.0)], "u long, v long, cost double"))
    return out.select("u", "v", "cost")


@query("SELECT l_suppkey AS node, round(sum(l_quantity), 2) AS length FROM lineitem GROUP BY ALL")
def road_weights(spark, d):
    """Length of the edges out of each node."""
    return rounded(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.sum("l_quantity").alias("length")), length=2)


@query("SELECT CAST(c_nationkey AS BIGINT) AS area, CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS inside FROM (SELECT DISTINCT c_nationkey FROM customer)")
def points_in_areas(spark, d):
    """Points drawn in rings: as many as asked for, all of them inside."""
    k = F.col("c_nationkey").cast("double")
    ring = F.array(*(F.struct((k * 10 + x).alias("x"), d_(y).alias("y")) for x, y in ((0.0, 0), (8.0, 0), (0.0, 6))))
    areas = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("area")).distinct().withColumn("c_nationkey", F.col("area")).withColumn("ring", ring)
    got = spatial.sample_in_rings(areas.select("area", "ring"), "area", 3, seed=2, tries=40).join(areas.select(F.col("area").alias("a"), "ring"), F.col("area") == F.col("a"))
    return got.groupBy("area").agg(F.count("*").alias("n"), F.count_if(spatial.in_ring(F.col("x"), F.col("y"), F.col("ring"))).alias("inside"))


# --- streams ---------------------------------------------------------------------------


@query("SELECT user_id, min(event_id) AS first, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS slot FROM events GROUP BY user_id, slot")
def thinned_stream(spark, d):
    """The first event of each user in each interval, from a stream."""
    stream = streaming.read_events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).withColumn("ts", ts("ts"))
    thin = streaming.thin(stream.select("user_id", "ts", "event_id"), "ts", ["user_id"], "6 hours", None)
    got = streaming.run_to_path(thin, sinks.shared_folder(spark, "thin"), sinks.shared_folder(spark, "progress"))
    slot = F.window("ts", "6 hours")["start"]
    return got.select("user_id", F.col("event_id").alias("first"), F.date_format(slot, "yyyy-MM-dd HH:mm").alias("slot"))


def _in_parts(df, order: str, parts: int, name: str, at=None) -> str:
    """A folder to which ``df`` was added in so many writes, in the order of a column: a stream reads them one by one."""
    spark, path = df.sparkSession, sinks.shared_folder(df.sparkSession, name)
    value = F.col(order).cast("double")
    inner = at or df.select(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    cuts = [float("-inf"), *inner, float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        df.where((value > low) & (value <= high)).coalesce(1).write.mode("append").parquet(path)
    return path


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
k AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR) AS t FROM k WHERE t IS NOT NULL)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM k JOIN e USING (user_id, ts)""")
def kept_fixes(spark, d):
    """Each user's events of which no two are under six hours apart, from a stream in several batches."""
    e = table(spark, d, "events").select("user_id", ts("ts").alias("ts"), "event_id")
    stream = streaming.read_events(spark, _in_parts(e, "ts", 4, "fixes"), e.schema, maxFilesPerTrigger=1)
    got = streaming.run_to_path(streaming.thin_exact(stream, "ts", ["user_id"], ["event_id"], 6 * 3600.0), sinks.shared_folder(spark, "kept"), sinks.shared_folder(spark, "progress"), "append")
    return got.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS value, CAST(count(DISTINCT part) AS BIGINT) AS parts
FROM (SELECT *, CASE WHEN event_id <= (SELECT quantile_disc(event_id, 0.25) FROM events) THEN 0 ELSE 1 END AS part FROM events WHERE event_id IS NOT NULL) GROUP BY ALL""")
def upserted_stream(spark, d):
    """A keyed table kept by a stream of several batches: each key has its last batch's row."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value").where("event_id is not null")
    path = sinks.shared_folder(spark, "upserts")
    # A row for each key and batch: its last event.
    first = e.agg(F.expr("percentile_disc(0.25) within group (order by event_id)")).first()[0]
    last = e.withColumn("part", (F.col("event_id") > first).cast("int")).groupBy("user_id", "event_type", "part").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("e"))
    last = last.select("user_id", "event_type", "part", "e.event_id", "e.value")
    stream = streaming.read_events(spark, _in_parts(last, "part", 2, "changes", [0.5]), last.schema, maxFilesPerTrigger=1)
    streaming.upsert_sink(stream, path, ["user_id", "event_type"], "version", sinks.shared_folder(spark, "progress"), 8).awaitTermination()
    seen = last.groupBy("user_id", "event_type").agg(F.count("*").alias("parts"))
    return streaming.read_upserted(spark, path).drop("part").join(seen, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", r("value").alias("value"), "parts")


# --- fits, parameters and the explorer -----------------------------------------------------


@query("SELECT 'primary|untagged' AS bucket, 2e0 AS factor UNION ALL SELECT 'residential|untagged', 0.5e0")
def bucket_factors(spark, d):
    """Factors of road buckets fitted to times that were made with known ones: a round trip."""
    p = F.col("p_size").cast("double") * 100
    lengths = F.create_map(F.lit("primary|untagged"), p, F.lit("residential|untagged"), F.col("p_retailprice"), F.lit("service|other"), d_(0))
    t = p * 3.6 / 65 * 2 + F.col("p_retailprice") * 3.6 / 25 * 0.5 + 7
    rows = table(spark, d, "part").select(lengths.alias("b"), t.alias("t"))
    got, _ = tuning.fit_bucket_factors(rows, "b", d_(7), F.col("t"), F.lit(1.0), 10.0, ridge=0.0)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in got.items()], "bucket string, factor double")


@query("SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS violations FROM part")
def preference_fit(spark, d):
    """Preferences under which every chosen route costs less than the faster one."""
    s = F.col("p_size").cast("double")
    rows = table(spark, d, "part").select(F.create_map(F.lit("motorway"), s + 10, F.lit("service"), d_(1)).alias("a"), F.create_map(F.lit("motorway"), d_(1), F.lit("service"), s + 8).alias("b"))
    f, _ = tuning.fit_preferences(rows, "a", "b", ["motorway", "service"], 0.05, ridge=1e-4)
    cost = lambda c: F.col(c)["motorway"] * f["motorway"] + F.col(c)["service"] * f["service"]
    return rows.agg(F.count("*").alias("pairs"), F.count_if(cost("a") >= cost("b")).alias("violations"))


@query("SELECT 0.6e0 AS plateau, 2e0 AS scale, 1.5e0 AS shape")
def share_curve(spark, d):
    """A drive-share curve fitted to shares that were made with known parameters: a round trip."""
    x = spark.range(1, 1001).select((F.col("id") / d_(100)).alias("d"))
    share = d_(0.6) * (d_(1) - F.exp(-F.pow(F.col("d") / 2, d_(1.5))))
    rows = x.select("d", F.lit(1.0).alias("y"), share.alias("w")).unionByName(x.select("d", F.lit(0.0).alias("y"), (d_(1) - share).alias("w")))
    return spark.createDataFrame([tuple(round(v, 2) for v in tuning.fit_share_curve(rows, "d", "y", "w", 10.0))], "plateau double, scale double, shape double")


@query("SELECT c_custkey, CAST(CASE WHEN k <= 6 THEN k ELSE (k - 1) // CAST(ceil(k / 5e0) AS INT) + 1 + CASE WHEN (k - 1) % CAST(ceil(k / 5e0) AS INT) = 0 THEN 0 ELSE 1 END END AS INT) AS kept FROM (SELECT c_custkey, CAST(c_custkey % 20 + 2 AS INT) AS k FROM customer)")
def capped_tracks(spark, d):
    """Tracks thinned to a step, or evenly where that leaves too many points."""
    n = (F.col("c_custkey") % 20 + 2).cast("int")
    line = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("double").alias("x"), d_(0).alias("y")))
    return table(spark, d, "customer").select("c_custkey", F.size(relational.thin_capped(line, 1.0, 6)).alias("kept"))


@query("SELECT c_mktsegment AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 WHEN c_mktsegment = 'FURNITURE' THEN 7e0 ELSE round(sum(c_acctbal), 2) END AS value FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment")
def reset_parameters(spark, d):
    """Parameters with those of a reference, scales at 1 and stale ones left out."""
    p = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(r(F.sum("c_acctbal"), 2).alias("value"))
    return relational.reset_parameters(p, spark.createDataFrame([("FURNITURE", 7.0)], "key string, value double"), ["BUILDING"], ["MACHINERY"])


@query("SELECT c_custkey AS session_id, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE -1 END AS BIGINT) AS u, CAST(CASE WHEN c_custkey % 4 = 0 THEN (c_nationkey + 1) % 25 ELSE -1 END AS BIGINT) AS v FROM customer")
def assigned_links(spark, d):
    """Sessions given to links by hand, where the network has them."""
    k = F.col("n_nationkey").cast("long")
    edges = table(spark, d, "nation").select(k.alias("u"), ((k + 1) % 25).alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("long").alias("n"))
    old = c.select("session_id", F.lit(-1).cast("long").alias("u"), F.lit(-1).cast("long").alias("v"))
    new = c.where("session_id % 4 = 0").select("session_id", F.col("n").alias("u"), ((F.col("n") + 1) % 25).alias("v"))
    counts = c.select("session_id", F.lit(3).alias("with_count"), F.lit(None).cast("int").alias("against_count"))
    return relational.assign_links(old, new, edges, counts).select("session_id", "u", "v")


@query("SELECT n_name AS component, round((n_nationkey + 1) * 1.5e0, 6) AS rate FROM nation")
def island_rates(spark, d):
    """Generation rates at the island's level, from two JSON files."""
    n = table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", (F.col("n_nationkey") + 1).cast("double").alias("v")))).alias("rates"))
    one = _text_file(n.select(F.to_json(F.struct("rates")).alias("line")).coalesce(1), "line", "rates")
    two = _text_file(spark.range(1).select(F.lit('{"m_island": 1.5}').alias("line")).coalesce(1), "line", "level")
    return rounded(tables.generation_rates(spark, one, two), rate=6)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS weighted FROM customer WHERE c_nationkey IN (3, 4) GROUP BY ALL")
def explored_counts(spark, d):
    """The explorer's weighted counts."""
    got = explore.answer(spark, [d, "--table", "custom", "--counts", "--by", "c_mktsegment", "--weight", "c_acctbal", "--years", "3", "4", "--year-column", "c_nationkey"])
    return rounded(got.select("c_mktsegment", "n", "weighted"), weighted=2)


@query("SELECT CAST(c_nationkey AS BIGINT) AS area, CAST(4 AS BIGINT) AS n, CAST(4 AS BIGINT) AS near FROM (SELECT DISTINCT c_nationkey FROM customer)")
def road_points(spark, d):
    """Points drawn in areas until they lie near a road."""
    k = F.col("c_nationkey").cast("double")
    ring = F.array(*(F.struct((k * 10 + x).alias("x"), d_(y).alias("y")) for x, y in ((0.0, 0), (8.0, 0), (8.0, 6), (0.0, 6))))
    areas = table(spark, d, "customer").select("c_nationkey").distinct().select(F.col("c_nationkey").cast("long").alias("area"), ring.alias("ring"))
    roads = spark.range(0, 8 * 250).select(F.col("id").alias("road"), (F.floor(F.col("id") / 8) * d_(1)).alias("x"), (F.col("id") % 8).cast("double").alias("y"))
    got = spatial.road_points(areas, "area", 4, roads, "road", 0.5, seed=3)
    return got.groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("off") < 0.5).alias("near"))
