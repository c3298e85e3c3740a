"""Operators bound to the driver's tables: a query and its SQL for each.

Every query is a Spark plan of the library's operators; its SQL is written on its own.
Floating results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain, kernels, scalar
from ..operators import apportion, codes, flows, graph, matching, observe, relational, sampling, spatial, weighted
from ..sources import sinks
from ..sources.tables import table
from ..streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """The columns named, each rounded to so many digits."""
    return df.select(*(r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def ts(c: str):
    return F.col(c).cast("timestamp")


# --- weighted aggregation ---------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity * l_discount), 4) AS weighted, l_returnflag = 'N' AS special FROM lineitem GROUP BY ALL")
def weighted_counts(spark, d):
    return rounded(weighted.weighted_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount", {"l_returnflag": ["N"]}), weighted=4)


@query("""SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS "F", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS "O",
round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS "P" FROM orders GROUP BY o_orderpriority""")
def weighted_crosstab(spark, d):
    return rounded(weighted.weighted_crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice"), F=2, O=2, P=2)


@query("""SELECT 'p_size' AS "column", count(*) FILTER (p_size IN (1, 2, 3)) AS "rows", round(coalesce(sum(p_retailprice) FILTER (p_size IN (1, 2, 3)), 0), 2) AS weight FROM part
UNION ALL SELECT 'p_type', count(*) FILTER (p_type = 'PROMO'), round(coalesce(sum(p_retailprice) FILTER (p_type = 'PROMO'), 0), 2) FROM part""")
def drop_special_report(spark, d):
    return rounded(codes.drop_special(table(spark, d, "part"), {"p_size": [1, 2, 3], "p_type": ["PROMO"]}, F.col("p_retailprice"))[1], weight=2)


@query("""SELECT coalesce(event_type, '-') AS event_type, count(*) AS n, count(v) AS present FROM (
SELECT CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS v FROM events) GROUP BY ALL""")
def na_clean(spark, d):
    e = table(spark, d, "events")
    dirty = e.select(F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_id") % 7 == 1, "  ").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 5 == 0, "NA").otherwise(F.col("user_id").cast("string")).alias("v"))
    return codes.clean_missing(dirty).groupBy(F.coalesce("event_type", F.lit("-")).alias("event_type")).agg(F.count("*").alias("n"), F.count("v").alias("present"))


@query("""SELECT n_name AS nation_label, r_name AS region_label, count(*) AS n, round(sum(c_acctbal), 2) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def decode_labels(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    book = nation.select(F.lit("nation").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")).unionByName(region.select(F.lit("region").alias("variable"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("label")))
    coded = codes.lookup(table(spark, d, "customer").withColumn("nation", F.col("c_nationkey")), nation, "nation", "n_nationkey", "n_regionkey", out="region")
    return rounded(codes.decode(coded, book, ["nation", "region"]).groupBy("nation_label", "region_label").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), total=2)


@query("SELECT event_type AS code, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'signup') GROUP BY ALL")
def stray_codes(spark, d):
    return codes.stray_codes(table(spark, d, "events"), "event_type", ["view", "click"], ["signup"])


@query("""SELECT l_returnflag, round(sum(l_quantity * l_discount), 4) AS total, round(sum(l_quantity * l_discount) / ((SELECT count(*) FROM customer) * 7e0), 6) AS rate FROM lineitem GROUP BY ALL""")
def rate_per_capita(spark, d):
    return rounded(weighted.rate(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity") * F.col("l_discount"), table(spark, d, "customer"), F.lit(1)), total=4, rate=6)


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band,
""" + ", ".join(f"round(coalesce(sum(p_retailprice) FILTER (p_type = '{t}'), 0), 2) AS \"{t}\"" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part GROUP BY ALL")
def band_rates(spark, d):
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    p = table(spark, d, "part").withColumn("band", scalar.band_label(F.col("p_size"), [("small", 0, 10), ("medium", 10, 30), ("large", 30, 1e9)]))
    return rounded(weighted.weighted_crosstab(p, "band", "p_type", kinds, "p_retailprice"), **{k: 2 for k in kinds})


@query("""SELECT l_suppkey, round(sum(l_extendedprice / ((1e0 + l_quantity) * (1e0 + l_quantity))) / sum(1e0 / ((1e0 + l_quantity) * (1e0 + l_quantity))), 4) AS mean,
round(1e0 / sqrt(sum(1e0 / ((1e0 + l_quantity) * (1e0 + l_quantity)))), 6) AS sigma, count(*) AS n FROM lineitem GROUP BY ALL""")
def inverse_variance_mean(spark, d):
    return rounded(weighted.inverse_variance_mean(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.lit(1.0) + F.col("l_quantity")), mean=4, sigma=6)


_EDGES = [0, 5000, 10000, 20000, 40000, 60000, 80000, 200000]


@query("""WITH e AS (SELECT unnest(range(7)) AS bin, unnest([0, 5000, 10000, 20000, 40000, 60000, 80000]) AS low, unnest([5000, 10000, 20000, 40000, 60000, 80000, 200000]) AS high),
s AS (SELECT bin, sum(l_quantity) AS m, sum(l_quantity * l_quantity) AS q FROM e JOIN lineitem ON l_extendedprice >= low AND l_extendedprice < high GROUP BY bin)
SELECT CAST(e.bin AS INT) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, coalesce(m, 0e0) AS mass, round(coalesce(m * m / q, 0e0), 6) AS eff_n, round(coalesce(m, 0e0) / (SELECT sum(m) FROM s), 9) AS share,
round(coalesce(m, 0e0) / (SELECT sum(m) FROM s) / (high - low), 12) AS density FROM e LEFT JOIN s ON e.bin = s.bin""")
def length_distribution(spark, d):
    return rounded(weighted.binned_distribution(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), _EDGES), eff_n=6, share=9, density=12)


@query("""SELECT o_orderpriority, min(o_totalprice) AS quantile FROM (SELECT o_orderpriority, o_totalprice, sum(w) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS cum, sum(w) OVER (PARTITION BY o_orderpriority) AS total
FROM (SELECT o_orderpriority, o_totalprice, sum(o_custkey % 10 + 1) AS w FROM orders GROUP BY ALL)) WHERE cum >= 0.5e0 * total GROUP BY ALL
UNION ALL SELECT 'all', min(o_totalprice) FROM (SELECT o_totalprice, sum(w) OVER (ORDER BY o_totalprice) AS cum, sum(w) OVER () AS total FROM (SELECT o_totalprice, sum(o_custkey % 10 + 1) AS w FROM orders GROUP BY ALL)) WHERE cum >= 0.5e0 * total""")
def weighted_quantile(spark, d):
    o = table(spark, d, "orders").withColumn("w", (F.col("o_custkey") % 10 + 1).cast("double"))
    by = weighted.weighted_quantile(o, "o_totalprice", "w", 0.5, ["o_orderpriority"])
    return by.unionByName(weighted.weighted_quantile(o, "o_totalprice", "w").withColumn("o_orderpriority", F.lit("all")))


@query("""SELECT l_returnflag, median(l_quantity) AS med, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper, list_sort(list(l_quantity))[CAST(least(floor(0.9e0 * count(*)), count(*) - 1) AS BIGINT) + 1] AS p90 FROM lineitem GROUP BY ALL""")
def percentile_trio(spark, d):
    n = F.col("n")
    got = weighted.ranked_values(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], {"a": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "p90": F.least(F.floor(F.lit(0.9) * n), n - 1)})
    return got.select("l_returnflag", ((F.col("a") + F.col("upper")) / 2).alias("med"), "upper", "p90")


@query("""WITH t AS (SELECT s_nationkey, CAST(count(*) * 100 AS DOUBLE) AS total FROM supplier GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, total, CASE WHEN c_nationkey % 5 = 0 THEN 0e0 ELSE greatest(c_acctbal, 0e0) END AS w FROM customer JOIN t ON c_nationkey = s_nationkey)
SELECT c_custkey, round(CASE WHEN sum(w) OVER (PARTITION BY c_nationkey) <> 0 THEN total * w / sum(w) OVER (PARTITION BY c_nationkey) ELSE total / count(*) OVER (PARTITION BY c_nationkey) END, 6) AS part FROM c""")
def apportion_total(spark, d):
    t = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg((F.count("*") * 100).cast("double").alias("total"))
    c = table(spark, d, "customer").join(t, "c_nationkey").withColumn("w", F.when(F.col("c_nationkey") % 5 == 0, 0.0).otherwise(F.greatest("c_acctbal", F.lit(0.0))))
    return rounded(apportion.apportion(c, ["c_nationkey"], "total", "w").select("c_custkey", "part"), part=6)


@query("""SELECT node, round(sum(x), 4) AS value FROM (SELECT l_suppkey AS node, (1e0 - l_discount) * l_quantity AS x FROM lineitem UNION ALL SELECT l_partkey + 1000000, l_discount * l_quantity FROM lineitem) GROUP BY ALL""")
def endpoint_split(spark, d):
    li = table(spark, d, "lineitem").withColumn("v", F.col("l_partkey") + 1000000)
    return rounded(apportion.split_to_ends(li, "l_suppkey", "v", F.col("l_discount"), F.col("l_quantity")), value=4)


@query("""WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS t FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN t IS NULL THEN abs(s_acctbal) ELSE abs(s_acctbal) * t / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey) END, 4) AS scaled FROM supplier LEFT JOIN c ON s_nationkey = k""")
def control_total_scale(spark, d):
    control = table(spark, d, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.sum("c_acctbal").alias("t"))
    s = table(spark, d, "supplier").withColumn("v", F.abs("s_acctbal"))
    return rounded(apportion.scale_to_total(s, ["s_nationkey"], "v", control, "t").select("s_suppkey", "scaled"), scaled=4)


@query("""WITH s AS (SELECT p_brand, p_type, sum(p_retailprice) AS v FROM part GROUP BY ALL), w AS (SELECT p_brand, coalesce(sum(v) FILTER (p_type = 'PROMO'), 0) AS m, sum(v) FILTER (p_type IN ('SMALL', 'LARGE')) AS i FROM s GROUP BY ALL)
SELECT s.p_brand, p_type, round(CASE WHEN p_type IN ('SMALL', 'LARGE') THEN v + coalesce(v * m / nullif(i, 0), 0) ELSE v END, 2) AS value FROM s JOIN w ON s.p_brand = w.p_brand WHERE p_type <> 'PROMO'""")
def fold_mixed_class(spark, d):
    return rounded(apportion.fold_class(table(spark, d, "part").withColumn("value", F.col("p_retailprice")), ["p_brand"], "p_type", "value", "PROMO", ["SMALL", "LARGE"]), value=2)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0e0 ELSE p_retailprice END AS raw, CAST(p_size AS DOUBLE) AS base FROM part), m AS (SELECT median(raw / base) AS q FROM p WHERE raw > 0 AND base > 0)
SELECT p_partkey, CASE WHEN raw > 0 THEN raw ELSE round(base * q, 1) END AS filled FROM p, m""")
def median_ratio_impute(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("raw"), F.col("p_size").cast("double").alias("base"))
    return apportion.impute_by_ratio(p, "raw", "base").select("p_partkey", "filled")


@query("""SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(CASE WHEN sum(w) > 0 THEN sum(c_acctbal * w) / sum(w) ELSE 1e0 END, 6) AS weighted_mean
FROM (SELECT *, CAST(c_custkey % 7 AS DOUBLE) AS w FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def hierarchy_rollup(spark, d):
    c = table(spark, d, "customer").withColumn("w", (F.col("c_custkey") % 7).cast("double")).withColumnRenamed("c_nationkey", "n_nationkey")
    n = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    got = apportion.rollup_hierarchy(c, n, table(spark, d, "region"), "n_nationkey", "r_regionkey", "c_acctbal", "w")
    return rounded(got.join(table(spark, d, "region"), "r_regionkey").select("r_name", "n", "total", "weighted_mean"), total=2, weighted_mean=6)


_SLOTS = "WITH h AS (SELECT CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY ALL)"


def _slots(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))


@query(_SLOTS + " SELECT dow, hour, round(avg(m), 6) AS mean, round(sqrt(var_pop(m) + avg(s * s)), 6) AS sd FROM h GROUP BY ALL")
def pooled_variance(spark, d):
    return rounded(weighted.pooled_spread(_slots(spark, d), ["dow", "hour"], "m", "s"), mean=6, sd=6)


@query(_SLOTS + " SELECT hour, round(avg(n), 6) AS mean, round(greatest(coalesce(stddev_samp(n), 0e0), 0.1e0 * avg(n), sqrt(avg(n))), 6) AS sigma FROM h WHERE dow < 5 GROUP BY ALL")
def sigma_floor(spark, d):
    g = _slots(spark, d).where("dow < 5").groupBy("hour").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("_s"))
    return rounded(g.select("hour", "mean", weighted.floored_sigma(F.col("_s"), F.col("mean"), 0.1).alias("sigma")), mean=6, sigma=6)


@query("""WITH b AS (SELECT CAST(isodow(o_orderdate) - 1 AS INT) AS dow, o_orderpriority, CASE WHEN year(o_orderdate) >= 2001 THEN 0 WHEN year(o_orderdate) >= 1999 THEN 1 ELSE 2 END AS tier, count(*) AS n, sum(o_totalprice) AS w FROM orders GROUP BY ALL),
c AS (SELECT *, sum(n) OVER o AS cn, sum(w) OVER o AS cw, sum([1, 2, 4][tier + 1]) OVER o AS years FROM b WINDOW o AS (PARTITION BY dow, o_orderpriority ORDER BY tier))
SELECT dow, o_orderpriority, CAST(arg_min(cn, k) AS BIGINT) AS n, CAST(arg_min(years, k) AS BIGINT) AS years, round(arg_min(cw, k) / arg_min(years, k), 2) AS rate FROM (SELECT *, CASE WHEN cn >= 100 THEN tier ELSE 100 - tier END AS k FROM c) GROUP BY ALL""")
def adaptive_pooling(spark, d):
    y = F.year("o_orderdate")
    tier = F.when(y >= 2001, 0).when(y >= 1999, 1).otherwise(2)
    b = table(spark, d, "orders").groupBy(F.weekday("o_orderdate").alias("dow"), "o_orderpriority", tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("w"))
    b = b.withColumn("width", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), F.col("tier") + 1))
    return rounded(weighted.adaptive_rate(b, ["dow", "o_orderpriority"], "tier", "n", "w", "width"), rate=2)


@query("""WITH h AS (SELECT greatest(CAST(isodow(ts) - 5 AS INT), 0) AS dt, CAST(hour(ts) AS INT) AS hour, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
s AS (SELECT *, avg(n) OVER (PARTITION BY dt ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM h WHERE hour BETWEEN 0 AND 5)
SELECT dt, hour, round(a * sum(n) OVER (PARTITION BY dt) / sum(a) OVER (PARTITION BY dt), 6) AS smooth FROM s UNION ALL SELECT dt, hour, round(n, 6) FROM h WHERE hour > 5""")
def night_smooth(spark, d):
    h = table(spark, d, "events").groupBy(scalar.day_type(F.col("ts")).alias("dt"), F.hour("ts").alias("hour")).agg(F.count("*").cast("double").alias("n"))
    return rounded(weighted.smooth_block(h, "n", "hour", ["dt"], 0, 5).select("dt", "hour", "smooth"), smooth=6)


@query("""SELECT event_type, round(sum(CASE WHEN isodow(ts) <= 5 THEN 5e0 ELSE 1e0 END * value) / 7e0, 4) AS weight FROM events GROUP BY ALL""")
def aadt_weight(spark, d):
    e = table(spark, d, "events").withColumn("dt", scalar.day_type(F.col("ts")))
    return rounded(weighted.week_weight(e, ["event_type"], "dt", F.col("value")), weight=4)


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS w, count(*) FILTER (event_type = 'click') AS a, user_id % 2 = 0 AS single, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, us / 1e6 AS seconds, single, CASE WHEN NOT single OR (w > 0 AND a = 0) THEN w END AS "with", CASE WHEN NOT single OR (a > 0 AND w = 0) THEN a END AS against, CASE WHEN NOT single THEN w + a END AS total FROM s""")
def session_counts(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", F.when(F.col("event_type").isin("view", "click"), "car").otherwise("other").alias("kind"), F.when(F.col("event_type") == "view", "with").otherwise("against").alias("direction"))
    e = e.withColumn("session", F.struct("user_id", "day"))
    s = observe.sessions(e, "session", F.col("ts"), F.col("ts"), "kind", "direction", single=F.col("user_id") % 2 == 0)
    return s.select("session.user_id", F.col("session.day").cast("string").alias("day"), "seconds", "single", "with", "against", "total")


@query("""SELECT user_id, count(*) AS n, round((count(*) + 0.5e0) * (3600e0 / (7200e0 * 0.05e0)), 6) AS daily,
round(3600e0 / (7200e0 * 0.05e0) * sqrt(round(sqrt(count(*) + 0.5e0), 3) * round(sqrt(count(*) + 0.5e0), 3) + ((count(*) + 0.5e0) * 0.01e0 / 0.05e0) * ((count(*) + 0.5e0) * 0.01e0 / 0.05e0)), 6) AS sigma FROM events GROUP BY ALL""")
def aadt_estimate(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    t, f, s = F.lit(7200.0), F.lit(0.05), F.lit(0.01)
    return g.select("user_id", "n", r(scalar.daily_from_count(F.col("n"), t, f)).alias("daily"), r(scalar.daily_sigma(F.col("n"), t, f, s)).alias("sigma"))


_RES = """WITH o AS (SELECT user_id, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, avg(n) OVER (PARTITION BY hour) AS predicted, n + 0.5e0 AS ne FROM o),
z AS (SELECT user_id, hour, (predicted - ne) / sqrt(ne) AS z, 2e0 * (predicted - n + n * ln(n / predicted)) AS deviance FROM p)"""


def _residuals(spark, d):
    o = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    p = o.join(o.groupBy("hour").agg(F.avg("n").alias("predicted")), "hour").withColumn("ne", F.col("n") + F.lit(0.5))
    return observe.residuals(p, "predicted", "ne")


@query(_RES + " SELECT hour, count(*) AS n, round(sum(z * z), 6) AS chi2, round(sum(deviance), 6) AS deviance, round(avg(abs(z)), 6) AS mean_abs_z, count(*) FILTER (abs(z) > 2) AS over_2 FROM z GROUP BY ALL")
def residual_chi2(spark, d):
    z = _residuals(spark, d)
    c = observe.chi_square(z, ["hour"]).join(z.groupBy("hour").agg(F.sum("deviance").alias("deviance")), "hour")
    return rounded(c.select("hour", "n", "chi2", "deviance", "mean_abs_z", "over_2"), chi2=6, deviance=6, mean_abs_z=6)


@query(_RES + " SELECT user_id, count(*) AS n, round(avg(z * z), 6) AS mean_z2, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(max(abs(z)), 6) AS max_abs_z, round(sqrt(avg(z * z)) * sign(avg(z)), 6) AS rms FROM z GROUP BY ALL")
def link_chi2(spark, d):
    z = _residuals(spark, d)
    c = observe.chi_square(z, ["user_id"]).join(z.groupBy("user_id").agg(weighted.signed_rms(F.col("z")).alias("rms")), "user_id")
    return rounded(c.select("user_id", "n", "mean_z2", "min_z", "max_z", "max_abs_z", "rms"), mean_z2=6, min_z=6, max_z=6, max_abs_z=6, rms=6)


# --- flows -------------------------------------------------------------------------

_KERNEL = "(0.6148e0 * (1e0 - exp(-pow(exp(-5.6726e0 + 0.9591e0 * ln(t) + 0.02319e0 * ln(t) * ln(t)) / 0.7409e0, 1.3967e0))) * (0.7e0 * exp(-t / 300e0) + 0.3e0 * exp(-t / 1500e0)))"
_OD = f"""p AS (SELECT n_nationkey AS k, CAST(count(c_custkey) AS DOUBLE) AS p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), a AS (SELECT n_nationkey AS k, CAST(count(s_suppkey) AS DOUBLE) AS a FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
t AS (SELECT x.k AS src, y.k AS dst, p, a, CAST(120 + (x.k * 131 + y.k * 197) % 1800 AS DOUBLE) AS t FROM p x, a y WHERE x.k <> y.k), od AS (SELECT src, dst, p, a, {_KERNEL} AS f FROM t)"""


def _od(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("p"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("a"))
    p = n.join(c, "k", "left").select(F.col("k").alias("src"), F.coalesce("p", F.lit(0.0)).alias("p"))
    a = n.join(s, "k", "left").select(F.col("k").alias("dst"), F.coalesce("a", F.lit(0.0)).alias("a"))
    pairs = flows.admissible_pairs(n.select(F.col("k").alias("node"), F.lit(False).alias("external")))
    od = pairs.join(p, "src").join(a, "dst").withColumn("t", (F.lit(120) + (F.col("src") * 131 + F.col("dst") * 197) % 1800).cast("double"))
    f = kernels.willingness(F.col("t"), F.lit(0.7), F.lit(300.0), F.lit(1500.0), "res")
    return od, f


def gravity_flows(spark, d):
    od, f = _od(spark, d)
    return flows.singly_constrained(od, f).select("src", "dst", "flow")


_FLOW = _OD + ", fl AS (SELECT src, dst, CASE WHEN sum(a * f) OVER (PARTITION BY src) > 0 THEN p * a * f / sum(a * f) OVER (PARTITION BY src) ELSE 0e0 END AS flow FROM od)"


@query(f"WITH {_FLOW} SELECT src, dst, round(flow, 6) AS flow FROM fl")
def gravity_singly(spark, d):
    return rounded(gravity_flows(spark, d), flow=6)


def _furness_sql(k: int) -> str:
    sql = "o AS (SELECT src, max(p) AS o FROM od GROUP BY 1), dd AS (SELECT dst, max(a) * (SELECT sum(o) FROM o) / (SELECT sum(m) FROM (SELECT max(a) AS m FROM od GROUP BY dst)) AS d FROM od GROUP BY 1), b0 AS (SELECT dst, 1e0 AS b FROM dd)"
    for i in range(k + 1):
        sql += f", a{i} AS (SELECT src, CASE WHEN sum(b * d * f) > 0 THEN 1e0 / sum(b * d * f) ELSE 0e0 END AS x FROM od JOIN b{i} USING (dst) JOIN dd USING (dst) GROUP BY src)"
        if i < k:
            sql += f", b{i + 1} AS (SELECT dst, CASE WHEN sum(x * o * f) > 0 THEN 1e0 / sum(x * o * f) ELSE 0e0 END AS b FROM od JOIN a{i} USING (src) JOIN o USING (src) GROUP BY dst)"
    return sql + f" SELECT src, dst, round(x * o * b * d * f, 6) AS flow FROM od JOIN a{k} USING (src) JOIN o USING (src) JOIN b{k} USING (dst) JOIN dd USING (dst)"


@query(f"WITH {_OD}, {_furness_sql(3)}")
def gravity_furness3(spark, d):
    od, f = _od(spark, d)
    return rounded(flows.doubly_constrained(od, f, sweeps=3, cut=sinks.cut_lineage), flow=6)





@query(f"""WITH {_OD}, h AS (SELECT k AS zone, unnest([60e0, 180e0, 420e0]) AS t, unnest([0.5e0, 0.3e0, 0.2e0]) AS w FROM a), s AS (SELECT zone, sum(w * {_KERNEL}) AS self FROM h GROUP BY 1),
den AS (SELECT src, sum(od.a * f) + any_value(a.a) * any_value(self) AS d FROM od JOIN a ON a.k = src JOIN s ON zone = src GROUP BY 1)
SELECT src, dst, round(CASE WHEN d > 0 THEN p * a * f / d ELSE 0e0 END, 6) AS flow FROM od JOIN den USING (src)""")
def self_term(spark, d):
    od, f = _od(spark, d)
    zones = od.groupBy(F.col("dst").alias("zone")).agg(F.max("a").alias("za"))
    hist = zones.select("zone", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((60.0, 0.5), (180.0, 0.3), (420.0, 0.2))))).alias("h")).select("zone", "h.t", "h.w")
    k = kernels.willingness(F.col("t"), F.lit(0.7), F.lit(300.0), F.lit(1500.0), "res")
    selves = flows.self_terms(hist, k).join(zones, "zone").select("zone", (F.col("self") * F.col("za")).alias("mass"))
    return rounded(flows.singly_constrained(od, f, selves=selves).select("src", "dst", "flow"), flow=6)


@query(f"""WITH {_FLOW}, i AS (SELECT DISTINCT (l_suppkey % 25) AS src, (l_partkey % 25) AS dst, l_linenumber AS link_id FROM lineitem)
SELECT l.link_id, round(coalesce(sum(flow * 0.5e0), 0e0), 6) AS flow FROM (SELECT unnest(range(0, 12)) AS link_id) l LEFT JOIN (i JOIN fl USING (src, dst)) ON l.link_id = i.link_id GROUP BY ALL""")
def od_scatter(spark, d):
    fl = gravity_flows(spark, d).withColumn("pair_id", F.struct(F.col("src").cast("long"), F.col("dst").cast("long")))
    inc = table(spark, d, "lineitem").select(F.struct((F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst")).alias("pair_id"), F.col("l_linenumber").cast("long").alias("link_id")).distinct().withColumn("weight", F.lit(0.5))
    return rounded(flows.scatter(fl, inc, spark.range(12).withColumnRenamed("id", "link_id")), flow=6)


@query(f"""WITH {_FLOW}, g AS (SELECT src AS node, sum(flow) AS generated FROM fl GROUP BY 1), c AS (SELECT dst AS node, sum(flow) AS consumed FROM fl GROUP BY 1)
SELECT node, round(generated, 6) AS generated, round(consumed, 6) AS consumed, round(consumed - generated, 6) AS imbalance, round(CASE WHEN generated <> 0 THEN consumed / generated END, 6) AS ratio FROM g JOIN c USING (node)""")
def imbalance(spark, d):
    return rounded(flows.balance(gravity_flows(spark, d)), generated=6, consumed=6, imbalance=6, ratio=6)


@query(f"""WITH {_FLOW}, b AS (SELECT node, sum(g) AS g, sum(c) AS c FROM (SELECT src AS node, flow AS g, 0e0 AS c FROM fl UNION ALL SELECT dst, 0e0, flow FROM fl) GROUP BY 1)
SELECT CASE WHEN node < 12 THEN 'internal' ELSE 'external' END AS part, round(0.5e0 * sum(abs(c - g)) / sum(g), 6) AS relocatable FROM b WHERE g > 0 OR c > 0 GROUP BY ALL""")
def relocatable_flow(spark, d):
    return rounded(flows.relocatable(flows.balance(gravity_flows(spark, d)), F.when(F.col("node") < 12, "internal").otherwise("external")), relocatable=6)


@query(f"WITH {_FLOW} SELECT src, round(sum(CASE WHEN dst >= 12 THEN flow ELSE 0e0 END), 6) AS through, round(sum(CASE WHEN dst < 12 THEN flow ELSE 0e0 END), 6) AS internal FROM fl GROUP BY ALL")
def external_trips(spark, d):
    return rounded(flows.trips_by_origin(gravity_flows(spark, d), F.col("dst") >= 12), through=6, internal=6)


_SEGMENTS = {"AUTOMOBILE": 1.4, "BUILDING": 0.9, "FURNITURE": 0.7, "HOUSEHOLD": 1.1, "MACHINERY": 1.0}
_FACTOR = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.4e0 WHEN 'BUILDING' THEN 0.9e0 WHEN 'FURNITURE' THEN 0.7e0 WHEN 'HOUSEHOLD' THEN 1.1e0 ELSE 1e0 END"


@query(f"""WITH m AS (SELECT c_nationkey AS k, avg({_FACTOR}) AS mu, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1)
SELECT n_nationkey, round(mu, 9) AS mu, round(mu * sum(w) OVER (PARTITION BY n_regionkey) / sum(mu * w) OVER (PARTITION BY n_regionkey), 9) AS normalised FROM m JOIN nation ON k = n_nationkey""")
def mu_normalise(spark, d):
    c = table(spark, d, "customer").withColumn("one", F.lit(1.0))
    mu = apportion.share_index(c, ["c_nationkey"], "c_mktsegment", "one", _SEGMENTS).join(c.groupBy("c_nationkey").agg(F.sum("one").alias("w")), "c_nationkey")
    j = mu.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(apportion.mean_one(j, ["n_regionkey"], "index", "w").select("n_nationkey", F.col("index").alias("mu"), "normalised"), mu=9, normalised=9)


@query("""SELECT p_type, round(k, 9) AS k, round(CASE WHEN p_type = 'PROMO' THEN 0.4e0 ELSE 0.2e0 END / 2e0 / k, 9) AS scale
FROM (SELECT p_type, CAST(sum(p_size) AS DOUBLE) / (SELECT count(*) FROM customer) AS k FROM part GROUP BY p_type)""")
def generation_scales(spark, d):
    rates = {t: 0.4 if t == "PROMO" else 0.2 for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")}
    return rounded(apportion.generation_scales(table(spark, d, "part"), table(spark, d, "customer").withColumn("one", F.lit(1)), "p_type", "p_size", "one", rates), k=9, scale=9)


@query("""SELECT c_nationkey, CAST(CASE WHEN d < 2 THEN 0 WHEN d < 5 THEN 1 WHEN d < 10 THEN 2 ELSE 3 END AS INT) AS ring, round(sum(s_acctbal), 2) AS mass FROM (SELECT DISTINCT c_nationkey FROM customer) CROSS JOIN (SELECT s_nationkey, s_acctbal, 0 AS z FROM supplier) s, LATERAL (SELECT abs(c_nationkey - s_nationkey) AS d) GROUP BY ALL""")
def ring_masses(spark, d):
    o = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(table(spark, d, "customer").select("c_nationkey").distinct(), "c_nationkey")
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("m"))  # a row for each nation
    return rounded(flows.ring_masses(o, s, F.abs(F.col("c_nationkey") - F.col("s_nationkey")), "m", [2, 5, 10], "c_nationkey"), mass=2)


# --- edges, paths, alternatives ----------------------------------------------------


@query("SELECT l_partkey, l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def edge_min_dedup(spark, d):
    return graph.cheapest_edges(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM (SELECT o_orderkey % 500 AS a, lead(o_orderkey % 500) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL AND a <> b""")
def undirected_pairs(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.col("o_orderkey") % 500)
    return relational.undirected(relational.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v"), "from", "to")


_ALT = """WITH o AS (SELECT o_custkey, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders),
g AS (SELECT o_custkey, max(t) FILTER (k = 0) AS chosen, min(t) FILTER (k > 0) AS fastest, CAST(arg_min(k, struct_pack(t := t, k := k)) FILTER (k > 0) AS INT) AS fastest_rank FROM o GROUP BY ALL HAVING count(*) > 1)"""


def _alternatives(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return relational.chosen_against_fastest(table(spark, d, "orders").withColumn("k", k), ["o_custkey"], "k", "o_totalprice")


@query(_ALT + " SELECT * FROM g")
def fastest_alternative(spark, d):
    return _alternatives(spark, d)


@query(_ALT + """ SELECT CASE WHEN chosen > fastest AND o_custkey % 3 = 0 THEN 'true_violation' WHEN chosen > fastest THEN 'timing_divergence' WHEN o_custkey % 3 = 0 THEN 'concordant_bad' ELSE 'concordant_ok' END AS class, count(*) AS n FROM g GROUP BY ALL""")
def violation_table(spark, d):
    c = relational.violation_class(F.col("chosen") > F.col("fastest"), F.col("o_custkey") % 3 == 0)
    return _alternatives(spark, d).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(sum(l_quantity) / sum(l_quantity / l_extendedprice), 4) AS speed FROM lineitem GROUP BY ALL")
def harmonic_speed(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(weighted.harmonic_speed(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("speed"))


@query("""SELECT l_suppkey, l_returnflag || '|' || l_linestatus AS bucket, sum(l_quantity) AS length, (SELECT sum(l_quantity) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey AND x.l_returnflag = 'R') AS unbucketed
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL""")
def map_buckets(spark, d):
    b = F.when(F.col("l_returnflag") != "R", F.concat_ws("|", "l_returnflag", "l_linestatus"))
    m = relational.map_buckets(table(spark, d, "lineitem"), ["l_suppkey"], b, F.col("l_quantity"))
    return m.select("l_suppkey", F.explode("by_bucket").alias("bucket", "length"), "unbucketed")


@query("""SELECT l_returnflag || '|' || l_linestatus AS bucket, sum(l_quantity) AS length FROM lineitem GROUP BY ALL""")
def bucket_coverage(spark, d):
    return relational.bucket_coverage(relational.map_buckets(table(spark, d, "lineitem"), ["l_suppkey"], F.concat_ws("|", "l_returnflag", "l_linestatus"), F.col("l_quantity")))


@query("""SELECT l_returnflag, l_linestatus, CAST(CASE WHEN l_linestatus IS NOT NULL THEN 0 WHEN l_returnflag IS NOT NULL THEN 1 ELSE 3 END AS INT) AS level, count(*) AS n, round(median(l_extendedprice / l_quantity), 6) AS median_ratio, round(avg(abs(ln(l_extendedprice / (2000e0 * l_quantity)))), 6) AS mean_abs_log
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def leg_band_eval(spark, d):
    li = table(spark, d, "lineitem").withColumn("ratio", F.col("l_extendedprice") / F.col("l_quantity"))
    got = relational.levels(li, "l_returnflag", "l_linestatus", {"n": F.count("*"), "mean_abs_log": F.avg(F.abs(F.log(F.col("l_extendedprice") / (F.lit(2000.0) * F.col("l_quantity")))))})
    m = weighted.level_medians(li, "ratio", [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "median_ratio")
    m = m.withColumn("_l", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), F.col("level") + 1)).drop("level")
    m = m.toDF(*(f"_{c}" for c in m.columns))
    both = got.join(m, (F.col("level") == F.col("__l")) & F.col("l_returnflag").eqNullSafe(F.col("_l_returnflag")) & F.col("l_linestatus").eqNullSafe(F.col("_l_linestatus")))
    return rounded(both.select("l_returnflag", "l_linestatus", "level", "n", F.col("_median_ratio").alias("median_ratio"), "mean_abs_log"), median_ratio=6, mean_abs_log=6)


@query("""SELECT side, node, v FROM (SELECT 'top' AS side, c_custkey AS node, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer
UNION ALL SELECT 'bottom', c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) FROM customer) WHERE k <= 5""")
def sources_and_sinks(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("v"))
    return relational.top_and_bottom(c, "v", 5, "node")


# --- sampling ----------------------------------------------------------------------

_HASH = "('0x' || substr(md5(CAST({} AS VARCHAR) || '|{}'), 1, 12))::BIGINT / 281474976710656e0"


@query(f"""WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
b AS (SELECT *, CASE WHEN k < n // 4 THEN 0 WHEN k < n // 2 THEN 1 WHEN k < 3 * n // 4 THEN 2 ELSE 3 END AS band, {_HASH.format('o_orderkey', 7)} AS h FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, band ORDER BY h, o_orderkey) AS i FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN i > [6, 8, 12, 14][band + 1] THEN 1 ELSE 0 END, h, o_orderkey) AS m FROM q)
SELECT o_orderkey, CAST(band AS INT) AS band FROM s WHERE m <= 40""")
def quota_sample(spark, d):
    return sampling.quota_sample(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 40, seed=7).select("o_orderkey", "band")


_BOOT = f"""WITH c AS (SELECT DISTINCT c_nationkey AS k, c_nationkey % 5 AS s FROM customer), k AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM c),
w AS (SELECT s, i, n, unnest(range(20)) AS replicate FROM k),
h AS (SELECT s, replicate, CAST(floor(n * {_HASH.format("s AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|' || CAST(replicate", 3)}) AS BIGINT) AS i, count(*) AS m FROM w GROUP BY ALL)"""


@query(_BOOT + " SELECT CAST(replicate AS INT) AS replicate, CAST(sum(m) AS BIGINT) AS drawn, round(sum(m * t), 2) AS total FROM h JOIN k USING (s, i) JOIN (SELECT c_nationkey AS k, sum(c_acctbal) AS t FROM customer GROUP BY 1) USING (k) GROUP BY ALL")
def cluster_bootstrap(spark, d):
    c = table(spark, d, "customer").withColumn("s", F.col("c_nationkey") % 5)
    m = sampling.bootstrap_multiplicities(c, ["s"], "c_nationkey", 20, seed=3)
    t = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("t"))
    return rounded(m.join(t, "c_nationkey").groupBy("replicate").agg(F.sum("multiplicity").alias("drawn"), F.sum(F.col("multiplicity") * F.col("t")).alias("total")), total=2)


@query(f"""SELECT draw, min(c_custkey) AS c_custkey FROM (SELECT CAST(range AS BIGINT) AS draw, {_HASH.format('range', 11)} AS u FROM range(200)) JOIN (SELECT c_custkey, CAST(sum(w) OVER (ORDER BY c_custkey) AS DOUBLE) AS cum, CAST(sum(w) OVER () AS DOUBLE) AS total FROM (SELECT c_custkey, c_custkey % 10 AS w FROM customer)) ON cum > u * total GROUP BY draw""")
def weighted_draws(spark, d):
    c = table(spark, d, "customer").withColumn("w", (F.col("c_custkey") % 10).cast("double"))
    return sampling.draw_weighted(c, "c_custkey", "w", 200, seed=11)


@query("""SELECT * FROM (VALUES (0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3)) g(i, j), LATERAL (SELECT round(sum([1e0, l_quantity, l_tax + 0e0][i + 1] * [1e0, l_quantity, l_tax + 0e0, l_discount + 0e0][j + 1] * l_linenumber), 3) AS value FROM lineitem)""")
def normal_equations(spark, d):
    li = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return rounded(weighted.normal_equations(li, ["one", "l_quantity", "l_tax"], ["l_discount"], F.col("l_linenumber")), value=3)


# --- semi-structured, text, space ---------------------------------------------------


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total, CAST(max(CAST(json_extract_string(props, '$.k') AS INT)) AS INT) AS top FROM events GROUP BY ALL")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("""SELECT label, i // 8 AS a, i % 8 AS b, round(sum(v), 6) AS total FROM (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL""")
def array_decode(spark, d):
    c = relational.jsonstat_cells(F.transform("embedding", lambda x: x.cast("double")), [8, 8])
    e = table(spark, d, "embeddings").select("label", F.explode(c).alias("c"))
    return rounded(e.groupBy("label", F.col("c.index")[0].cast("long").alias("a"), F.col("c.index")[1].cast("long").alias("b")).agg(F.sum("c.value").alias("total")), total=6)


_POINTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"""WITH {_POINTS}, j AS (SELECT a.vec_id, b.vec_id AS near, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT q.vec_id, n.near, n.distance FROM p q LEFT JOIN (SELECT vec_id, arg_min(near, struct_pack(a := dist, b := near)) AS near, round(min(dist), 9) AS distance FROM j WHERE dist <= 0.05e0 GROUP BY ALL) n ON q.vec_id = n.vec_id""")
def knn(spark, d):
    p = _points(spark, d)
    return rounded(spatial.nearest(p, p.withColumnRenamed("vec_id", "near"), "vec_id", "near", 0.05, others=True), distance=9)


@query(f"WITH {_POINTS} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01e0")
def points_within(spark, d):
    return rounded(spatial.pairs_within(_points(spark, d), "vec_id", 0.01), distance=9)


@query(f"""WITH RECURSIVE {_POINTS}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.004e0),
w AS (SELECT vec_id AS s, vec_id AS n FROM p UNION SELECT w.s, e.b FROM w JOIN e ON w.n = e.a) SELECT s AS vec_id, min(n) AS cluster FROM w GROUP BY s""")
def components(spark, d):
    return matching.clusters(_points(spark, d), "vec_id", 0.004, cut=sinks.cut_lineage)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS u, (n_nationkey + 1) % 25 AS v, 1e0 + n_nationkey % 4 AS c FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 9e0 FROM nation),
w AS (SELECT u AS source, u AS node, 0e0 AS dist, 0 AS k FROM (SELECT DISTINCT u FROM e) UNION ALL SELECT source, node, min(dist), k FROM (SELECT source, v AS node, dist + c AS dist, k + 1 AS k FROM w JOIN e ON node = u WHERE k < 6) GROUP BY source, node, k)
SELECT source, node, min(dist) AS dist FROM w GROUP BY ALL""")
def shortest_path(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("u"))
    e = n.select("u", ((F.col("u") + 1) % 25).alias("v"), (F.lit(1.0) + F.col("u") % 4).alias("cost")).unionByName(n.select("u", ((F.col("u") + 7) % 25).alias("v"), F.lit(9.0).alias("cost")))
    return graph.hops_within(e, n.withColumnRenamed("u", "source"), 6)


def routed_pairs(spark, d):
    """Shortest paths with their links, between nations over a ring with chords."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("u"))
    e = n.select("u", ((F.col("u") + 1) % 25).alias("v"), (F.lit(1.0) + F.col("u") % 4).alias("cost"), F.col("u").alias("link_id")).unionByName(n.select("u", ((F.col("u") + 7) % 25).alias("v"), F.lit(9.0).alias("cost"), (F.col("u") + 100).alias("link_id")))
    return e, flows.admissible_pairs(n.select(F.col("u").alias("node"), F.lit(False).alias("external")))


@query()
def path_incidence(spark, d):
    e, pairs = routed_pairs(spark, d)
    return rounded(graph.random_path_incidence(e, pairs, passes=10), dist=6, weight=6)


_RING = """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS u, CAST((n_nationkey + 1) % 25 AS BIGINT) AS v, 1e0 + n_nationkey % 4 AS c FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 9e0 FROM nation),
w AS (SELECT u AS src, u AS node, 0e0 AS cost FROM e UNION SELECT w.src, e.v, w.cost + e.c FROM w JOIN e ON e.u = w.node WHERE w.cost + e.c <= 70)"""


@query(_RING + " SELECT src, node AS dst, min(cost) AS dist FROM w WHERE src <> node GROUP BY ALL")
def path_distances(spark, d):
    """Distances of all pairs by searches from each source."""
    return graph.shortest_paths(*routed_pairs(spark, d)).select("src", "dst", "dist")


@query(_RING + " SELECT src, node AS dst, min(cost) AS dist, min(cost) AS along FROM w WHERE src <> node GROUP BY ALL")
def path_sums(spark, d):
    """Each path's links, added up, give its distance."""
    e, pairs = routed_pairs(spark, d)
    p = graph.shortest_paths(e, pairs).select("src", "dst", "dist", F.explode("links").alias("link_id"))
    return p.join(e, "link_id").groupBy("src", "dst", "dist").agg(F.sum("cost").alias("along"))


@query(_RING + " SELECT src, node AS dst, min(cost) AS dist, 1e0 AS least FROM w WHERE src <> node GROUP BY ALL")
def unperturbed_incidence(spark, d):
    """Without variation every pass takes a shortest path, so each link of it has weight 1."""
    e, pairs = routed_pairs(spark, d)
    i = graph.random_path_incidence(e, pairs, passes=3, variation=0.0)
    return i.groupBy("src", "dst").agg(F.max("dist").alias("dist"), F.min("weight").alias("least"))


@query()
def dijkstra_paths(spark, d):
    return graph.shortest_paths(*routed_pairs(spark, d))


@query("""SELECT CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'hardware' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured' WHEN regexp_matches(p_name, 'gear') THEN 'gears' END AS kind, count(*) AS n FROM part GROUP BY ALL""")
def regex_first_match(spark, d):
    kind = domain.first_match(F.col("p_name"), [("hardware", "ring|bolt"), ("coloured", "^(red|blue)"), ("gears", "gear")])
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT p_brand, p_name FROM part),
s AS (SELECT l.p_brand, l.p_name, q.p_name AS name, len(list_intersect(string_split(l.p_name, ' '), string_split(q.p_name, ' '))) / CAST(len(list_distinct(list_concat(string_split(l.p_name, ' '), string_split(q.p_name, ' ')))) AS DOUBLE) AS score FROM p l JOIN p q ON l.p_brand = q.p_brand AND l.p_name <> q.p_name),
b AS (SELECT p_brand, p_name, arg_max(name, struct_pack(a := score, b := name)) AS matched, max(score) AS score FROM s WHERE score >= 0.3e0 GROUP BY ALL)
SELECT p.p_brand, p.p_name, matched, round(score, 6) AS score FROM p LEFT JOIN b ON p.p_brand = b.p_brand AND p.p_name = b.p_name""")
def fuzzy_block(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    return rounded(matching.fuzzy_join(p, p.withColumnRenamed("p_name", "name"), "p_brand", "p_name", "name", 0.3, others=True), score=6)


@query()
def fuzzy_similarity(spark, d):
    """Of each name the most similar other one of its brand, by words and by matching blocks."""
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    return rounded(matching.fuzzy_join(p, p.withColumnRenamed("p_name", "name"), "p_brand", "p_name", "name", 0.5, score=matching.similarity, others=True), score=6)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'override' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 10 = 3 AND s_suppkey % 20 = 3 THEN 0e0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 4
UNION ALL SELECT s_suppkey, 'patched', 1e0 FROM supplier WHERE s_suppkey % 10 = 4""")
def upsert_override(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    manual = s.where("s_suppkey % 10 = 3").select("s_suppkey", F.lit("override").alias("s_name"), F.when(F.col("s_suppkey") % 20 == 3, F.lit(0.0)).alias("s_acctbal"))
    patch = s.where("s_suppkey % 10 = 4").select("s_suppkey", F.lit("patched").alias("s_name"), F.lit(1.0).alias("s_acctbal"))
    return relational.upsert(relational.override(s, manual, ["s_suppkey"], ["s_name", "s_acctbal"]), patch, ["s_suppkey"])


@query("SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_acctbal, c_acctbal) AS v FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def merge_right_wins(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return relational.merge_right_wins(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v")), "key", "v")


@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS last_value, arg_min(value, struct_pack(a := ts, b := event_id)) AS first_value FROM events GROUP BY ALL")
def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    order = [F.col("ts"), F.col("event_id")]
    last = relational.last_per_key(e, ["user_id", "event_type"], order).select("user_id", "event_type", F.col("value").alias("last_value"))
    return last.join(relational.first_per_key(e, ["user_id", "event_type"], order).select("user_id", "event_type", F.col("value").alias("first_value")), ["user_id", "event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1 AND value > 50)")
def pending_work(spark, d):
    e = table(spark, d, "events")
    return relational.pending(e.where("event_id % 2 = 0").select("user_id", "event_type").distinct(), e.where("event_id % 2 = 1 and value > 50"), ["user_id", "event_type"])


@query("""SELECT event_id, (SELECT max(f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'view' AND f.ts <= e.ts AND f.ts >= e.ts - INTERVAL 3600 SECOND) AS fix FROM events e WHERE event_type = 'purchase'""")
def recent_fix(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    fixes = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("fix_ts"), F.col("event_id").alias("fix_id"))
    got = observe.recent_fix(e.where("event_type = 'purchase'"), fixes, "user_id", "ts", "fix_ts", 3600.0)
    return got.select("event_id", F.col("fix.fix_id").alias("fix"))


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS slot, CAST(greatest(CAST(isodow(ts) - 5 AS INT), 0) AS INT) AS day_type, CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_hourly(spark, d):
    static = table(spark, d, "events")
    stream = streaming.read_events(spark, f"{d}/events.parquet*", static.schema).withColumn("ts", ts("ts"))
    out = streaming.hourly(streaming.dedupe(stream, "ts", ["event_id"], "40 days"), "ts", ["event_type"], F.col("value"), None)
    got = streaming.run_to_path(out, sinks.shared_folder(spark, "hourly"), sinks.shared_folder(spark, "progress"))
    return rounded(got.withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm")), total=4)


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
(SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, g""")
def session_windows(spark, d):
    static = table(spark, d, "events")
    stream = streaming.read_events(spark, f"{d}/events.parquet*", static.schema).withColumn("ts", ts("ts"))
    out = streaming.sessions(stream, "ts", ["user_id"], "6 hours", None)
    s = streaming.run_to_path(out, sinks.shared_folder(spark, "sessions"), sinks.shared_folder(spark, "progress"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_LL = "(SELECT c_custkey, 51e0 + c_custkey % 500 / 100e0 AS lat1, -10e0 + c_custkey % 300 / 100e0 AS lon1, 52e0 + c_custkey % 370 / 100e0 AS lat2, -9e0 + c_custkey % 410 / 100e0 AS lon2 FROM customer)"


def _coords(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", *((F.lit(a) + k % m / F.lit(100.0)).alias(n) for n, a, m in (("lat1", 51.0, 500), ("lon1", -10.0, 300), ("lat2", 52.0, 370), ("lon2", -9.0, 410))))


@query(f"""SELECT c_custkey, round(2e0 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 4) AS metres,
round(((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360e0) % 360e0), 6) AS bearing FROM {_LL}""")
def haversine_pairs(spark, d):
    c = [F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return _coords(spark, d).select("c_custkey", r(scalar.haversine_m(*c), 4).alias("metres"), r(scalar.bearing_deg(*c)).alias("bearing"))


_GRID = f"""WITH c AS (SELECT (1 / 298.257222101e0) / (2 - 1 / 298.257222101e0) AS n), a AS (SELECT n, 2 * sqrt(n) / (1 + n) AS k, 6378137e0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS radius,
n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3 FROM c),
p AS (SELECT c_custkey, lat1, lon1, sin(radians(lat1)) AS s, radians(lon1 + 8e0) AS d, a.* FROM {_LL}, a UNION ALL SELECT -1, 53.5e0, -8e0, sin(radians(53.5e0)), 0e0, a.* FROM a),
q AS (SELECT *, sinh(ln((1 + s) / (1 - s)) / 2 - k * ln((1 + k * s) / (1 - k * s)) / 2) AS t FROM p), e AS (SELECT *, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM q),
g AS (SELECT *, radius * 0.99982e0 * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east, radius * 0.99982e0 * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM e)
SELECT c_custkey, lat1, lon1, round(600000e0 + east, 3) AS x, round(750000e0 + north - (SELECT north FROM g WHERE c_custkey = -1), 3) AS y FROM g WHERE c_custkey >= 0"""


@query(_GRID)
def irish_grid(spark, d):
    g = spatial.to_itm(F.col("lat1"), F.col("lon1"))
    return _coords(spark, d).select("c_custkey", "lat1", "lon1", r(g["x"], 3).alias("x"), r(g["y"], 3).alias("y"))


@query("""SELECT c_custkey, CASE WHEN x + y < 1 THEN 'triangle' WHEN x >= 1 THEN 'square' END AS polygon FROM (SELECT c_custkey, 0.001e0 + c_custkey % 199 / 100e0 AS x, 0.0007e0 + c_custkey % 97 / 100e0 AS y FROM customer) WHERE x + y < 1 OR x >= 1""")
def polygon_join(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", (F.lit(0.001) + k % 199 / F.lit(100.0)).alias("x"), (F.lit(0.0007) + k % 97 / F.lit(100.0)).alias("y"))
    ring = lambda *pts: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))
    polys = spark.range(1).select(F.explode(F.array(F.struct(F.lit("triangle").alias("polygon"), ring((0, 0), (1, 0), (0, 1)).alias("ring")), F.struct(F.lit("square").alias("polygon"), ring((1, 0), (2, 0), (2, 1), (1, 1)).alias("ring")))).alias("p")).select("p.*")
    return spatial.points_in_polygons(p, polys, "c_custkey", "polygon", 0.5)


@query("""SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0e0 WHEN p_size % 5 = 0 THEN CASE WHEN p_size > 25 THEN p_size * 10 ELSE p_retailprice * (p_size % 4 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END) / 30e0 END
WHEN p_size % 3 = 0 AND p_retailprice / p_size BETWEEN 8 AND 80 THEN CAST(p_size AS DOUBLE) WHEN p_size % 2 = 0 THEN p_retailprice / 13e0 ELSE p_retailprice / 30e0 END, 6) AS spaces FROM part""")
def parking_spaces(spark, d):
    s = F.col("p_size")
    tags = F.create_map(
        F.lit("access"), F.when(s % 7 == 0, "private").otherwise("yes"),
        F.lit("parking"), F.when(s % 5 == 0, "multi-storey").when(s % 2 == 0, "lane").otherwise("surface"),
        F.lit("capacity"), F.when((s % 5 == 0) & (s > 25), (s * 10).cast("string")).when((s % 5 != 0) & (s % 3 == 0), s.cast("string")),
        F.lit("building:levels"), (s % 4).cast("string"),
    )
    return table(spark, d, "part").select("p_partkey", r(domain.parking_spaces(tags, F.col("p_retailprice"))).alias("spaces"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'St Mary Primary' WHEN 1 THEN 'Royal High School' WHEN 2 THEN 'Gaelscoil na Mara' WHEN 3 THEN 'Community College' ELSE 'The Rectory' END AS name, CASE WHEN p_size = 1 THEN 'special' END AS tag FROM part)
SELECT p_partkey, CASE WHEN tag = 'special' THEN 'sen' WHEN p_partkey % 5 IN (0, 2) THEN 'primary' WHEN p_partkey % 5 IN (1, 3) THEN 'secondary' ELSE 'unknown' END AS class, CAST(CASE WHEN tag = 'special' THEN 80 WHEN p_partkey % 5 IN (1, 3) THEN 820 ELSE 210 END AS INT) AS pupils FROM n""")
def school_classes(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "St Mary Primary").when(k == 1, "Royal High School").when(k == 2, "Gaelscoil na Mara").when(k == 3, "Community College").otherwise("The Rectory")
    tag = F.when(F.col("p_size") == 1, "special")
    return table(spark, d, "part").select("p_partkey", domain.school_class(tag, name).alias("class"), domain.school_enrolment(tag, name, F.lit("NI")).alias("pupils"))


@query("""WITH b AS (SELECT p_partkey, p_size, p_size * 1.609344e0 / 1.609344e0 AS mph, p_size % 10 = 0 AS bare FROM part),
c AS (SELECT *, CASE WHEN bare THEN 'untagged' WHEN abs(mph - 20) <= 3 THEN '20' WHEN abs(mph - 30) <= 3 THEN '30' WHEN abs(mph - 40) <= 3 THEN '40' WHEN abs(mph - 50) <= 3 THEN '50' ELSE 'other' END AS band FROM b)
SELECT p_partkey, band, round(CASE WHEN band IN ('untagged', 'other') THEN 55e0 ELSE TRY_CAST(band AS DOUBLE) * 1.609344e0 * 0.8e0 END, 6) AS kmh FROM c""")
def road_buckets(spark, d):
    tags = F.create_map(F.lit("maxspeed"), F.when(F.col("p_size") % 10 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" mph"))))
    b = table(spark, d, "part").select("p_partkey", domain.band_of_tags(tags).alias("band"))
    return b.select("p_partkey", "band", r(domain.base_kmh(F.lit("secondary"), F.col("band"))).alias("kmh"))


@query("SELECT r_name, count(*) AS nations, sum(len(n_name)) FILTER (n_nationkey % 2 = 0)::BIGINT AS letters FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def region_summary(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.count("*").alias("nations"), F.sum(F.when(F.col("n_nationkey") % 2 == 0, F.length("n_name"))).alias("letters"))


# --- closed forms, curves, networks --------------------------------------------------

_T = "(SELECT p_partkey, CAST(60 + p_partkey % 97 * 60 AS DOUBLE) AS t, p_size FROM part)"


@query(f"""SELECT p_partkey, round(exp(-5.6726e0 + 0.9591e0 * ln(t) + 0.02319e0 * ln(t) * ln(t)), 6) AS miles, round(1.04e-3 * pow(t, 1.2955e0), 6) AS miles_power,
round(exp(-5.6726e0 + 0.9591e0 * ln(t) + 0.02319e0 * ln(t) * ln(t)) * (0.9591e0 + 0.04638e0 * ln(t)) / t, 9) AS slope,
round(0.6940e0 * (1e0 - exp(-pow(exp(-5.6726e0 + 0.9591e0 * ln(t) + 0.02319e0 * ln(t) * ln(t)) / 1.2867e0, 0.9888e0))), 9) AS commute,
round(0.3199e0 * (1e0 - exp(-pow(exp(-5.6726e0 + 0.9591e0 * ln(t) + 0.02319e0 * ln(t) * ln(t)) / 1.6968e0, 1.9983e0))), 9) AS tertiary FROM {_T}""")
def kernel_values(spark, d):
    t = (F.lit(60) + F.col("p_partkey") % 97 * 60).cast("double")
    m = kernels.equivalent_miles(t)
    return table(spark, d, "part").select("p_partkey", r(m).alias("miles"), r(kernels.equivalent_miles_power(t)).alias("miles_power"), r(kernels.equivalent_miles_slope(t), 9).alias("slope"), r(kernels.drive_share(m, "commute"), 9).alias("commute"), r(kernels.drive_share(m, "school_tertiary"), 9).alias("tertiary"))


@query(f"""SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN 0e0 ELSE 7.5e0 / (1e0 + exp(-(CASE WHEN a >= 0 THEN 13e0 * 1.075e0 * a / 180e0 - 6.5e0 / 1.075e0 ELSE 13e0 / 1.075e0 * -a / 180e0 - 6.5e0 * 1.075e0 END))) END, 6) AS seconds
FROM (SELECT p_partkey, p_size, CAST(p_partkey % 361 - 180 AS DOUBLE) AS a FROM part)""")
def turn_penalties(spark, d):
    a = (F.col("p_partkey") % 361 - 180).cast("double")
    return table(spark, d, "part").select("p_partkey", r(kernels.turn_penalty(a, F.when(F.col("p_size") % 4 == 0, 2).otherwise(3), F.lit(False))).alias("seconds"))


@query(f"""SELECT p_partkey, round(CASE WHEN t <= 100 THEN 2e0 WHEN t < 1000 THEN exp(ln(2e0) + (ln(20e0) - ln(2e0)) * (ln(t) - ln(100e0)) / (ln(1000e0) - ln(100e0))) WHEN t < 4000 THEN exp(ln(20e0) + (ln(5e0) - ln(20e0)) * (ln(t) - ln(1000e0)) / (ln(4000e0) - ln(1000e0))) ELSE 5e0 END, 6) AS y FROM {_T}""")
def interpolated(spark, d):
    t = (F.lit(60) + F.col("p_partkey") % 97 * 60).cast("double")
    return table(spark, d, "part").select("p_partkey", r(scalar.interpolate_loglog(t, [100, 1000, 4000], [2, 20, 5])).alias("y"))


_CURVE = """c AS (SELECT p_type, p_size, count(*) AS y FROM part GROUP BY ALL), s AS (SELECT *, coalesce((p_size - lag(p_size) OVER w) * (y + lag(y) OVER w) / 2e0, 0e0) AS s FROM c WINDOW w AS (PARTITION BY p_type ORDER BY p_size)),
a AS (SELECT *, sum(s) OVER (PARTITION BY p_type ORDER BY p_size) / sum(s) OVER (PARTITION BY p_type) AS cdf, y / sum(s) OVER (PARTITION BY p_type) AS density FROM s)"""


def _curve(spark, d):
    return weighted.trapezoid_normalise(table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count("*").cast("double").alias("y")), "p_size", "y", ["p_type"])


@query(f"WITH {_CURVE} SELECT p_type, p_size, round(density, 9) AS density, round(cdf, 9) AS cdf FROM a")
def density_curves(spark, d):
    return rounded(_curve(spark, d).select("p_type", "p_size", "density", "cdf"), density=9, cdf=9)


@query(f"WITH {_CURVE}, q AS (SELECT *, lag(p_size) OVER w AS x0, lag(cdf) OVER w AS c0 FROM a WINDOW w AS (PARTITION BY p_type ORDER BY p_size)) SELECT p_type, round(min(x0 + (p_size - x0) * (0.9e0 - c0) / (cdf - c0)), 6) AS quantile FROM q WHERE cdf >= 0.9e0 AND c0 < 0.9e0 GROUP BY ALL")
def curve_p90(spark, d):
    return rounded(weighted.curve_quantile(_curve(spark, d), "p_size", ["p_type"], 0.9), quantile=6)


@query("""SELECT p_type, bin, round(m, 2) AS mass, round(m / sum(m) OVER (PARTITION BY p_type), 9) AS share
FROM (SELECT p_type, CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS INT) AS bin, sum(p_retailprice) AS m FROM part GROUP BY ALL)""")
def time_histogram(spark, d):
    return rounded(weighted.weighted_histogram(table(spark, d, "part"), ["p_type"], F.col("p_size"), F.col("p_retailprice"), [0, 10, 30, 50]), mass=2, share=9)


@query("""SELECT n_name AS site, round(sum(coalesce(f, 0)), 2) AS flow FROM nation JOIN LATERAL (SELECT unnest([n_nationkey, n_nationkey + 20]) AS u) l ON true
LEFT JOIN (SELECT c_nationkey AS cu, sum(c_acctbal) AS f FROM customer GROUP BY 1) ON cu = u GROUP BY ALL""")
def site_readout(spark, d):
    k = F.col("n_nationkey").cast("long")
    sites = table(spark, d, "nation").select(F.col("n_name").alias("site"), F.array(*(F.struct((k + i).alias("u"), F.lit(0).cast("long").alias("v")) for i in (0, 20))).alias("links"))
    f = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("u")).agg(F.sum("c_acctbal").alias("flow")).withColumn("v", F.lit(0).cast("long"))
    return rounded(observe.site_readout(sites, f), flow=2)


@query("SELECT l_suppkey AS u, l_partkey AS v FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE (l_suppkey % 7 = 0) <> (l_partkey % 7 = 0)")
def boundary_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return spatial.boundary_edges(e, nodes.where("node % 7 = 0"))


@query("""SELECT CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_nationkey END AS BIGINT) AS node, round(sum(c_acctbal), 2) AS mass, round(sum(c_custkey * w) / sum(w), 6) AS level FROM (SELECT *, CAST(1 + c_custkey % 3 AS DOUBLE) AS w FROM customer) GROUP BY 1""")
def collapsed_nodes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("node"), F.col("c_acctbal").alias("mass"), F.col("c_custkey").cast("double").alias("level"), (F.lit(1) + F.col("c_custkey") % 3).cast("double").alias("w"))
    m = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("node"), F.lit(0).cast("long").alias("into"))
    return rounded(graph.collapse(c, m, ["mass"], ["level"], "w"), mass=2, level=6)


@query("SELECT node, CAST(sum(o) AS BIGINT) AS \"out\", CAST(sum(i) AS BIGINT) AS \"in\" FROM (SELECT l_suppkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_partkey, 0, 1 FROM lineitem) GROUP BY ALL")
def node_degrees(spark, d):
    return graph.degrees(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT s_suppkey, round(sqrt((sum(x * x * w) - sum(x * w) * sum(x * w) / sum(w)) / sum(w)), 4) AS sd, round(sum(x * w) / sum(w), 6) AS mean, round(sqrt((sum(x * x * w) - sum(x * w) * sum(x * w) / sum(w)) / sum(w)) / (sum(x * w) / sum(w)), 6) AS cv
FROM (SELECT l_suppkey AS s_suppkey, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS w FROM lineitem) GROUP BY ALL""")
def weighted_spread(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return rounded(weighted.weighted_spread(li, F.col("l_quantity"), F.col("l_linenumber"), ["s_suppkey"]), mean=6, sd=4, cv=6)


@query("""SELECT event_type, round(1.4826e0 * median(abs(value - m)), 6) AS sigma FROM events JOIN (SELECT event_type AS e, median(value) AS m FROM events GROUP BY 1) ON event_type = e GROUP BY ALL""")
def mad_sigma(spark, d):
    return rounded(weighted.mad_sigma(table(spark, d, "events"), "value", ["event_type"]), sigma=6)


@query("""SELECT user_id, CASE greatest(CAST(isodow(ts) - 5 AS INT), 0) WHEN 0 THEN 'Week' WHEN 1 THEN 'Sat' ELSE 'Sun' END || ' ' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '00' AS slot, count(*) AS n FROM events GROUP BY ALL""")
def slot_labels(spark, d):
    s = scalar.slot_label(scalar.day_type(F.col("ts")), F.hour("ts"))
    return table(spark, d, "events").groupBy("user_id", s.alias("slot")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CAST(idx AS BIGINT) AS bucket, cls, band FROM (SELECT p_partkey, CAST(p_partkey % 128 AS BIGINT) AS idx,
['motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','unclassified','residential','living_street','service','road','other'][p_partkey % 128 // 8 + 1] AS cls,
['untagged','20','30','40','50','60','70','other'][p_partkey % 8 + 1] AS band FROM part)""")
def bucket_codes(spark, d):
    b = table(spark, d, "part").select("p_partkey", domain.bucket_of_index(F.col("p_partkey") % 128).alias("b")).select("p_partkey", "b.cls", "b.band")
    return b.select("p_partkey", domain.bucket_index(F.col("cls"), F.col("band")).cast("long").alias("bucket"), "cls", "band")


@query("""SELECT c_custkey, x_lon AS lon, y_lat AS lat FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE -10e0 + c_custkey % 300 / 100e0 END AS x_lon, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 52e0 + c_custkey % 200 / 100e0 END AS y_lat FROM customer)""")
def repaired_places(spark, d):
    k = F.col("c_custkey")
    lon, lat = F.lit(-10.0) + k % 300 / F.lit(100.0), F.lit(52.0) + k % 200 / F.lit(100.0)
    x = F.when(k % 3 == 0, lon).when(k % 3 == 1, lat).otherwise(F.lit(7.0))
    y = F.when(k % 3 == 0, lat).when(k % 3 == 1, lon).otherwise(F.lit(9.0))
    return table(spark, d, "customer").select("c_custkey", spatial.repaired_place(x, y).alias("p")).select("c_custkey", "p.lon", "p.lat")


@query("""WITH p AS (SELECT user_id, CAST(event_id % 40 AS DOUBLE) AS x, CAST(user_id % 10 AS DOUBLE) AS y, 1e0 + event_id % 3 AS acc FROM events), e AS (SELECT n_nationkey AS edge, n_nationkey * 0.37e0 AS h FROM nation),
c AS (SELECT user_id, edge, sum((y - h) * (y - h) / (acc * acc)) AS cost, sum(1e0 / (acc * acc)) AS q FROM p, e GROUP BY ALL)
SELECT user_id, arg_min(edge, struct_pack(a := round(cost, 9), b := edge)) AS edge, round(sqrt(min(cost) / any_value(q)), 6) AS rmse FROM c GROUP BY user_id""")
def map_match(spark, d):
    p = table(spark, d, "events").select("user_id", (F.col("event_id") % 40).cast("double").alias("x"), (F.col("user_id") % 10).cast("double").alias("y"), (F.lit(1.0) + F.col("event_id") % 3).alias("accuracy"))
    h = F.col("n_nationkey") * F.lit(0.37)
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("edge"), F.lit(0.0).alias("x1"), h.alias("y1"), F.lit(39.0).alias("x2"), h.alias("y2"))
    return rounded(observe.map_match(p, e, "user_id", "accuracy", 50.0), rmse=6)


from . import further, more, networks  # noqa: E402, F401  they register their queries here
