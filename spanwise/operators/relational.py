"""Set operations, upserts, alternatives, sequences, sets of keys and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio


def upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` whose keys are not in ``patch``, and all of ``patch``."""
    return base.join(patch.select(*keys), list(keys), "left_anti").unionByName(patch, allowMissingColumns=True)


def override(base: DataFrame, manual: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``base`` with the columns that ``manual`` sets for its keys; a null there keeps the value."""
    m = manual.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(m, list(keys), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def merge_right_wins(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of either; the right's where both have one."""
    r = right.select(key, F.col(value).alias("_r"))
    return left.select(key, value).join(r, key, "full_outer").select(key, F.coalesce("_r", value).alias(value))


def sum_by_key(frames: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Sums over the union of the frames' keys."""
    out = frames[0].select(key, value)
    for f in frames[1:]:
        out = out.unionByName(f.select(key, value))
    return out.groupBy(key).agg(F.sum(value).alias(value))


def replace_component(existing: DataFrame, new: DataFrame, column: str, component) -> DataFrame:
    """``existing`` with the rows of one component taken from ``new``."""
    return existing.where(~F.col(column).eqNullSafe(F.lit(component))).unionByName(new.where(F.col(column).eqNullSafe(F.lit(component))), allowMissingColumns=True)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in order: what a file of repeated keys loads to."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs (low, high) of different ends."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def consecutive_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by, from, to): each value and the next one in order."""
    nxt = F.lead(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.select(*by, F.col(value).alias("from"), nxt.alias("to")).where(F.col("to").isNotNull())


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Part of ``a``'s distinct elements that are in ``b``."""
    return safe_ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double"))


def chosen_against_fastest(df: DataFrame, by: Sequence[str], rank: str, duration: str) -> DataFrame:
    """(by, chosen, fastest, fastest_rank): rank 0 beside the fastest of the others, for groups that have both."""
    alt = F.col(rank) != 0
    g = df.groupBy(*by).agg(F.max(F.when(~alt, F.col(duration))).alias("chosen"), F.min(F.when(alt, F.struct(F.col(duration).alias("d"), F.col(rank).alias("r")))).alias("_f"))
    return g.where("chosen is not null and _f is not null").select(*by, "chosen", F.col("_f.d").alias("fastest"), F.col("_f.r").alias("fastest_rank"))


def violation_class(external_slower: Column, own_slower: Column) -> Column:
    """How two models judge a chosen route against an alternative."""
    return F.when(external_slower & own_slower, "true_violation").when(external_slower, "timing_divergence").when(own_slower, "concordant_bad").otherwise("concordant_ok")


def top_and_bottom(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest, with a side column."""
    hi = df.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    lo = df.orderBy(value, tie).limit(n).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo)


def map_buckets(df: DataFrame, by: Sequence[str], bucket: Column, length: Column) -> DataFrame:
    """(by, by_bucket, unbucketed): summed length by bucket as a map, and what has none."""
    s = df.groupBy(*by, bucket.alias("_b")).agg(F.sum(length).alias("_l"))
    known = F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_l")))
    return s.groupBy(*by).agg(F.map_from_entries(F.array_sort(known)).alias("by_bucket"), F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("_l"))), F.lit(0.0)).alias("unbucketed"))


def bucket_coverage(df: DataFrame, column: str = "by_bucket") -> DataFrame:
    """(bucket, length) summed over maps."""
    return df.select(F.explode(column).alias("bucket", "length")).groupBy("bucket").agg(F.sum("length").alias("length"))


def levels(df: DataFrame, a: str, b: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by (a, b), by a, and over all, from one pass over the rows."""
    aggs = [m.alias(k) for k, m in measures.items()]
    return df.groupingSets([[F.col(a), F.col(b)], [F.col(a)], []], F.col(a), F.col(b)).agg(F.grouping_id().cast("int").alias("level"), *aggs)


def thin_capped(points: Column, step: float, most: int) -> Column:
    """``thin_by_distance``, but of more than ``most`` points, before or after, every so many and the end."""
    n, kept = F.size(points), thin_by_distance(points, step)
    stride = F.greatest(F.ceil(n / F.lit(most - 1)).cast("int"), F.lit(1))
    every = F.filter(points, lambda p, i: i % stride == 0)
    strided_ = F.when(F.element_at(every, -1) == F.element_at(points, -1), every).otherwise(F.concat(every, F.array(F.element_at(points, -1))))
    return F.when((n <= most) & (F.size(kept) <= most), kept).otherwise(strided_)


def thin_by_distance(points: Column, step: float) -> Column:
    """Of an array of (x, y): the first, each one at least ``step`` along the line after the last kept, and the end."""
    n = F.size(points)
    start = F.struct(F.array(F.element_at(points, 1)).alias("kept"), F.element_at(points, 1).alias("last"), F.lit(0.0).alias("run"))

    def go(acc, p):
        run = acc["run"] + F.hypot(p["x"] - acc["last"]["x"], p["y"] - acc["last"]["y"])
        far = run >= F.lit(float(step))
        return F.struct(F.when(far, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"), p.alias("last"), F.when(far, F.lit(0.0)).otherwise(run).alias("run"))

    kept = F.aggregate(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), start, go, lambda acc: acc["kept"])
    end = F.element_at(points, -1)
    return F.when(n <= 1, points).when(F.element_at(kept, -1) == end, kept).otherwise(F.concat(kept, F.array(end)))


def jsonstat_cells(values: Column, sizes: Sequence[int]) -> Column:
    """Array of (index in each dimension, value) of a dense cube stored by rows, nulls left out."""
    def cell(x, i):
        out, stride = [], 1
        for s in reversed(sizes):
            out.append(F.pmod(F.floor(i / stride).cast("int"), F.lit(s)))
            stride *= s
        return F.struct(F.array(*reversed(out)).alias("index"), x.alias("value"))

    return F.filter(F.transform(values, cell), lambda c: c["value"].isNotNull())


def without_links(df: DataFrame, excluded: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows but those of excluded directed links."""
    return df.join(excluded.select(u, v), [u, v], "left_anti")


def with_previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the values of the one before it in its group and the change since: ``previous_x``, ``change_x``."""
    w = Window.partitionBy(*by).orderBy(order)
    for c in columns:
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"change_{c}", F.col(c) - F.col(f"previous_{c}"))
    return df


def usable_routes(coverage: Column, confidence: Column, low: float, high: float, least: float) -> Column:
    """Whether a matched route's coverage lies in a band and its confidence is enough; null counts as not."""
    return F.coalesce((coverage >= low) & (coverage <= high) & (confidence >= least), F.lit(False))


def fit_domain(df: DataFrame, by: Sequence[str], value: str, n: str, plateau: float, least_n: float) -> DataFrame:
    """Rows that a curve is fitted to: finite, above 0, at least a share of their group's largest value, from ``least_n`` counts."""
    x = F.col(value).cast("double")
    ok = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0) & (F.col(n) >= least_n))
    top = ok.groupBy(*by).agg(F.max(value).alias("_top"))
    return ok.join(top, list(by)).where(F.col(value) >= F.lit(plateau) * F.col("_top")).select(*df.columns)


def reset_parameters(params: DataFrame, reference: DataFrame, ones: Sequence[str] = (), stale: Sequence[str] = ()) -> DataFrame:
    """(key, value): parameters with those of a reference in their place, scales set to 1 and stale ones left out."""
    scales = params.sparkSession.createDataFrame([(k, 1.0) for k in ones], "key string, value double")
    return upsert(upsert(params, reference, ["key"]), scales, ["key"]).where(~F.col("key").isin(*stale))


def assign_links(overrides: DataFrame, new: DataFrame, edges: DataFrame, counts: DataFrame, key: str = "session_id") -> DataFrame:
    """``overrides`` with new ones (key, u, v) in their place. A session with a count along a direction needs an edge that way:
    ``counts`` has (key, with_count, against_count); reading an override that breaks this raises an error."""
    e = edges.select("u", "v").distinct()
    along = e.select(F.col("u").alias("_a"), F.col("v").alias("_b"), F.lit(True).alias("_with"))
    back = e.select(F.col("v").alias("_c"), F.col("u").alias("_d"), F.lit(True).alias("_back"))
    j = new.join(counts, key, "left").join(along, (F.col("u") == F.col("_a")) & (F.col("v") == F.col("_b")), "left").join(back, (F.col("u") == F.col("_c")) & (F.col("v") == F.col("_d")), "left")
    bad = (F.col("with_count").isNotNull() & F.col("_with").isNull()) | (F.col("against_count").isNotNull() & F.col("_back").isNull()) | (F.col("_with").isNull() & F.col("_back").isNull())
    checked = j.select(F.when(bad, F.raise_error(F.concat(F.lit("no such edge for "), F.col(key).cast("string")))).otherwise(F.col(key)).alias(key), "u", "v")
    return upsert(overrides, checked, [key])
