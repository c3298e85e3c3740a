"""Seeded samples whose draws depend on keys and seeds alone, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slot_hash

#: Shares of a quota by length quartile.
QUARTILE_SHARES = (0.15, 0.20, 0.30, 0.35)


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with each row's place from 0 in its group and the group's size.

    A group is cut into ranges at approximate quantiles of the first order column, a number; rows
    are ranked within ranges, and the counts of the ranges before are added, so no task holds a group.
    """
    from .weighted import _with_group

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = order[0].cast("double")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    at = F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, at, F.lit(1000)).alias("_cuts"))
    ranged = _with_group(df, cuts, by).withColumn("_p", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < value))).drop("_cuts")
    counts = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = counts.groupBy(*keys).agg(F.collect_list(F.struct("_p", "_c")).alias("_all"))  # one number for each range
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1)
    add = lambda which: F.aggregate("_all", F.lit(0).cast("long"), lambda acc, x: acc + F.when(which(x["_p"]), x["_c"]).otherwise(F.lit(0)))
    placed = _with_group(own, before, by)
    return placed.withColumn(out, F.col("_i") + add(lambda p: p < F.col("_p"))).withColumn(size, add(lambda p: F.lit(True))).drop("_p", "_i", "_all")


def quartile_band(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "band") -> DataFrame:
    """Quartile by rank, cut at ``n // 4``, ``n // 2`` and ``3 * n // 4``."""
    cut = lambda k: F.floor(F.col("_size") * k / 4)
    ranked = ranks(df, by, order, "_r", "_size")
    return ranked.withColumn(out, F.when(F.col("_r") < cut(1), 0).when(F.col("_r") < cut(2), 1).when(F.col("_r") < cut(3), 2).otherwise(3)).drop("_r", "_size")


def carried_quotas(sizes: Column, quota: int, shares: Sequence[float] = QUARTILE_SHARES) -> Column:
    """Of each band's size: what it gives of a quota, its shortfall carried to the next."""
    wants = F.array(*(F.lit(int(round(quota * s))) for s in shares))
    start = F.struct(F.array().cast("array<int>").alias("got"), F.lit(0).alias("carry"))

    def step(acc, x):
        want = x["want"] + acc["carry"]
        take = F.least(want, x["size"])
        return F.struct(F.concat(acc["got"], F.array(take)).alias("got"), (want - take).alias("carry"))

    return F.aggregate(F.zip_with(sizes, wants, lambda s, w: F.struct(s.cast("int").alias("size"), w.alias("want"))), start, step, lambda acc: acc["got"])


def quota_sample(df: DataFrame, by: Sequence[str], key: str, length: str, quota: int, seed: int = 0, shares: Sequence[float] = QUARTILE_SHARES) -> DataFrame:
    """Up to ``quota`` rows of each stratum: by length quartile in fixed shares with carry, topped up from the rest."""
    banded = quartile_band(df, by, [F.col(length), F.col(key)]).withColumn("_h", slot_hash(F.col(key), seed=seed))
    sizes = banded.groupBy(*by).agg(*(F.count_if(F.col("band") == i).cast("int").alias(f"s{i}") for i in range(4)))
    got = sizes.select(*by, carried_quotas(F.array("s0", "s1", "s2", "s3"), quota, shares).alias("_q"))
    # A row behind ``quota`` others of its band is behind them in the whole stratum too, so tasks pass no more on.
    ranked = banded.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "band").orderBy("_h", key))).where(F.col("_n") <= quota).join(got, list(by))
    picked = ranked.withColumn("_extra", (F.col("_n") > F.element_at("_q", (F.col("band") + 1).cast("int"))).cast("int"))
    final = picked.withColumn("_m", F.row_number().over(Window.partitionBy(*by).orderBy("_extra", "_h", key)))
    return final.where(F.col("_m") <= quota).select(*df.columns, "band")


def draw_weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement in proportion to weight: (draw, key).

    The running sum is cut into as many equal steps as there are draws, a million at most. A key
    lies in the steps that its weight spans, so draws meet keys by an equi-join on the step.
    """
    from .weighted import running_weight

    steps = float(max(1, min(n, 1_000_000)))
    run = running_weight(df, key, weight).where("w > 0").select(key, (F.col("cum") - F.col("w")).alias("_low"), F.col("cum").alias("_high"), "total")
    step = lambda x: F.greatest(F.least(F.floor(x * F.lit(steps)), F.lit(int(steps) - 1)), F.lit(0)).cast("long")
    slack = F.lit(1e-12)  # against rounding at the ends of steps
    spans = run.withColumn("_step", F.explode(F.sequence(step(F.col("_low") / F.col("total") - slack), step(F.col("_high") / F.col("total") + slack))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), slot_hash(F.col("id"), seed=seed).alias("u")).withColumn("_step", step(F.col("u")))
    u = F.col("u") * F.col("total")
    return draws.join(spans, "_step").where((u >= F.col("_low")) & (u < F.col("_high"))).select("draw", key)


def bootstrap_multiplicities(clusters: DataFrame, strata: Sequence[str], cluster: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, strata, cluster, multiplicity): clusters drawn with replacement within each stratum.

    A stratum's n draws pick the cluster at rank ``floor(u * n)`` of it; u comes from a hash.
    """
    names = clusters.select(*strata, cluster).distinct()
    w = Window.partitionBy(*strata)
    ranked = names.withColumn("_r", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("_n", F.count("*").over(w))
    draws = ranked.select(*strata, "_n", F.col("_r").alias("_d")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = slot_hash(*(F.col(s) for s in strata), F.col("_d"), F.col("replicate"), seed=seed)
    hits = draws.withColumn("_r", F.floor(u * F.col("_n")).cast("int")).groupBy(*strata, "replicate", "_r").agg(F.count("*").alias("multiplicity"))
    return hits.join(ranked.select(*strata, cluster, "_r"), [*strata, "_r"]).select("replicate", *strata, cluster, "multiplicity")


def bootstrap_covariance(df: DataFrame, multiplicities: DataFrame, on: Sequence[str], component: str, value: str) -> DataFrame:
    """(i, j, covariance) of the logs of components' totals over replicates."""
    t = df.join(multiplicities, list(on)).groupBy("replicate", component).agg(F.log(F.sum(F.col(value) * F.col("multiplicity"))).alias("t"))
    a, b = t.select("replicate", F.col(component).alias("i"), F.col("t").alias("a")), t.select("replicate", F.col(component).alias("j"), F.col("t").alias("b"))
    return a.join(b, "replicate").groupBy("i", "j").agg(F.covar_samp("a", "b").alias("covariance"))


def strided(df: DataFrame, order: Sequence[str], stride: int, n: int) -> DataFrame:
    """Every ``stride``-th row in order, ``n`` at most: a report's subset, ranked in one task after the limit."""
    top = df.orderBy(*order).limit(stride * n)
    return top.withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_r") % stride == 0).drop("_r")


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose keys hash below ``fraction``."""
    return df.where(slot_hash(*(F.col(k) for k in keys), seed=seed) < F.lit(float(fraction)))
