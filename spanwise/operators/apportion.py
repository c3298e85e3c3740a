"""Totals to parts and back: apportionment, control totals, hierarchies, imputation, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio
from .weighted import median


def _with_sums(df: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """Group sums beside each row, by an aggregate and a join: a window would gather a group in one task."""
    agg = df.groupBy(*by).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    names = {c: f"_g_{c}" for c in by}
    agg = agg.withColumnsRenamed(names)
    cond = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(names[c]))
        cond = one if cond is None else cond & one
    return df.join(agg, cond).drop(*names.values())


def apportion(df: DataFrame, by: Sequence[str], total: str, weight: str, out: str = "part") -> DataFrame:
    """A parent's total to its children by weight, or equally where the weights sum to 0."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    j = _with_sums(df, by, _w=w, _n=F.lit(1))
    return j.withColumn(out, F.when(F.col("_w") != 0, F.col(total) * w / F.col("_w")).otherwise(F.col(total) / F.col("_n"))).drop("_w", "_n")


def split_to_ends(df: DataFrame, u: str, v: str, t: Column, value: Column, out: str = "value") -> DataFrame:
    """(node, value): each value to two ends, ``1 - t`` and ``t`` of it, summed by node."""
    ends = F.array(F.struct(F.col(u).alias("node"), ((F.lit(1.0) - t) * value).alias("x")), F.struct(F.col(v).alias("node"), (t * value).alias("x")))
    return df.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.x").alias(out))


def scale_to_total(df: DataFrame, by: Sequence[str], value: str, control: DataFrame, control_value: str, out: str = "scaled") -> DataFrame:
    """Values scaled so that each group sums to its control total; groups without one keep theirs."""
    j = _with_sums(df, by, _s=F.col(value)).join(control.select(*by, F.col(control_value).alias("_c")), list(by), "left")
    return j.withColumn(out, F.when(F.col("_c").isNotNull(), safe_ratio(F.col(value) * F.col("_c"), F.col("_s"))).otherwise(F.col(value))).drop("_s", "_c")


def fold_class(df: DataFrame, by: Sequence[str], cls: str, value: str, mixed: str, into: Sequence[str]) -> DataFrame:
    """(by, class, value) without the mixed class, whose value goes to the classes ``into`` in proportion."""
    sums = df.groupBy(*by, cls).agg(F.sum(value).alias("v"))
    wide = sums.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(cls) == mixed, F.col("v"))), F.lit(0.0)).alias("_m"), F.sum(F.when(F.col(cls).isin(*into), F.col("v"))).alias("_i"))
    j = sums.where(F.col(cls) != mixed).join(wide, list(by))
    return j.select(*by, cls, F.when(F.col(cls).isin(*into), F.col("v") + safe_ratio(F.col("v") * F.col("_m"), F.col("_i"))).otherwise(F.col("v")).alias(value))


def impute_by_ratio(df: DataFrame, raw: str, base: str, out: str = "filled", digits: int = 1) -> DataFrame:
    """Raw values; where they are 0, below or null, the base times the median ratio of rows that have both."""
    mid = df.where((F.col(raw) > 0) & (F.col(base) > 0)).agg(median(F.col(raw) / F.col(base)).alias("_r"))
    return df.crossJoin(F.broadcast(mid)).withColumn(out, F.when(F.col(raw) > 0, F.col(raw)).otherwise(F.round(F.col(base) * F.col("_r"), digits))).drop("_r")


def rollup_hierarchy(leaves: DataFrame, parents: DataFrame, grandparents: DataFrame, parent: str, grandparent: str, value: str, weight: str) -> DataFrame:
    """(grandparent, n, total, weighted_mean) of leaves; the mean is 1 where the weights sum to 0."""
    j = leaves.join(parents, parent).join(grandparents, grandparent)
    w = F.col(weight)
    return j.groupBy(grandparent).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.when(F.sum(w) > 0, F.sum(F.col(value) * w) / F.sum(w)).otherwise(F.lit(1.0)).alias("weighted_mean"))


def weighted_centroid(df: DataFrame, by: Sequence[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted mean place, the plain one where the weights sum to 0."""
    mean = lambda c: F.when(F.sum(w) > 0, F.sum(c * w) / F.sum(w)).otherwise(F.avg(c))
    return df.groupBy(*by).agg(mean(x).alias("x"), mean(y).alias("y"))


def mean_one(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str = "normalised") -> DataFrame:
    """Values scaled so that their weighted mean is 1; a missing one counts as 1 before that."""
    v = F.coalesce(F.col(value), F.lit(1.0))
    j = _with_sums(df, by, _w=F.col(weight), _vw=v * F.col(weight))
    return j.withColumn(out, v * safe_ratio(F.col("_w"), F.col("_vw"), 1.0)).drop("_w", "_vw")


def share_index(df: DataFrame, by: Sequence[str], band: str, value: str, factors: dict) -> DataFrame:
    """(by, index): the sum over bands of the band's share and its factor."""
    f = F.create_map(*(F.lit(x) for k, v in factors.items() for x in (k, float(v))))
    return df.groupBy(*by).agg(safe_ratio(F.sum(F.col(value) * F.try_element_at(f, F.col(band))), F.sum(value)).alias("index"))


def generation_scales(layers: DataFrame, population: DataFrame, layer: str, value: str, people: str, rates: dict[str, float]) -> DataFrame:
    """(layer, k, scale): layer total for a head, and half the rate over it; a k of 0 or below raises when read."""
    heads = population.agg(F.sum(people).cast("double").alias("_p"))
    rate = F.create_map(*(F.lit(x) for k, v in rates.items() for x in (k, float(v))))
    k = layers.groupBy(layer).agg(F.sum(value).cast("double").alias("_l")).crossJoin(F.broadcast(heads)).select(layer, (F.col("_l") / F.col("_p")).alias("k"))
    bad = F.raise_error(F.concat(F.lit("layer without mass: "), F.col(layer))).cast("double")
    return k.withColumn("scale", F.when(F.col("k") > 0, F.try_element_at(rate, F.col(layer)) / F.lit(2.0) / F.col("k")).otherwise(bad))
