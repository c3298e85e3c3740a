"""Weighted aggregation of surveys: weights, counts, cross-tabs, distributions, quantiles, smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_left_closed, safe_ratio
from ..sources.sinks import cut_lineage


def effective_weight(df: DataFrame, weight: str | None = None, multiplier: str | Column | float | None = None) -> Column:
    """Weight times multiplier, either optional; both absent count rows. A missing column raises ValueError."""
    for name in (weight, multiplier):
        if isinstance(name, str) and name not in df.columns:
            raise ValueError(f"no column {name}")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if multiplier is None:
        return w
    m = F.col(multiplier) if isinstance(multiplier, str) else multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return w * m.cast("double")


def weight_label(weight: str | None, multiplier: str | Column | float | None) -> str:
    """Name of a weighted column: ``w``, ``w*m``, or ``w*mult`` for a multiplier that is no column's name."""
    if not weight and multiplier is None:
        return "n"
    m = None if multiplier is None else multiplier if isinstance(multiplier, str) else "mult"
    return "*".join(x for x in (weight, m) if x)


def weighted_counts(df: DataFrame, by: Sequence[str], weight: str | None = None, multiplier: str | Column | float | None = None, special: dict[str, Sequence] | None = None, out: str = "weighted") -> DataFrame:
    """Rows and summed weight of each key, null keys included, most weight first.

    ``special`` names codes without substance; then a flag tells keys that hold one.
    """
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(effective_weight(df, weight, multiplier)).alias(out))
    if special:
        flag = F.lit(False)
        for c, codes in special.items():
            flag = flag | F.coalesce(F.col(c).isin(*codes), F.lit(False))
        got = got.withColumn("special", flag)
    return got.orderBy(F.desc(out), *by)


def weighted_crosstab(df: DataFrame, index: str, columns: str, values: Sequence, weight: str | None = None, multiplier: str | Column | float | None = None) -> DataFrame:
    """Summed weight of each index and column value, 0 where there is none; ``values`` fixes the columns."""
    return df.withColumn("_w", effective_weight(df, weight, multiplier)).groupBy(index).pivot(columns, list(values)).agg(F.sum("_w")).fillna(0.0)


def rate(df: DataFrame, by: Sequence[str], numerator: Column, population: DataFrame, size: Column, days: float = 7.0) -> DataFrame:
    """Summed numerator of each key, for a head of the population and a day."""
    total = population.agg(F.sum(size).cast("double").alias("_heads"))
    return df.groupBy(*by).agg(F.sum(numerator).alias("total")).crossJoin(F.broadcast(total)).withColumn("rate", safe_ratio(F.col("total"), F.col("_heads") * F.lit(days))).drop("_heads")


def binned_distribution(df: DataFrame, x: Column, weight: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, mass, eff_n, share, density) of every left-closed bin, empty ones included."""
    spark = df.sparkSession
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("id").cast("int") + 1).alias("low"), F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("id").cast("int") + 2).alias("high"))
    sums = df.select(bin_left_closed(x, edges).alias("b"), weight.cast("double").alias("w")).where("b is not null").groupBy("b").agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("w")).alias("q"))
    out = F.broadcast(bins).join(sums, F.col("bin") == F.col("b"), "left").select("bin", "low", "high", F.coalesce("m", F.lit(0.0)).alias("mass"), F.coalesce(safe_ratio(F.col("m") * F.col("m"), F.col("q")), F.lit(0.0)).alias("eff_n"))
    # As many rows as there are bins.
    whole = out.agg(F.sum("mass").alias("_all"))
    out = out.crossJoin(F.broadcast(whole)).withColumn("share", safe_ratio(F.col("mass"), F.col("_all"))).drop("_all")
    return out.withColumn("density", F.col("share") / (F.col("high") - F.col("low")))


def splice_tail(main: DataFrame, shape: DataFrame, cut: int) -> DataFrame:
    """(bin, mass): ``main`` below bin ``cut``; from it on the other distribution, scaled to main's mass there."""
    both = main.select("bin", F.col("mass").alias("a")).join(shape.select("bin", F.col("mass").alias("b")), "bin")
    tail = both.where(F.col("bin") >= cut).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return both.crossJoin(F.broadcast(tail)).select("bin", F.when(F.col("bin") < cut, F.col("a")).otherwise(F.col("b") * safe_ratio(F.col("ta"), F.col("tb"))).alias("mass"))


def weighted_mean(x: Column, w: Column, neutral: float | None = None) -> Column:
    """Aggregate: the weighted mean, or ``neutral`` if the weights sum to no more than 0."""
    return F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w)).otherwise(F.lit(neutral).cast("double"))


def weighted_spread(df: DataFrame, x: Column, w: Column, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, population standard deviation and coefficient of variation."""
    s = df.select(*by, x.cast("double").alias("x"), w.cast("double").alias("w"))
    sums = s.groupBy(*by).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"))
    mean = safe_ratio(F.col("sx"), F.col("sw"), None)
    out = sums.select(*by, mean.alias("mean"), F.sqrt(F.greatest(safe_ratio(F.col("sxx"), F.col("sw"), None) - mean * mean, F.lit(0.0))).alias("sd"))
    return out.withColumn("cv", safe_ratio(F.col("sd"), F.col("mean"), None))


def inverse_variance_mean(df: DataFrame, by: Sequence[str], x: Column, sigma: Column) -> DataFrame:
    """Mean weighted by 1/sigma squared, its sigma, and the number of observations."""
    q = F.lit(1.0) / (sigma * sigma)
    s = df.where(sigma > 0).groupBy(*by).agg(F.sum(q * x).alias("_qx"), F.sum(q).alias("_q"), F.count("*").alias("n"))
    return s.select(*by, (F.col("_qx") / F.col("_q")).alias("mean"), (F.lit(1.0) / F.sqrt("_q")).alias("sigma"), "n")


def running_weight(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` folded to distinct values of ``x`` in each group with ``cum``, the weight up to and with it, and ``total``.

    A running sum would put all values of a group into one task. So they are dealt out by range:
    a group is cut into ranges at quantiles, each range is summed, and the sums before it are
    added. The quantiles are approximate, as only the ranges' sizes depend on them.
    """
    by = list(by)
    folded = df.groupBy(*by, x).agg(F.sum(w).alias("w"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(x).cast("double")
    # A fixed number of cuts for each group, whatever the input.
    cuts = folded.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.percentile_approx(value, F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0)), F.lit(1000)).alias("cuts"))

    ranged = _ranged(folded, cut_lineage(cuts), value, by)
    sums = ranged.groupBy(*by, "_p").agg(F.sum("w").alias("_s"))
    own = ranged.withColumn("cum", F.sum("w").over(Window.partitionBy(*by, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    before = _sums_before(sums, by).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, "_p"])), "_before", "_total")
    out = _with_group(own, cut_lineage(before), [*by, "_p"])
    return out.withColumn("cum", F.col("cum") + F.col("_before")).withColumn("total", F.col("_total")).drop("_p", "_before", "_total")


def _ranged(df: DataFrame, cuts: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_p``, how many of its group's cuts lie below the value. A row looks at a few of them, by halving."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _with_group(df, cuts, by).withColumn("_p", F.lit(0))
    for step in (1 << i for i in range(n.bit_length(), -1, -1)):
        out = out.withColumn("_p", F.when(F.get("cuts", F.col("_p") + (step - 1)) < value, F.col("_p") + step).otherwise(F.col("_p")))
    return out.drop("cuts")


def _sums_before(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of ranges (by, _p, _s) with ``_before``, the sum of the group's lower ranges, and ``_total``; a row for each range."""
    w = Window.partitionBy(*by)
    lower = F.sum("_s").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("_before", F.coalesce(lower, F.lit(0.0))).withColumn("_total", F.coalesce(F.sum("_s").over(w), F.lit(0.0)))


def _with_group(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with its group's columns of a table of groups whose keys are _g0, _g1 and so on."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(groups, same).drop(*(f"_g{i}" for i in range(len(by))))


def ranked_values(df: DataFrame, x: str, by: Sequence[str], places: dict[str, Column]) -> DataFrame:
    """(by, names): the values at places of each group's sorted ones, counted from 0; a place is a Column of the group's size ``n``.

    Values are counted first and the counts summed by range, so no group is gathered; nulls are left out.
    """
    run = running_weight(df.where(F.col(x).isNotNull()).withColumn("_one", F.lit(1.0)), x, "_one", by)
    n = F.col("total").cast("long")
    at = lambda place: F.min(F.when(F.col("cum") > place.cast("long"), F.col(x)))
    return run.withColumn("n", n).groupBy(*by).agg(*(at(p).alias(k) for k, p in places.items()))


def weighted_quantile(df: DataFrame, x: str, w: str, p: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """The first value at which the running weight reaches ``p`` of the whole; rows without a value come last.

    Weights are summed by range of values first, where the rows lie. Only the ranges in which the running weight may
    first reach ``p`` are looked at again, most often one, so no group is sorted and few rows are moved.
    """
    by, n = list(by), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src, value = df.select(*by, F.col(x).alias("_x"), F.col(w).cast("double").alias("_w")), F.col("_x").cast("double")
    names = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    cuts = src.groupBy(*names).agg(F.percentile_approx(value, F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0)), F.lit(1000)).alias("cuts"))
    ranged = _ranged(src, cut_lineage(cuts), value, by).withColumn("_p", F.when(F.col("_x").isNull(), n).otherwise(F.col("_p")))
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_w").alias("_s"), F.sum(F.greatest("_w", F.lit(0.0))).alias("_up"), F.sum(F.abs("_w")).alias("_abs"))
    placed = _sums_before(sums.withColumn("_s", F.coalesce("_s", F.lit(0.0))), by)
    group, target = Window.partitionBy(*by), F.lit(float(p)) * F.col("_total")
    slack = F.lit(1e-9) * F.sum("_abs").over(group)  # sums in another order may differ so much
    sure = F.min(F.when(F.col("_before") + F.col("_s") >= target + slack, F.col("_p"))).over(group)
    may = placed.withColumn("_sure", sure).withColumn("_may", (F.col("_before") + F.col("_up") >= target - slack) & (F.col("_p") <= F.coalesce("_sure", F.lit(n))))
    held = may.where("_may").select(*names, F.col("_p").alias(f"_g{len(by)}"), "_before", target.alias("_target"))
    rows = _with_group(ranged, cut_lineage(held), [*by, "_p"]).groupBy(*by, "_p", "_before", "_target", "_x").agg(F.sum("_w").alias("_w"))
    order = Window.partitionBy(*by, "_p").orderBy(F.asc_nulls_last("_x")).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_cum", F.col("_before") + F.coalesce(F.sum("_w").over(order), F.lit(0.0)))
    return run.where(F.col("_cum") >= F.col("_target")).groupBy(*by).agg(F.min("_x").alias("quantile"))


def median(x: Column) -> Column:
    """Aggregate: the mean of the middle two."""
    return F.percentile(x, F.lit(0.5))


def medians(df: DataFrame, x: str, by: Sequence[str], out: str = "median") -> DataFrame:
    """(by, median): the mean of the middle two of each group, without gathering it."""
    n = F.col("n")
    two = ranked_values(df, x, by, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)})
    return two.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out))


#: Ranges of values that medians of several levels are looked for in.
RANGES = 64


def _range_of(x: Column, cuts: list[float]) -> Column:
    """How many of the rising cuts lie below ``x``, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), _range_of(x, cuts[:mid])).otherwise(F.lit(mid + 1) + _range_of(x, cuts[mid + 1 :]))


def level_medians(df: DataFrame, x: str, levels: Sequence[Sequence[str]], out: str = "median") -> DataFrame:
    """(columns of all levels, level, median): the mean of the middle two by each level's columns, others null; ``level`` is its place.

    One pass counts rows by group and range of values, cut at approximate quantiles of all rows; coarser
    levels add up these counts. Only the ranges that hold a middle are looked at again, so a group
    passes on some two parts in RANGES of its rows, counted by value. Nulls are left out.
    """
    keys = list(dict.fromkeys(c for level in levels for c in level))
    src = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null")
    found = src.agg(F.percentile_approx("_x", [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    ranged = src.withColumn("_p", _range_of(F.col("_x"), sorted(set(found))))
    counts = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    parts = []
    for i, level in enumerate(levels):
        own = counts.groupBy(*level, "_p").agg(F.sum("_c").alias("_c"))
        w = Window.partitionBy(*level)  # RANGES rows of a group at most
        placed = own.withColumn("_n", F.sum("_c").over(w)).withColumn("_end", F.sum("_c").over(w.orderBy("_p"))).withColumn("_low", F.floor((F.col("_n") - 1) / 2)).withColumn("_high", F.floor(F.col("_n") / 2))
        start = F.col("_end") - F.col("_c")
        held = placed.where(((F.col("_low") >= start) & (F.col("_low") < F.col("_end"))) | ((F.col("_high") >= start) & (F.col("_high") < F.col("_end"))))
        names = {c: f"_k{j}" for j, c in enumerate(level)}
        need = held.select(*(F.col(c).alias(k) for c, k in names.items()), F.col("_p").alias("_q"), start.alias("_before"), "_low", "_high")
        on = F.col("_p") == F.col("_q")
        for c, k in names.items():
            on = on & F.col(c).eqNullSafe(F.col(k))
        rows = ranged.join(need, on).groupBy(*level, "_p", "_before", "_low", "_high", "_x").agg(F.count("*").alias("_c"))
        run = rows.withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*level, "_p").orderBy("_x")))
        at = lambda k: F.min(F.when((F.col(k) < F.col("_end")) & (F.col(k) >= F.col("_end") - F.col("_c")), F.col("_x")))
        two = run.groupBy(*level).agg(at("_low").alias("_a"), at("_high").alias("_b"))
        parts.append(two.select(*(F.col(c) if c in level else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keys), F.lit(i).alias("level"), ((F.col("_a") + F.col("_b")) / 2).alias(out)))
    return reduce(DataFrame.unionByName, parts)


def mad_sigma(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """1.4826 times the median absolute deviation from each group's median."""
    off = df.join(medians(df, x, by, "_m"), list(by)).withColumn("_off", F.abs(F.col(x) - F.col("_m")))
    return medians(off, "_off", by, "_mad").select(*by, (F.lit(1.4826) * F.col("_mad")).alias("sigma"))


def normalise(df: DataFrame, value: str, by: Sequence[str] = (), total: float = 1.0, out: str = "share") -> DataFrame:
    """Each value's part of its group's sum, times ``total``; 0 where the sum is 0."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    joined = df.join(sums, list(by)) if by else df.crossJoin(F.broadcast(sums))
    return joined.withColumn(out, safe_ratio(F.col(value) * F.lit(float(total)), F.col("_sum"))).drop("_sum")


def smooth_block(df: DataFrame, value: str, order: str, by: Sequence[str], low: int, high: int, out: str = "smooth") -> DataFrame:
    """A three-point mean of rows with ``low <= order <= high``, cut at the ends, that keeps the block's total."""
    block = F.col(order).between(low, high)
    near = Window.partitionBy(*by, block).orderBy(order).rowsBetween(-1, 1)
    whole = Window.partitionBy(*by, block)
    df = df.withColumn("_avg", F.avg(value).over(near))
    kept = safe_ratio(F.col("_avg") * F.sum(value).over(whole), F.sum("_avg").over(whole))
    return df.withColumn(out, F.when(block, kept).otherwise(F.col(value))).drop("_avg")


def adaptive_rate(df: DataFrame, by: Sequence[str], tier: str, n: str, w: str, width: str, enough: float = 100) -> DataFrame:
    """Weight by year over the fewest tiers, taken in order, whose rows number ``enough``; else over all.

    ``width`` is the number of years in a tier, counted whether or not they have rows.
    """
    upto = Window.partitionBy(*by).orderBy(tier).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.select(*by, tier, F.sum(n).over(upto).alias("cum_n"), F.sum(w).over(upto).alias("cum_w"), F.sum(width).over(upto).alias("years"))
    done = F.col("cum_n") >= enough
    pick = F.struct((~done).cast("int"), F.when(done, F.col(tier)).otherwise(-F.col(tier)))
    best = cum.groupBy(*by).agg(F.min_by(F.struct("cum_n", "cum_w", "years"), pick).alias("b"))
    return best.select(*by, F.col("b.cum_n").alias("n"), F.col("b.years").alias("years"), safe_ratio(F.col("b.cum_w"), F.col("b.years").cast("double")).alias("rate"))


def pooled_spread(df: DataFrame, by: Sequence[str], mean: str, sd: str) -> DataFrame:
    """Mean over days, and the spread by the law of total variance."""
    return df.groupBy(*by).agg(F.avg(mean).alias("mean"), F.sqrt(F.var_pop(mean) + F.avg(F.col(sd) * F.col(sd))).alias("sd"))


def floored_sigma(sd: Column, mean: Column, relative: float) -> Column:
    """A spread that is no less than a part of the mean, nor than its square root."""
    return F.greatest(F.coalesce(sd, F.lit(0.0)), F.lit(float(relative)) * mean, F.sqrt(F.greatest(mean, F.lit(0.0))))


def week_weight(df: DataFrame, by: Sequence[str], day: str, value: Column) -> DataFrame:
    """(5 x weekday + Saturday + Sunday) / 7 of summed values by day type."""
    factor = F.when(F.col(day) == 0, F.lit(5.0)).otherwise(F.lit(1.0))
    return df.groupBy(*by).agg((F.sum(factor * value) / F.lit(7.0)).alias("weight"))


def harmonic_speed(length: Column, speed: Column) -> Column:
    """Aggregate: length over the summed times."""
    return safe_ratio(F.sum(length), F.sum(safe_ratio(length, speed, None)), None)


def signed_rms(z: Column) -> Column:
    """Aggregate: root mean square with the sign of the mean."""
    return F.sqrt(F.avg(z * z)) * F.signum(F.avg(z))


def normal_equations(df: DataFrame, xs: Sequence[str], ys: Sequence[str], w: Column | None = None) -> DataFrame:
    """(i, j, value): entries of X'WX, and of X'Wy with ``j`` from the number of regressors on; one aggregate."""
    w = F.lit(1.0) if w is None else w
    names = [*xs, *ys]
    cells = [(i, j) for i in range(len(xs)) for j in range(i, len(names))]
    sums = df.agg(*(F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"c{k}") for k, (i, j) in enumerate(cells)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{k}").alias("value")) for k, (i, j) in enumerate(cells)))).alias("x")).select("x.*")


def trapezoid_normalise(df: DataFrame, x: str, y: str, by: Sequence[str], out: str = "density") -> DataFrame:
    """A curve scaled to unit area by the trapezoid rule, with ``cdf``, the area up to each point."""
    w = Window.partitionBy(*by).orderBy(x)
    step = F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / F.lit(2.0), F.lit(0.0))
    areas = df.withColumn("_s", step).withColumn("cdf", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = areas.groupBy(*by).agg(F.sum("_s").alias("_a"))
    return areas.join(whole, list(by)).withColumn(out, safe_ratio(F.col(y), F.col("_a"))).withColumn("cdf", safe_ratio(F.col("cdf"), F.col("_a"))).drop("_s", "_a")


def curve_quantile(df: DataFrame, x: str, by: Sequence[str], p: float) -> DataFrame:
    """The place at which ``cdf`` reaches ``p``, by linear interpolation."""
    w = Window.partitionBy(*by).orderBy(x)
    seg = df.withColumn("_x", F.lag(x).over(w)).withColumn("_c", F.lag("cdf").over(w)).where((F.col("cdf") >= p) & (F.col("_c") < p))
    return seg.groupBy(*by).agg(F.min(F.col("_x") + (F.col(x) - F.col("_x")) * (F.lit(float(p)) - F.col("_c")) / (F.col("cdf") - F.col("_c"))).alias("quantile"))


def weighted_histogram(df: DataFrame, by: Sequence[str], value: Column, weight: Column, edges: Sequence[float]) -> DataFrame:
    """(by, bin, mass, share) of values in bins whose last one is closed; groups without mass have no rows."""
    from ..functions.scalar import bin_last_closed

    h = df.select(*by, bin_last_closed(value, edges).alias("bin"), weight.cast("double").alias("w")).where("bin is not null").groupBy(*by, "bin").agg(F.sum("w").alias("mass"))
    return normalise(h, "mass", by)
