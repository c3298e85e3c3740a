"""Monte-Carlo distributions of travel times: outer products of draws, and draws by distance band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bin_last_closed, safe_ratio, slot_hash
from .sampling import draw_weighted
from .weighted import running_weight


def batches(df: DataFrame, key: str, weight: str, n_batches: int, size: int, seed: int) -> DataFrame:
    """(batch, slot, key): ``size`` draws in proportion to weight for each of ``n_batches``."""
    d = draw_weighted(df, key, weight, n_batches * size, seed)
    return d.select(F.floor(F.col("draw") / size).alias("batch"), F.pmod("draw", F.lit(size)).alias("slot"), key)


def outer_pairs(origins: DataFrame, goals: DataFrame, src: str, dst: str) -> DataFrame:
    """(batch, src, dst): each origin of a batch with each of its goals; a batch is of a fixed size, so its pairs are too."""
    return origins.select("batch", src).join(goals.select("batch", dst), "batch")


def time_counts(pairs: DataFrame, seconds: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n) of the pairs with a time within the edges, the last bin closed."""
    return pairs.withColumn("bin", bin_last_closed(F.col(seconds), edges)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def outer_histogram(origins: DataFrame, goals: DataFrame, times: DataFrame, edges: Sequence[float], n_batches: int, size: int, seed: int = 0, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(bin, n): times of all pairs within batches of weighted draws; ``times`` (src, dst, seconds) stands for a routing service."""
    o, g = batches(origins, src, weight, n_batches, size, seed), batches(goals, dst, weight, n_batches, size, seed + 1)
    return time_counts(outer_pairs(o, g, src, dst).join(times.select(src, dst, "seconds"), [src, dst]), "seconds", edges)


def banded_histogram(pairs: DataFrame, distance: str, mass: Column, bands: Sequence[float], edges: Sequence[float], seconds: str = "seconds", draws: int = 1000, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """(bin, n): times reconstructed from equal numbers of draws in each distance band and beyond the last, each band's histogram
    scaled to the band's exact mass. Pairs are drawn in proportion to ``mass`` (origins' times goals') with replacement."""
    d = F.col(distance)
    band = F.coalesce(F.when(d >= float(bands[-1]), F.lit(len(bands) - 1)), *(F.when((d >= float(a)) & (d < float(b)), F.lit(i)) for i, (a, b) in enumerate(zip(bands, bands[1:]))))
    p = pairs.select(key, band.alias("band"), mass.cast("double").alias("_m"), seconds).where("band is not null and _m > 0")
    masses = p.groupBy("band").agg(F.sum("_m").alias("mass"))
    counted = None
    for b in range(len(bands)):
        own = p.where(F.col("band") == b)
        drawn = draw_weighted(own, key, "_m", draws, seed + b).join(own.select(key, seconds), key)
        one = time_counts(drawn, seconds, edges).withColumn("band", F.lit(b))
        counted = one if counted is None else counted.unionByName(one)
    kept = counted.groupBy("band").agg(F.sum("n").alias("kept"))
    j = counted.join(kept, "band").join(masses, "band")
    return j.groupBy("bin").agg(F.sum(F.col("mass") * F.col("n") / F.col("kept")).alias("n"))


def exact_banded_histogram(pairs: DataFrame, mass: Column, edges: Sequence[float], seconds: str = "seconds") -> DataFrame:
    """(bin, n): what ``banded_histogram`` estimates, from all pairs."""
    return pairs.withColumn("bin", bin_last_closed(F.col(seconds), edges)).where("bin is not null").groupBy("bin").agg(F.sum(mass).alias("n"))


def pair_pool(ids: DataFrame, key: str, n: int, seed: int = 0, tries: int = 4) -> DataFrame:
    """(low, high): ``n`` different unordered pairs of different ids, drawn from ``tries * n`` attempts in their order."""
    ranked = running_weight(ids.select(key).distinct().withColumn("_one", F.lit(1.0)), key, "_one").select(key, (F.col("cum") - 1).cast("long").alias("_r"), F.col("total").cast("long").alias("_n"))
    count = F.broadcast(ranked.agg(F.max("_n").alias("_n")))
    tried = ids.sparkSession.range(n * tries).crossJoin(count).select("id", F.floor(slot_hash(F.col("id"), seed=seed) * F.col("_n")).alias("a"), F.floor(slot_hash(F.col("id"), seed=seed + 1) * (F.col("_n") - 1)).alias("b"))
    pairs = tried.where("b >= 0").withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
    at = lambda c, out: ranked.select(F.col("_r").alias(c), F.col(key).alias(out))
    named = pairs.join(at("a", "_x"), "a").join(at("b", "_y"), "b")
    once = named.groupBy(F.least("_x", "_y").alias("low"), F.greatest("_x", "_y").alias("high")).agg(F.min("id").alias("id"))
    return once.orderBy("id").limit(n).select("low", "high")


def discard_share(pairs: DataFrame, ok: Column) -> DataFrame:
    """One row (pairs, kept, discard_rate)."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(ok).alias("kept")).select("pairs", "kept", safe_ratio((F.col("pairs") - F.col("kept")).cast("double"), F.col("pairs").cast("double")).alias("discard_rate"))
