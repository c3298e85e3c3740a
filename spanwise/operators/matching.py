"""Names: patterns in order, blocked fuzzy joins, clusters of places."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bare_name, jaccard, name_tokens, normal_name


@F.pandas_udf(T.DoubleType())
def ratcliff_obershelp(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; no built-in function computes it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


#: Words of names that carry no identity; of those, words of a school's type; and words that name an establishment of its own.
GENERIC_WORDS = ("the", "of", "a", "and", "national", "co")
TYPE_WORDS = tuple("school schools primary post secondary college high grammar academy integrated controlled maintained community national ns ps gaelscoil bunscoil naiscoil scoil colaiste coliste pobalscoil nursery unit naomh special".split())
ROLE_WORDS = tuple("prep preparatory infant infants junior senior assessment resource centre annexe model".split())
#: Least similarity of a match, and of two names' own words.
LEAST_SIMILARITY = 0.70
LEAST_CORE = 0.90


def similarity(a: Column, b: Column, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    """The greater of the words' Jaccard index and the matching-block ratio of the whole normal names."""
    return F.greatest(jaccard(name_tokens(a, generic), name_tokens(b, generic)), ratcliff_obershelp(normal_name(a, generic), normal_name(b, generic)))


def core_signature(name: Column, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    """A name's own words, without types, roles and a long word's final s, sorted and run together; empty if it has none."""
    own = F.filter(name_tokens(name, generic), lambda w: ~w.isin(*TYPE_WORDS, *ROLE_WORDS))
    stems = F.transform(own, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(F.array_sort(stems), "")


def same_establishment(a: Column, b: Column, generic: Sequence[str] = GENERIC_WORDS, least: float | None = LEAST_CORE) -> Column:
    """Whether two names are one establishment's: equal sets of role words, and own words that are
    equal, or alike by a matching-block ratio of ``least`` (None: equal only). Names without own words match none."""
    x, y = core_signature(a, generic), core_signature(b, generic)
    roles = [F.array_sort(F.filter(name_tokens(n, generic), lambda w: w.isin(*ROLE_WORDS))) for n in (a, b)]
    alike = x == y if least is None else (x == y) | (ratcliff_obershelp(x, y) >= F.lit(least))
    return (x != "") & (y != "") & (roles[0] == roles[1]) & alike


def match_establishments(left: DataFrame, right: DataFrame, block: str, name: str, right_name: str, least: float = LEAST_SIMILARITY, least_core: float | None = LEAST_CORE, score=similarity) -> DataFrame:
    """``left`` with its block's name that is equal, or else most similar and one establishment's; null if none reaches ``least``."""
    return fuzzy_join(left, right, block, name, right_name, least, lambda a, b: same_establishment(a, b, least=least_core), score)


def fuzzy_join(left: DataFrame, right: DataFrame, block: str, name: str, right_name: str, least: float = LEAST_SIMILARITY, gate=None, score=None, others: bool = False) -> DataFrame:
    """``left`` with the best-scoring name of its block, exact names first, or null below ``least``.

    Only distinct names of one block are compared; ``gate`` is a condition on two names that
    inexact pairs must meet. Names of one word or more in common score first, by an index of
    words, where the score is the words' own (no ``score`` given); a pair without one scores 0.
    ``others`` leaves out a name's own.
    """
    l, r = left.select(block, name).distinct(), right.select(F.col(block).alias("_block"), F.col(right_name).alias("_name")).distinct()
    if score is None:
        pairs = _pairs_by_word(l, r, block, name, least)
        score = lambda a, b: jaccard(name_tokens(a), name_tokens(b))
    else:
        pairs = l.join(r, F.col(block) == F.col("_block"))
    if others:
        pairs = pairs.where(F.col(name) != F.col("_name"))
    exact = bare_name(F.col(name)) == bare_name(F.col("_name"))
    scored = pairs.withColumn("_e", exact).withColumn("_s", F.when(F.col("_e"), F.lit(1.0)).otherwise(score(F.col(name), F.col("_name")))).where(F.col("_s") >= least)
    if gate is not None:
        scored = scored.where(F.col("_e") | gate(F.col(name), F.col("_name")))
    best = scored.groupBy(block, name).agg(F.max_by(F.struct("_name", "_s"), F.struct(F.col("_e").cast("int"), "_s", "_name")).alias("_b")).select(block, name, F.col("_b._name").alias("matched"), F.col("_b._s").alias("score"))
    return left.join(best, [block, name], "left")


def _pairs_by_word(left: DataFrame, right: DataFrame, block: str, name: str, least: float) -> DataFrame:
    """Pairs of a block that can reach a Jaccard index of ``least``, or are equal but for blanks and signs.

    Words are put in order of their rarity. Of n words that reach it, the first n - ceil(least * n) + 1
    of both sides share one (prefix filter), so common words bring no pairs together.
    """
    words = left.select(F.col(block).alias("_k"), F.explode(name_tokens(F.col(name))).alias("_w")).unionByName(right.select(F.col("_block").alias("_k"), F.explode(name_tokens(F.col("_name"))).alias("_w")))
    rarity = words.groupBy("_k", "_w").agg(F.count("*").alias("_f"))

    def prefixes(side: DataFrame, at: str, of: str, out: str) -> DataFrame:
        own = side.select(F.col(at).alias("_k"), F.col(of).alias(out), F.explode(name_tokens(F.col(of))).alias("_w")).join(rarity, ["_k", "_w"])
        listed = own.groupBy("_k", out).agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_all"))
        n = F.size("_all")
        # One more than needed guards against a rounded product.
        keep = F.least(n, n - F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int") + 1)
        by_word = listed.select("_k", out, F.explode(F.slice("_all", F.lit(1), keep)).alias("_x")).select("_k", out, F.col("_x._w").alias("_w"))
        return by_word.unionByName(side.select(F.col(at).alias("_k"), F.col(of).alias(out), F.concat(F.lit("="), bare_name(F.col(of))).alias("_w")))

    a, b = prefixes(left, block, name, "_a"), prefixes(right, "_block", "_name", "_b")
    return a.join(b, ["_k", "_w"]).select("_k", "_a", "_b").distinct().select(F.col("_k").alias(block), F.col("_a").alias(name), F.col("_k").alias("_block"), F.col("_b").alias("_name"))


def clusters(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", cut=None) -> DataFrame:
    """(key, cluster): connected groups of points within ``radius``; the cluster is its smallest key.

    All points of a grid cell lie within the radius of each other, so a cell is one node, named by its least key. Points
    of neighbouring cells are compared, and one link is kept for each pair of cells, however full they are.
    """
    from .graph import connected_components

    side = radius / 1.5  # the diagonal stays below the radius; a link reaches two cells far
    at = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    p = points.where(real(x) & real(y)).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).withColumn("cx", at("x")).withColumn("cy", at("y"))
    half = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)))
    q = p.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.explode(half).alias("s")).withColumn("cx", F.col("qx") - F.col("s.i")).withColumn("cy", F.col("qy") - F.col("s.j"))
    near = p.join(q, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= radius).select("cx", "cy", "qx", "qy").distinct()
    cells = p.groupBy("cx", "cy").agg(F.min("k").alias("cell"))
    links = near.join(cells, ["cx", "cy"]).join(cells.select(F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("cell").alias("other")), ["qx", "qy"])
    comp = connected_components(links, "cell", "other", cut=cut)
    named = p.join(cells, ["cx", "cy"]).join(comp.withColumnRenamed("node", "cell"), "cell", "left").select(F.col("k").alias(key), F.coalesce("root", "cell").alias("cluster")).distinct()
    return points.select(key).join(named, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def one_of_each_name(df: DataFrame, cluster: str, name: str, order: str) -> DataFrame:
    """Of each cluster a row for each distinct name; unnamed rows go where any is named, else one stays."""
    key = F.coalesce(bare_name(F.col(name)), F.lit(""))
    rest = [c for c in df.columns if c != cluster]
    one = df.withColumn("_n", key).groupBy(cluster, "_n").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    named = one.where("_n != ''").select(cluster).distinct().withColumn("_named", F.lit(True))
    kept = one.join(named, cluster, "left").where((F.col("_n") != "") | F.col("_named").isNull())
    return kept.select(cluster, "_r.*").select(*df.columns)


def share_total(df: DataFrame, group: str, total: str, out: str = "value") -> DataFrame:
    """A group's total, spread evenly over its rows."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    return df.join(n, group).withColumn(out, F.col(total) / F.col("_n")).drop("_n")


def decode_polyline(text: Column) -> Column:
    """An encoded polyline as an array of (lat, lon)."""
    return _decode_polyline(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])))
def _decode_polyline(texts: pd.Series) -> pd.Series:
    def values(s: str) -> Iterator[int]:
        n = shift = 0
        for ch in s:
            v = ord(ch) - 63
            n |= (v & 31) << shift
            shift += 5
            if v < 32:
                yield ~(n >> 1) if n & 1 else n >> 1
                n = shift = 0

    def points(s):
        out, lat, lon = [], 0, 0
        it = values(s or "")
        for dlat, dlon in zip(it, it):
            lat, lon = lat + dlat, lon + dlon
            out.append({"lat": lat / 1e5, "lon": lon / 1e5})
        return out

    return texts.map(points)
