"""Code books, sentinels and checks of coded columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MISSING, clean


def drop_special(df: DataFrame, codes: dict[str, Sequence], weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without any of the codes, and (column, rows, weight) that each column's codes took out of the whole."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    masks = {c: F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in codes.items()}
    keep = F.lit(True)
    for m in masks.values():
        keep = keep & ~m
    sums = df.agg(*(a for c, m in masks.items() for a in (F.count_if(m).alias(f"n_{c}"), F.coalesce(F.sum(F.when(m, w)), F.lit(0.0)).alias(f"w_{c}"))))
    report = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("rows"), F.col(f"w_{c}").alias("weight")) for c in codes))).alias("r")).select("r.*")
    return df.where(keep), report


def clean_missing(df: DataFrame, columns: Sequence[str] | None = None, sentinels: Sequence[str] = MISSING) -> DataFrame:
    """Sentinel strings become null, in string columns only."""
    strings = {c for c, t in df.dtypes if t == "string"}
    chosen = strings if columns is None else strings & set(columns)
    return df.select(*(clean(F.col(c), sentinels).alias(c) if c in chosen else F.col(c) for c in df.columns))


def require_present(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows where none of the columns is null, and a one-row count of the others."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep), df.agg(F.count_if(~keep).alias("dropped"))


def decode(df: DataFrame, book: DataFrame, columns: Sequence[str], suffix: str = "_label", variable: str = "variable", code: str = "code", label: str = "label") -> DataFrame:
    """``df`` with a label beside each coded column; one without a code book keeps null labels.

    The code book has a row for each code of each variable and is left to the planner to broadcast by its size.
    """
    for c in columns:
        one = book.where(F.col(variable) == c).select(F.col(code).alias("_code"), F.col(label).alias(f"{c}{suffix}")).dropDuplicates(["_code"])
        df = df.join(one, F.col(c) == F.col("_code"), "left").drop("_code")
    return df


def map_codes(c: Column, mapping: dict) -> Column:
    """The value of each code; null where there is none."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), c)


def stray_codes(df: DataFrame, column: str, known: Sequence, excluded: Sequence = ()) -> DataFrame:
    """(code, n) of codes that are neither known nor excluded on purpose; empty if all is well."""
    return df.where(~F.col(column).isin(*known, *excluded)).groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n"))


def assert_no_stray_codes(df: DataFrame, column: str, known: Sequence, excluded: Sequence = ()) -> DataFrame:
    """``df`` itself, or ValueError naming up to 20 stray codes."""
    bad = [r["code"] for r in stray_codes(df, column, known, excluded).orderBy("code").limit(20).collect()]
    if bad:
        raise ValueError(f"{column} has unmapped codes {bad}")
    return df


def years_available(df: DataFrame, variable: str, flags: Sequence[str]) -> DataFrame:
    """(variable, years): names of the flag columns that are 1."""
    long = df.unpivot([variable], list(flags), "year", "flag").where("flag = 1")
    return long.groupBy(variable).agg(F.array_sort(F.collect_list("year")).alias("years"))


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, default=None, out: str | None = None) -> DataFrame:
    """Many-to-one lookup with a default."""
    one = dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    return df.join(one, F.col(key) == F.col("_k"), "left").withColumn(out or value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def lookup_unpadded(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str) -> DataFrame:
    """Lookup by the key, or by the key without leading zeros where that finds nothing."""
    one = dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    two = one.select(F.col("_k").alias("_k2"), F.col("_v").alias("_v2"))
    joined = df.join(one, F.col(key) == F.col("_k"), "left").join(two, F.regexp_replace(key, "^0+", "") == F.col("_k2"), "left")
    return joined.withColumn(value, F.coalesce("_v", "_v2")).drop("_k", "_v", "_k2", "_v2")


def area_rows(df: DataFrame, code: str, prefixes: Sequence[str], year: str | None = None, of_year=None) -> DataFrame:
    """Rows of single areas: codes with one of the prefixes, of one year if given; totals have other codes."""
    own = F.lit(False)
    for p in prefixes:
        own = own | F.col(code).cast("string").startswith(p)
    return df.where(own if year is None else own & (F.col(year) == F.lit(of_year)))


def without_totals(df: DataFrame, value: str, most: float) -> DataFrame:
    """Rows whose value is no more than ``most``: a table's total row is larger than any area."""
    return df.where(F.col(value) <= F.lit(most))


def consolidated(raw: DataFrame, merged: DataFrame, key: str, node: str = "node", originals: str = "originals") -> DataFrame:
    """``raw`` with the merged node that each raw id went into, by (node, originals array); an id in none stays itself."""
    one = merged.select(F.col(node).alias("_into"), F.explode(originals).alias("_raw")).groupBy("_raw").agg(F.min("_into").alias("_into"))
    return raw.join(one, F.col(key) == F.col("_raw"), "left").withColumn(node, F.coalesce("_into", key)).drop("_raw", "_into")


def lookup_pair(df: DataFrame, table: DataFrame, u: str, v: str, value: str) -> DataFrame:
    """``df`` with the value of the pair (u, v) of a table that has it in either direction; its own direction goes first."""
    t = table.select(F.col(u).alias("_u"), F.col(v).alias("_v"), F.col(value).alias("_x"))
    both = t.withColumn("_back", F.lit(0)).unionByName(t.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"), "_x", F.lit(1).alias("_back")))
    one = both.groupBy("_u", "_v").agg(F.min_by("_x", F.struct("_back", "_x")).alias(value))
    return df.join(one, (F.col(u) == F.col("_u")) & (F.col(v) == F.col("_v")), "left").drop("_u", "_v")
