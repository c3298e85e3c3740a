"""A look at tables from the command line: ``python -m spanwise.explore FOLDER [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import weighted
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanwise.explore", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--tables", action="store_true", help="files, largest first")
    p.add_argument("--table", help="a table, by its name or the beginning of it")
    p.add_argument("--vars", action="store_true", help="the table's columns and their types")
    p.add_argument("--levels", metavar="COLUMN", help="the distinct values of a column, with their rows")
    p.add_argument("--years", nargs="+", type=int, help="only rows of these years")
    p.add_argument("--year-column", default="SurveyYear")
    p.add_argument("--head", type=int, metavar="N", help="the first rows")
    p.add_argument("--counts", action="store_true", help="rows and weighted rows by the columns of --by")
    p.add_argument("--by", nargs="+", default=[])
    p.add_argument("--weight")
    p.add_argument("--multiplier")
    return p


def answer(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The table that the arguments ask for; ValueError if they ask for none."""
    a = parser().parse_args(argv)
    listed = tables.catalogue(spark, a.folder)
    if a.tables or not a.table:
        return listed
    name = tables.resolve(sorted({r["name"] for r in listed.select("name").collect()}), a.table)
    df = tables.scan(spark, f"{a.folder}/{name}.parquet", None, a.years, a.year_column)
    if a.vars:
        return spark.createDataFrame([(c, t) for c, t in df.dtypes], "variable string, type string")
    if a.levels:
        return df.groupBy(a.levels).agg(F.count("*").alias("n")).orderBy(a.levels)
    if a.counts:
        return weighted.weighted_counts(df, a.by, a.weight, a.multiplier)
    if a.head:
        return df.limit(a.head)
    raise ValueError("one of --tables, --vars, --levels, --head and --counts")


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("explore").getOrCreate()
    answer(spark, sys.argv[1:]).show(1000, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
