"""Every bound query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from spanwise.plans import bindings

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{ROOT}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
        return None
    return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)


def rows(df, columns):
    return sorted((tuple(map(cell, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(bindings.ORACLE))
def test_against_sql(spark, db, name):
    got, exp = bindings.QUERIES[name](spark, ROOT).toPandas(), db.sql(bindings.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(exp, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLE)))
def test_runs(spark, name):
    assert bindings.QUERIES[name](spark, ROOT).count() > 0


def test_whole_tables(spark):
    def ids(name, column):
        return {r[0] for r in bindings.QUERIES[name](spark, ROOT).select(column).collect()}

    def rows_of(name, column):
        return {r[0] for r in spark.read.parquet(f"{ROOT}/{name}.parquet").select(column).collect()}

    assert ids("knn", "vec_id") == rows_of("embeddings", "vec_id")
    assert any(r["near"] % 5 == 0 for r in bindings.knn(spark, ROOT).where("near is not null").collect())
    assert ids("fuzzy_block", "p_name") == rows_of("part", "p_name")
    assert ids("shortest_path", "source") == rows_of("nation", "n_nationkey")
    assert ids("merge_right_wins", "key") == rows_of("customer", "c_custkey") | rows_of("supplier", "s_suppkey")


def test_flows_conserve(spark):
    got = bindings.gravity_flows(spark, ROOT).groupBy("src").sum("flow").toPandas()
    made = spark.read.parquet(f"{ROOT}/customer.parquet").groupBy("c_nationkey").count().toPandas().set_index("c_nationkey")["count"]
    for r in got.itertuples():
        assert r[2] == 0 or r[2] == pytest.approx(made.get(r.src, 0))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 600 and set(entry.oracle_sql()) <= set(entry.queries())
