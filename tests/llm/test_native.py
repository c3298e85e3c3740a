"""Line dedup and sharding."""

import duckdb
import pandas as pd
import pytest

from spanwise.llm import line_dedup, sharding

PAGES = [
    (1, "a", "menu\nhello\nfoot"), (2, "a", "menu\nworld\nfoot "), (3, "a", "menu\nmenu\n\nagain"), (4, "a", None), (5, "a", ""),
    (6, "b", "menu\nonce"), (7, None, "menu\nx"), (8, None, "menu\ny"), (8, None, "menu\ny"), (9, "a", "menu"),
]


def test_lines_against_sql(spark):
    df = spark.createDataFrame(PAGES, "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate_lines(df, max_ratio=0.4, min_pages=2, counts=("n_lines", "n_removed")).select("doc_id", "text", "n_lines", "n_removed").toPandas()
    documents = pd.DataFrame(PAGES, columns=["doc_id", "source", "text"])  # noqa: F841  read by DuckDB
    sql = line_dedup.ORACLE.replace(f">= {line_dedup.MIN_PAGES}", ">= 2").replace(f"{line_dedup.MAX_RATIO}e0", "0.4e0")
    exp = duckdb.sql(sql).df()
    rows = lambda d: sorted(tuple("-" if pd.isna(x) else str(x) for x in r) for r in d[["doc_id", "text", "n_lines", "n_removed"]].itertuples(index=False))
    assert rows(got) == rows(exp)
    by = {r.doc_id: r.text for r in got.itertuples()}
    assert by[1] == "hello\nfoot" and by[3] == "\nagain" and by[6] == "menu\nonce" and by[9] == "" and pd.isna(by[4])


def test_lines_by_shuffle_equal_those_by_broadcast(spark):
    df = spark.createDataFrame(PAGES, "doc_id long, source string, text string")
    both = [sorted(map(str, line_dedup.drop_boilerplate_lines(df, max_ratio=0.4, min_pages=2, broadcast_lines=n).collect())) for n in (0, 1000)]
    assert both[0] == both[1]


def test_lines_keep_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x\ny", "own", 5)], "doc_id long, source string, text string, bp_lines string, host int")
    assert line_dedup.drop_boilerplate_lines(df).collect() == df.collect()
    assert line_dedup.drop_boilerplate_lines(df.limit(0)).count() == 0


def test_line_counts_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a", "x\ny", "old")], "doc_id long, source string, text string, N_lines string")
    got = line_dedup.drop_boilerplate_lines(df, counts=("n_lines", "n_removed"))
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_removed"] and got.first()[3:] == (2, 0)


def test_a_hot_line_on_a_hot_host(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source", "concat('common\nline ', id) as text")
    got = line_dedup.drop_boilerplate_lines(df)
    assert got.where("text like '%common%'").count() == 0 and got.count() == 3000


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (16, 2039)])
def test_table_is_fair(n, size):
    owners = sharding.lookup_table([f"s{i}" for i in range(n)], size)
    counts = [owners.count(i) for i in range(n)]
    assert len(owners) == size and max(counts) - min(counts) <= 1


def test_losing_a_shard_moves_few_keys():
    names = [f"s{i}" for i in range(10)]
    a, b = sharding.lookup_table(names, 2039), sharding.lookup_table(names[:-1], 2039)
    assert sum(x != y for x, y in zip(a, b) if x != 9) < 0.15 * 2039


def test_tables_refuse_bad_sizes():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "w"), (2, "x")], "doc_id long, slot string")
    got = sharding.assign_shards(df, ["doc_id"])
    rows = got.collect()
    assert len(rows) == 5 and got.columns == ["doc_id", "slot", "shard"]
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1 and len({r["slot"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.assign_shards(df.limit(0), ["doc_id"]).count() == 0


def test_placement_keeps_columns_named_like_its_helpers(spark):
    df = spark.createDataFrame([(1, 7, 8, 9)], "doc_id long, place_slot_of int, place_slot int, _place_slot int")
    assert sharding.assign_shards(df, ["doc_id"]).first()[1:4] == (7, 8, 9)


def test_spread_splits_a_hot_key(spark):
    df = spark.range(2000).selectExpr("'hot' as source", "id as doc_id")
    one = sharding.assign_shards(df, ["source"]).select("shard").distinct().count()
    many = sharding.assign_shards(df, ["source"], spread=["doc_id"]).select("shard").distinct().count()
    assert one == 1 and many > 3


def test_placement_plan_has_no_python(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    plan = sharding.assign_shards(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
