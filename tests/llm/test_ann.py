import math

import numpy as np
import pytest

from spanwise.llm import ann, queries

ROOT = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        d = sorted((math.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum()), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = d[:k]
    return out


def test_recall_and_distances(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    truth = brute(rows, [x for x in rows if x[0] % 100 == 0], 10)
    got = queries.op5_ann(spark, ROOT).collect()
    hit = sum((r["score"], r["vec_id"]) in [(pytest.approx(d, abs=1e-12), i) for d, i in truth[r["query_id"]]] for r in got)
    assert len(got) == 10 * len(truth) and hit >= 0.9 * len(got)
    for q in truth:
        own = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [x[0] for x in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_blocks_and_batches_agree(spark):
    v = spark.read.parquet(f"{ROOT}/embeddings.parquet")
    q = v.where("vec_id % 25 = 0")
    a = ann.search(v, q, confidence=0.9999).collect()
    b = ann.search(v, q, confidence=0.9999, block=50).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (11, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, id string")
    got = ann.search(df, df, k=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {1: [2, 3], 2: [1, 3], 3: [1, 2], 11: [1, 2]}
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ann.search(df, df, dimensions=3)


def test_queries_of_one_id_are_ranked_each(spark):
    data = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [0.0, 1.0]), (100, [9.0, 1.0]), (100, [9.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(data, asked, k=2).collect())
    assert got == [(1, 0, 0.0), (1, 9, 0.0), (2, 1, 1.0), (2, 8, 1.0)]


def test_recall_over_all_queries(spark):
    """Every query of the larger table, against all pairs at once; and how many vectors were verified."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    ids = rows["vec_id"].to_numpy()
    got = {}
    for r in queries.op5_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit >= 0.9 * 10 * len(asked)


def test_many_equal_vectors_tie_by_id(spark):
    df = spark.range(3000).selectExpr("id as vec_id", "array(1.0D, if(id < 2500, 0.0D, id + 0.0D)) as embedding")
    got = ann.search(df, df.where("vec_id in (0, 2499)"), k=3, block=700).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (2499, 1, 0), (2499, 2, 1), (2499, 3, 2)]


def test_chi_square():
    assert ann.chi_square_cdf(ann.chi_square_quantile(0.9, 8), 8) == pytest.approx(0.9)
    assert ann.chi_square_cdf(2.0, 2) == pytest.approx(1 - math.exp(-1)) and ann.chi_square_cdf(0, 8) == 0 and ann.chi_square_cdf(1e9, 8) == 1


def test_tree_gives_all_points_in_order():
    rng = np.random.default_rng(1)
    pts = np.concatenate((rng.standard_normal((500, 4)), np.zeros((300, 4))))
    tree, q, seen = ann.KdTree(pts, 16), rng.standard_normal(4), []
    for at, rest in tree.incremental(q):
        seen += at.tolist()
        left = np.setdiff1d(np.arange(800), seen)
        assert not len(left) or ((pts[left] - q) ** 2).sum(axis=1).min() >= rest - 1e-9
    assert sorted(seen) == list(range(800))


def test_regions_leave_out_what_is_far(spark):
    """Clustered vectors: a query visits few regions and still finds its neighbours."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 20
    x = (centres[np.arange(4000) % 40] + rng.standard_normal((4000, 16)) * 0.3).astype(float)
    r = ann.Regions(x[:1000], np.arange(1000), 64, 8, 0.9)
    assert len(r.low) > 32 and max(len(r.reach(i, x[i], 10)[0]) for i in range(100)) < 20
    assert all(r.of(x[i : i + 1])[0] in r.reach(i, x[i], 10)[0] for i in range(100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0"), block=100).collect()
    truth = brute(list(enumerate(x)), [(i, x[i]) for i in range(0, 4000, 100)], 10)
    hit = sum((r["vec_id"] in [i for _, i in truth[r["query_id"]]]) for r in got)
    assert len(got) == 400 and hit >= 0.9 * 400
