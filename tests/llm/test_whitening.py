"""Embedding whitening against numpy's decomposition of the whole table."""

import math

import numpy as np
import pytest

from spanwise.llm import queries, whitening

ROOT = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """{id: [(component, n, deviation, whitened, explained)]} with components up to their sign, and the directions."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in good]
    points = sorted({tuple(x) for _, x in grid})
    n, sums = len(points), [sum(c) for c in zip(*points)]
    centred = np.array(points, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in grid:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out += [(i, j + 1, n, dev, float((np.array(x) - np.array(sums) / n) @ vectors[:, j] / math.sqrt(values[j])), values[j] / values.sum()) for j in range(k)]
    return out


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{ROOT}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = sorted(tuple(r) for r in queries.op13_whitening(spark, ROOT).collect())
    exp = sorted(brute([tuple(r) for r in table]))
    assert len(got) == len(exp) > 0
    sign = {}
    for g, e in zip(got, exp):
        assert g[:4] == e[:4]
        s = sign.setdefault(g[1], 1 if g[4] * e[4] > 0 else -1)
        assert g[4] * s == pytest.approx(e[4], rel=1e-7, abs=1e-8) and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] < 1e-9


def test_jacobi_is_accurate_on_graded_columns():
    rng = np.random.default_rng(3)
    q1, q2 = np.linalg.qr(rng.normal(size=(30, 9)))[0], np.linalg.qr(rng.normal(size=(9, 9)))[0]
    sizes = 10.0 ** -np.arange(0, 9)
    v, lengths = whitening.jacobi(np.linalg.qr(q1 * sizes @ q2.T, mode="r"))
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-13
    assert lengths == pytest.approx(sizes, rel=1e-6)
    for shape in ((1, 1), (2, 5), (7, 7)):
        a = rng.normal(size=shape)
        assert whitening.jacobi(a)[1] == pytest.approx(np.concatenate((np.linalg.svd(a, compute_uv=False), np.zeros(max(0, shape[1] - shape[0])))), abs=1e-12)


def test_tree_of_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(500, 3)) * [5, 2, 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(23)
    got, exp = sorted(tuple(r) for r in whitening.whitened(df, components=3).collect()), sorted(brute(rows, 3))
    assert [g[:4] for g in got] == [e[:4] for e in exp]
    assert [abs(g[4]) for g in got] == pytest.approx([abs(e[4]) for e in exp], rel=1e-8, abs=1e-9)


def test_nulls_copies_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 8), (2, [3.0, -1.0], None), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (None, [0.5, 0.25], 1), (8, [1.0, 2.0009], 1), (9, [-0.0, 0.1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grid int")
    got = sorted(((r["vec_id"] is None, r["vec_id"], r["component"], r["n"], r["deviation"]) for r in whitening.whitened(df).collect()), key=str)
    assert {g[1] for g in got} == {1, 2, 8, 9, None} and len(got) == 12 and {g[2] for g in got} == {1, 2}
    assert {g[3] for g in got} == {4}  # vectors 1 and 8 fall on one place of the grid
    assert [g[4] for g in got if g[1] == 1] == [g[4] for g in got if g[1] == 8] * 2
    exp = {(i is None, i, j, n, d) for i, j, n, d, *_ in brute([(a, b) for a, b, _ in rows], 2)}
    assert set(got) == exp


def test_nothing_varies_and_empty(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(one).collect()
    assert len(got) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is r["explained"] is r["identity_error"] is None for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows) and all(r["identity_error"] < 1e-12 for r in rows)
    assert whitening.whitened(one.limit(0)).columns == whitening.whitened(one).columns and whitening.whitened(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        whitening.whitened(one.unionByName(spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<double>")))


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(i * i)]) for i in range(6)] + [(9, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["deviation"]) for r in whitening.whitened(df).collect()}
    assert got == {(i, d) for i, _, _, d, *_ in brute(rows[:-1], 2)}
    wide = spark.createDataFrame([(1, [0.0]), (2, [float(2**45)])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitened(wide).collect()} == {None}
