"""Polygon overlay against exact areas and sampling."""

import math
import random

import numpy as np
import pytest

from spanwise.operators import overlay

DDL = "key long, rings array<array<struct<x:double,y:double>>>"


def layer(spark, polygons):
    return spark.createDataFrame([(k, None if p is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for k, p in polygons.items()], DDL)


def star(rng, x, y, n, size):
    """A concave ring around a point, with no edge across another."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + (r := size * rng.uniform(0.3, 1)) * math.cos(t), y + r * math.sin(t)) for t in turns]


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return odd


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_concave_rings_and_holes_against_sampling(spark):
    rng = random.Random(4)
    left = {i: [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), 12, 4)] for i in range(8)}
    left[0] = [box(0, 0, 10, 10), box(2, 2, 8, 5)]  # a hole
    left[1] = [box(0, 0, 3, 3), box(6, 6, 9, 9)]  # two parts
    right = {i: [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), 9, 3)] for i in range(7)}
    sample = np.random.default_rng(1).uniform(-5, 15, (2, 400_000))
    a, b = ({k: inside(p, *sample) for k, p in side.items()} for side in (left, right))
    got = {(r["l"], r["r"]): r for r in overlay.overlay(layer(spark, left).withColumnRenamed("key", "l"), layer(spark, right).withColumnRenamed("key", "r"), "l", "r", 1.7, parts=True).collect()}
    for i in left:
        for j in right:
            exp = float((a[i] & b[j]).mean() * 400)
            area = got[i, j]["area"] if (i, j) in got else 0.0
            assert area == pytest.approx(exp, abs=0.25)
            if (i, j) in got:
                assert got[i, j]["left_share"] == pytest.approx(area / (a[i].mean() * 400), rel=0.1)
                parts = np.array([tuple(p) for p in got[i, j]["parts"]])
                assert overlay.area_of(parts) == pytest.approx(area)
                parts = parts[(parts[:, 1] - parts[:, 0]) * (parts[:, 4] - parts[:, 2] + parts[:, 5] - parts[:, 3]) > 1e-9]
                middle = parts[:, :2].mean(axis=1), parts[:, 2:].mean(axis=1)
                assert inside(left[i], *middle).all() and inside(right[j], *middle).all()


def test_overlaps_of_a_partition_add_up(spark):
    rng = random.Random(2)
    left = {i: [star(rng, rng.uniform(2, 8), rng.uniform(2, 8), 15, 2)] for i in range(6)}
    tiles = {10 * i + j: [box(i * 1.25, j * 1.25, (i + 1) * 1.25, (j + 1) * 1.25)] for i in range(8) for j in range(8)}
    for cell in (0.4, 1.25, 50.0):
        rows = overlay.overlay(layer(spark, left).withColumnRenamed("key", "l"), layer(spark, tiles).withColumnRenamed("key", "r"), "l", "r", cell).groupBy("l").agg({"left_share": "sum", "area": "sum"}).collect()
        assert len(rows) == 6
        for r in rows:
            own = overlay.area_of(overlay.trapezoids(*[[np.array(left[r["l"]][0])]] * 2))
            ring = left[r["l"]][0]
            shoelace = abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]))) / 2
            assert own == pytest.approx(shoelace) and r["sum(left_share)"] == pytest.approx(1) and r["sum(area)"] == pytest.approx(shoelace)


def test_touching_equal_slivers_and_odd_rows(spark):
    left = {1: [box(0, 0, 2, 2)], 2: [box(2, 0, 4, 2)], 3: None, 4: [], 5: [[(0, 0), (1, 1)]], 6: [[(0, 0), (1, math.nan), (1, 1)]], 7: [box(0, 0, 2, 2) + [(0, 0)]]}
    right = {1: [box(0, 0, 2, 2)], 2: [box(1.999, 0, 5, 2)]}
    run = lambda **k: {(r["l"], r["r"]): round(r["area"], 6) for r in overlay.overlay(layer(spark, left).withColumnRenamed("key", "l"), layer(spark, right).withColumnRenamed("key", "r"), "l", "r", 0.75, **k).collect()}
    assert run() == {(1, 1): 4.0, (1, 2): 0.002, (2, 2): 4.0, (7, 1): 4.0, (7, 2): 0.002}
    assert run(least_area=0.01) == run(least_share=0.01) == {(1, 1): 4.0, (2, 2): 4.0, (7, 1): 4.0}
    assert overlay.overlay(layer(spark, left).limit(0), layer(spark, right).withColumnRenamed("key", "r"), "key", "r", 1.0).count() == 0


def test_keys_of_equal_shapes_are_compared_once(spark):
    left, right = {k: [box(0, 0, 2, 1)] for k in range(40)}, {k: [box(1, 0, 3, 1)] for k in range(30)} | {30: [box(0, 0, 1, 1)]}
    kinds = overlay.same_shapes(layer(spark, right).withColumnRenamed("key", "r"), "r", "_r")
    assert {r["_rkey"]: r["_rof"] for r in kinds.collect()} == dict.fromkeys(range(30), 0) | {30: 30}
    found = overlay.overlay(layer(spark, left).withColumnRenamed("key", "l"), layer(spark, right).withColumnRenamed("key", "r"), "l", "r", 4.0)
    assert sorted((r["l"], r["r"], r["area"], r["left_share"]) for r in found.collect()) == [(i, j, 1.0, 0.5) for i in range(40) for j in range(31)]
