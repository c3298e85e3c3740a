"""Overlay of two layers of polygons: which overlap, by how much, and where.

Polygons may be concave and may have holes and several parts: a place is inside if an odd
number of rings enclose it. Each polygon is first cut by a grid, in strips and then in
cells, so that a row holds what lies in one cell however large the polygon is; the two layers
meet by an equi-join on the cell; and in a cell two polygons are compared by vertical slabs
between neighbouring corners and crossings, in which no edges cross. A pair's area is the
sum over its cells: cells are disjoint, so no overlap is met twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of one comparison held at once.
HELD = 4_000_000

Rings = list[np.ndarray]


def clipped(rings: Rings, axis: int, bound: float, below: bool) -> Rings:
    """Rings on one side of a line across an axis; a concave ring may come back to itself along the line, where it encloses nothing."""
    out = []
    for ring in rings:
        d = bound - ring[:, axis] if below else ring[:, axis] - bound
        inside = d >= 0
        if inside.all():
            out.append(ring)
            continue
        if not inside.any():
            continue
        to = np.roll(ring, -1, axis=0)
        dt = np.roll(d, -1)
        crosses = inside != np.roll(inside, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = ring + (d / (d - dt))[:, None] * (to - ring)
        cut[:, axis] = bound
        # Corners inside, and after each corner the place where its edge crosses the line.
        at = np.arange(len(ring))
        points = np.concatenate((ring[inside], cut[crosses]))
        order = np.argsort(np.concatenate((at[inside] * 2, at[crosses] * 2 + 1)), kind="stable")
        if len(points) > 2:
            out.append(points[order])
    return out


def cells_of(rings: Rings, size: float) -> Iterator[tuple[int, int, Rings]]:
    """(column, row, rings) of each grid cell that a polygon reaches into."""
    every = np.concatenate(rings)
    (x0, y0), (x1, y1) = np.floor(every.min(axis=0) / size).astype(int), np.floor(every.max(axis=0) / size).astype(int)
    for cx in range(x0, x1 + 1):
        strip = clipped(clipped(rings, 0, cx * size, False), 0, (cx + 1) * size, True)
        if strip:
            ys = np.concatenate(strip)[:, 1]
            for cy in range(max(y0, int(np.floor(ys.min() / size))), min(y1, int(np.floor(ys.max() / size))) + 1):
                cell = clipped(clipped(strip, 1, cy * size, False), 1, (cy + 1) * size, True)
                if cell:
                    yield cx, cy, cell


def _edges(rings: Rings) -> np.ndarray:
    """(x0, y0, x1, y1) of the edges that are not vertical, from left to right."""
    e = np.concatenate([np.column_stack((r, np.roll(r, -1, axis=0))) for r in rings])
    e = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
    return e[e[:, 0] < e[:, 2]]


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the places where edges of ``a`` cross edges of ``b``."""
    found = [np.empty(0)]
    for at in range(0, len(a), max(1, HELD // max(1, len(b)))):
        p = a[at : at + max(1, HELD // max(1, len(b))), None, :]
        x0, x1 = np.maximum(p[..., 0], b[:, 0]), np.minimum(p[..., 2], b[:, 2])
        i, j = np.nonzero(x0 < x1)
        u, v, lo, hi = p[i, 0], b[j], x0[i, j], x1[i, j]
        gap = lambda x: (u[:, 1] + (x - u[:, 0]) * (u[:, 3] - u[:, 1]) / (u[:, 2] - u[:, 0])) - (v[:, 1] + (x - v[:, 0]) * (v[:, 3] - v[:, 1]) / (v[:, 2] - v[:, 0]))
        g0, g1 = gap(lo), gap(hi)
        turn = g0 * g1 < 0
        found.append(lo[turn] + (hi[turn] - lo[turn]) * g0[turn] / (g0[turn] - g1[turn]))
    return np.concatenate(found)


def trapezoids(a: Rings, b: Rings) -> np.ndarray:
    """(x0, x1, low at x0, low at x1, high at x0, high at x1) of the parts that lie in both polygons."""
    ea, eb = _edges(a), _edges(b)
    none = np.empty((0, 6))
    if not len(ea) or not len(eb):
        return none
    lo, hi = max(ea[:, 0].min(), eb[:, 0].min()), min(ea[:, 2].max(), eb[:, 2].max())
    if lo >= hi:
        return none
    # Holes and parts of one polygon may touch but not cross, so crossings are looked for between the two alone.
    xs = np.unique(np.concatenate((ea[:, [0, 2]].ravel(), eb[:, [0, 2]].ravel(), _crossings(ea, eb), (lo, hi))))
    xs = xs[(xs >= lo) & (xs <= hi)]
    e, of_a = np.concatenate((ea, eb)), np.repeat([1, 0], [len(ea), len(eb)])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    out = [none]
    step = max(1, HELD // len(e))
    for at in range(0, len(xs) - 1, step):
        x0, x1 = xs[at : at + step][: len(xs) - 1 - at], xs[at + 1 : at + 1 + step]
        mid = (x0 + x1) / 2
        spans = (e[:, 0] <= x0[:, None]) & (e[:, 2] >= x1[:, None])
        y = np.where(spans, e[:, 1] + (mid[:, None] - e[:, 0]) * slope, np.inf)
        order = np.argsort(y, axis=1, kind="stable")
        real = np.take_along_axis(spans, order, axis=1)
        ca = np.cumsum(of_a[order] * real, axis=1)
        cb = np.cumsum((1 - of_a[order]) * real, axis=1)
        both = (ca[:, :-1] % 2 == 1) & (cb[:, :-1] % 2 == 1) & real[:, 1:]
        s, k = np.nonzero(both)
        low, high = order[s, k], order[s, k + 1]
        at_x = lambda which, x: e[which, 1] + (x - e[which, 0]) * slope[which]
        out.append(np.column_stack((x0[s], x1[s], at_x(low, x0[s]), at_x(low, x1[s]), at_x(high, x0[s]), at_x(high, x1[s]))))
    found = np.concatenate(out)
    return found[found[:, 4] - found[:, 2] + found[:, 5] - found[:, 3] > 0]  # rings that come back to themselves enclose nothing there


def area_of(parts: np.ndarray) -> float:
    return float(((parts[:, 1] - parts[:, 0]) * (parts[:, 4] - parts[:, 2] + parts[:, 5] - parts[:, 3]) / 2).sum())


_PIECE = "cx long, cy long, xs array<double>, ys array<double>, sizes array<int>, x0 double, y0 double, x1 double, y1 double"


def _rings(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray) -> Rings:
    cuts = np.cumsum(sizes)[:-1]
    return [np.column_stack(r) for r in zip(np.split(xs, cuts), np.split(ys, cuts)) if len(r[0]) > 2]


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def gridded(polygons: DataFrame, key: str, cell: float, rings: str = "rings") -> DataFrame:
    """(key, own, cx, cy, xs, ys, sizes, x0, y0, x1, y1): each polygon's part in each grid cell, with its area ``own`` there.

    ``rings`` is an array of rings, each an array of (x, y); rings need not repeat their first point. Null or
    empty polygons, rings of under three points and rings with a null or non-finite number have no part.
    """
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    real = F.filter(F.coalesce(rings, F.array().cast(polygons.schema[rings].dataType)), lambda r: r.isNotNull() & (F.size(r) > 2) & F.forall(r, lambda p: ok(p["x"].cast("double")) & ok(p["y"].cast("double"))))
    flat = lambda axis: F.flatten(F.transform(real, lambda r: F.transform(r, lambda p: p[axis].cast("double"))))
    src = polygons.select(key, flat("x").alias("xs"), flat("y").alias("ys"), F.transform(real, F.size).alias("sizes")).where(F.size("sizes") > 0)
    src = src.repartition(_parts(polygons), key)  # small in bytes, so that adaptive execution would leave it to one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, own, rows = [], [], []
            for i in range(b.num_rows):
                whole = _rings(*(np.array(b.column(c)[i].as_py()) for c in (1, 2, 3)))
                for cx, cy, part in cells_of(whole, cell):
                    area = area_of(trapezoids(part, part))
                    if area > 0:
                        every = np.concatenate(part)
                        at.append(i)
                        own.append(area)
                        rows.append((cx, cy, every[:, 0].tolist(), every[:, 1].tolist(), [len(r) for r in part], *every.min(axis=0).tolist(), *every.max(axis=0).tolist()))
                if len(rows) >= 1024 or i + 1 == b.num_rows and rows:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), *[pa.float64()] * 4)
                    columns = [b.column(0).take(pa.array(at)), pa.array(own), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "own", "cx", "cy", "xs", "ys", "sizes", "x0", "y0", "x1", "y1"])
                    at, own, rows = [], [], []

    return src.mapInArrow(run, f"`{key}` {polygons.schema[key].dataType.simpleString()}, own double, {_PIECE}")


def same_shapes(polygons: DataFrame, key: str, name: str, rings: str = "rings") -> DataFrame:
    """(<name>key, <name>of): each key with the least key of equal rings, its own if no other has them."""
    each = polygons.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}key")).agg(F.array_sort(F.collect_list(rings)).alias("_shape"))
    least = each.groupBy("_shape").agg(F.min(f"{name}key").alias(f"{name}of"))
    return each.join(least, "_shape").select(f"{name}key", f"{name}of")


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float, least_area: float = 0.0, least_share: float = 0.0, rings: str = "rings", parts: bool = False) -> DataFrame:
    """(left_key, right_key, area, left_share, right_share) of the pairs whose interiors overlap; with ``parts`` also where.

    Overlaps of no more than ``least_area``, or of less than ``least_share`` of both polygons' areas, are slivers and
    are left out. ``parts`` is an array of trapezoids between two x (x0, x1, low0, low1, high0, high1), each
    within a grid cell of size ``cell``. Polygons that only touch do not overlap; repeated rows of one key
    count as one polygon each time they appear, so keys should be unique. Keys of equal shapes are compared
    once, and the result is dealt out to all of them.
    """
    kinds_l, kinds_r = same_shapes(left, left_key, "_l", rings), same_shapes(right, right_key, "_r", rings)
    own = lambda df, key, kinds, k: df.join(kinds.where(F.col(f"{k}key") == F.col(f"{k}of")).select(F.col(f"{k}of").alias(key)), key, "left_semi")
    a, b = gridded(own(left, left_key, kinds_l, "_l"), left_key, cell, rings), gridded(own(right, right_key, kinds_r, "_r"), right_key, cell, rings)
    total = lambda g, k, name: g.groupBy(k).agg(F.sum("own").alias(name))
    side = lambda g, k, s: g.select(F.col(k).alias(f"{s}key"), "cx", "cy", *(F.col(c).alias(f"{s}{c}") for c in ("xs", "ys", "sizes", "x0", "y0", "x1", "y1")))
    met = side(a, left_key, "l").join(side(b, right_key, "r"), ["cx", "cy"]).where("lx0 < rx1 and rx0 < lx1 and ly0 < ry1 and ry0 < ly1")
    shape = pa.list_(pa.struct([(n, pa.float64()) for n in ("x0", "x1", "low0", "low1", "high0", "high1")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            areas, where = [], []
            for i in range(rows.num_rows):
                found = trapezoids(*(_rings(*(np.array(rows.column(f"{s}{c}")[i].as_py()) for c in ("xs", "ys", "sizes"))) for s in "lr"))
                areas.append(area_of(found))
                where.append([dict(zip(("x0", "x1", "low0", "low1", "high0", "high1"), p)) for p in found.tolist()] if parts else None)
            yield pa.RecordBatch.from_arrays([rows.column("lkey"), rows.column("rkey"), pa.array(areas, pa.float64()), pa.array(where, shape)], names=["lkey", "rkey", "area", "parts"])

    kind = lambda df, k: df.schema[k].dataType.simpleString()
    met = met.repartition(_parts(left), "lkey", "rkey", "cx", "cy")  # a full cell's pairs are dealt out
    here = met.mapInArrow(run, f"lkey {kind(left, left_key)}, rkey {kind(right, right_key)}, area double, parts array<struct<x0:double,x1:double,low0:double,low1:double,high0:double,high1:double>>")
    pairs = here.where("area > 0").groupBy(F.col("lkey").alias(left_key), F.col("rkey").alias(right_key)).agg(F.sum("area").alias("area"), *([F.flatten(F.collect_list("parts")).alias("parts")] if parts else []))
    shared = pairs.where(F.col("area") > least_area).join(total(a, left_key, "_la"), left_key).join(total(b, right_key, "_ra"), right_key)
    out = shared.select(left_key, right_key, "area", (F.col("area") / F.col("_la")).alias("left_share"), (F.col("area") / F.col("_ra")).alias("right_share"), *(["parts"] if parts else []))
    kept = out.where((F.col("left_share") >= least_share) | (F.col("right_share") >= least_share))
    each = kept.join(kinds_l, F.col(left_key) == F.col("_lof")).join(kinds_r, F.col(right_key) == F.col("_rof"))
    return each.select(F.col("_lkey").alias(left_key), F.col("_rkey").alias(right_key), *(c for c in out.columns if c not in (left_key, right_key)))
