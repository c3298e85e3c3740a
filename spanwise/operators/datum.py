"""Changes of datum through earth-centred coordinates, and a root search as a Column."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import from_itm, to_itm


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid: ellipsoid, origin in degrees, scale, and the origin's easting and northing."""

    major: float
    flattening: float
    lat0: float
    lon0: float
    scale: float
    east0: float
    north0: float


@dataclass(frozen=True)
class Shift:
    """Seven parameters by the position-vector convention: metres, seconds of arc, parts in a million."""

    x: float
    y: float
    z: float
    rx: float
    ry: float
    rz: float
    ppm: float


# WGS 84; the Irish Grid (EPSG:29902) on Airy's modified ellipsoid; its published shift to WGS 84.
WGS84 = (6378137.0, 1 / 298.257223563)
IRISH_GRID = Grid(6377340.189, 1 / 299.3249646, 53.5, -8.0, 1.000035, 200000.0, 250000.0)
TO_WGS84 = Shift(482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; formulas built on formulas double in size otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unproject(x: Column, y: Column, grid: Grid) -> Column:
    """(lon, lat) in degrees on the grid's own ellipsoid, by the inverse series of the third order."""
    n = grid.flattening / (2 - grid.flattening)
    radius = grid.major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    e, s0 = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(grid.lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    m0 = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))

    def series(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        u, v = xi, eta
        for j, b in enumerate(beta, 1):
            u = u - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
            v = v - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        return F.struct(u.alias("u"), v.alias("v"))

    def place(p: Column) -> Column:
        return F.struct((F.lit(grid.lon0) + F.degrees(F.atan2(F.sinh(p["v"]), F.cos(p["u"])))).alias("lon"), F.asin(F.sin(p["u"]) / F.cosh(p["v"])).alias("chi"))

    def latitude(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(delta, 1):
            lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * p["chi"])
        return F.struct(p["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    start = F.struct(((y - F.lit(grid.north0)) / F.lit(grid.scale * radius) + F.lit(m0)).alias("xi"), ((x - F.lit(grid.east0)) / F.lit(grid.scale * radius)).alias("eta"))
    return _let(_let(_let(start, series), place), latitude)


def to_earth(place: Column, major: float, flattening: float) -> Column:
    """Earth-centred metres (x, y, z) of a place (lon, lat) on an ellipsoid."""
    e2 = flattening * (2 - flattening)

    def metres(q: Column) -> Column:
        lon, lat = F.radians(q["lon"]), F.radians(q["lat"])
        nu = F.lit(major) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin(lat) * F.sin(lat))
        return F.struct((nu * F.cos(lat) * F.cos(lon)).alias("x"), (nu * F.cos(lat) * F.sin(lon)).alias("y"), (nu * F.lit(1 - e2) * F.sin(lat)).alias("z"))

    return _let(place, metres)


def from_earth(point: Column, major: float, flattening: float) -> Column:
    """(lon, lat) in degrees of earth-centred metres, by Bowring's formula, exact to far below a millimetre near the ground."""
    minor = major * (1 - flattening)
    e2, d2 = flattening * (2 - flattening), (major / minor) ** 2 - 1

    def place(q: Column) -> Column:
        r = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        t = F.atan2(q["z"] * F.lit(major), r * F.lit(minor))
        lat = F.atan2(q["z"] + F.lit(d2 * minor) * F.pow(F.sin(t), 3), r - F.lit(e2 * major) * F.pow(F.cos(t), 3))
        return F.struct(F.degrees(F.atan2(q["y"], q["x"])).alias("lon"), F.degrees(lat).alias("lat"))

    return _let(point, place)


def shifted(point: Column, by: Shift) -> Column:
    """Earth-centred metres of one datum as those of another."""
    s = F.lit(1 + by.ppm * 1e-6)
    a, b, c = (F.lit(math.radians(r / 3600)) for r in (by.rx, by.ry, by.rz))

    def moved(q: Column) -> Column:
        x, y, z = q["x"], q["y"], q["z"]
        return F.struct((F.lit(by.x) + s * (x - c * y + b * z)).alias("x"), (F.lit(by.y) + s * (c * x + y - a * z)).alias("y"), (F.lit(by.z) + s * (a * y - b * x + z)).alias("z"))

    return _let(point, moved)


def grid_to_wgs84(x: Column, y: Column, grid: Grid = IRISH_GRID, by: Shift = TO_WGS84) -> Column:
    """(lon, lat) in degrees of WGS 84 of grid metres; within a metre, as a shift of seven parameters is. Null gives nulls."""
    return from_earth(shifted(to_earth(unproject(x, y, grid), grid.major, grid.flattening), by), *WGS84)


def bisect(f: Callable[[Column], Column], low: float, high: float, steps: int = 60) -> Column:
    """Where a rising function passes from below 0, by so many halvings of a range; an end if it does not."""
    ends = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        def step(p: Column) -> Column:
            return ends(F.when(p["below"], p["m"]).otherwise(p["a"]), F.when(p["below"], p["b"]).otherwise(p["m"]))

        mid = _let(F.struct(acc["a"].alias("a"), acc["b"].alias("b"), ((acc["a"] + acc["b"]) / 2).alias("m")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["m"].alias("m"), (f(p["m"]) < 0).alias("below")))
        return _let(mid, step)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends(F.lit(float(low)), F.lit(float(high))), halve, lambda acc: (acc["a"] + acc["b"]) / 2)


def root_between(f: Callable[[Column], Column], low: float, high: float, tolerance: float = 1e-12, steps: int = 60) -> Column:
    """Where a rising function passes from below 0, as ``bisect``; an end if it does not. A smooth function takes some ten values.

    A step tries where the chord through both ends passes; an end that stays twice counts half, and from the
    tenth step on the middle is tried instead. No value is computed once the ends are within ``tolerance`` or a value is 0.
    """
    ends = lambda a, fa, b, fb, side: F.struct(a.alias("a"), fa.alias("fa"), b.alias("b"), fb.alias("fb"), side.alias("side"))
    zero = F.lit(0.0)

    def step(p: Column) -> Column:
        a, fa, b, fb, m, fm, side = (p[k] for k in ("a", "fa", "b", "fb", "m", "fm", "side"))
        below = ends(m, fm, b, F.when(side == 1, fb / 2).otherwise(fb), F.lit(1))
        above = ends(a, F.when(side == -1, fa / 2).otherwise(fa), m, fm, F.lit(-1))
        return F.when(fm == 0, ends(m, zero, m, zero, F.lit(0))).when(fm < 0, below).otherwise(above)

    def narrow(acc: Column, k: Column) -> Column:
        a, fa, b, fb = acc["a"], acc["fa"], acc["b"], acc["fb"]
        chord = F.greatest(a, F.least(b, a - fa * (b - a) / (fb - fa)))
        m = F.when((k > 10) | (fb - fa <= 0), (a + b) / 2).otherwise(chord)
        known = lambda q: F.struct(*(q[c].alias(c) for c in ("a", "fa", "b", "fb", "side", "m")), f(q["m"]).alias("fm"))
        tried = F.struct(a.alias("a"), fa.alias("fa"), b.alias("b"), fb.alias("fb"), acc["side"].alias("side"), m.alias("m"))
        return F.when(b - a <= F.lit(tolerance), acc).otherwise(_let(_let(tried, known), step))

    lo, hi = F.lit(float(low)), F.lit(float(high))

    def inside(p: Column) -> Column:
        start = ends(lo, p["fa"], hi, p["fb"], F.lit(0))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrow, lambda acc: (acc["a"] + acc["b"]) / 2)
        return F.when(p["fa"] >= 0, lo).when(p["fb"] < 0, hi).when(p["fa"].isNotNull() & p["fb"].isNotNull(), found)

    return _let(F.struct(f(lo).alias("fa"), f(hi).alias("fb")), inside)


def resolved_place(a: Column, b: Column) -> Column:
    """(lon, lat) of a pair of columns that should hold latitude and longitude, but may hold a grid easting and a latitude, or
    a grid northing and easting; null where none of these gives a place on the island."""
    a, b = a.cast("double"), b.cast("double")
    # A place is computed once and then tested.
    island = lambda place: _let(place, lambda p: F.when((p["lon"] > -11) & (p["lon"] < -5.3) & (p["lat"] > 51.2) & (p["lat"] < 55.5), p))
    place = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    found = root_between(lambda lon: to_itm(b, lon)["x"] - a, -11.0, -5.0)
    back = from_itm(b, a)
    plain = (a > 51) & (a < 56) & (b > -11) & (b < -5)
    return F.when(plain, place(b, a)).when((a > 400_000) & (b > 51) & (b < 56), island(place(found, b))).when((a > 400_000) & (b > 400_000), island(_let(back, lambda p: place(p["lon"], p["lat"]))))
