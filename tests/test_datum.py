"""Datum shift and root search."""

import pytest
from pyspark.sql import functions as F

from spanwise.operators import datum, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_a_published_point_within_a_metre(spark):
    """A point that the mapping agency publishes in both grids."""
    p = one(spark, datum.grid_to_wgs84(F.lit(309958.26), F.lit(236141.93)))
    itm = one(spark, spatial.to_itm(F.lit(p["lat"]), F.lit(p["lon"])))
    assert itm["x"] == pytest.approx(709885.081, abs=1) and itm["y"] == pytest.approx(736167.699, abs=1)


def test_earth_centred_round_trip(spark):
    for lon, lat in ((-8.5, 53.2), (0.0, 0.0), (179.0, -89.0)):
        back = one(spark, datum.from_earth(datum.to_earth(F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")), *datum.WGS84), *datum.WGS84))
        assert (back["lon"], back["lat"]) == pytest.approx((lon, lat), abs=1e-10)
    assert tuple(one(spark, datum.to_earth(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), *datum.WGS84))) == pytest.approx((6378137.0, 0, 0))


def test_grid_origin(spark):
    p = one(spark, datum.unproject(F.lit(200000.0), F.lit(250000.0), datum.IRISH_GRID))
    assert (p["lon"], p["lat"]) == pytest.approx((-8.0, 53.5), abs=1e-7)


def test_bisect(spark):
    assert one(spark, datum.bisect(lambda x: x * x * x - 2, 0, 3)) == pytest.approx(2 ** (1 / 3), abs=1e-12)
    assert one(spark, datum.bisect(lambda x: x + 10, 0, 3)) == pytest.approx(0) and one(spark, datum.bisect(lambda x: x - 10, 0, 3)) == pytest.approx(3)


def test_resolved_places(spark):
    itm = one(spark, spatial.to_itm(F.lit(53.2), F.lit(-7.1)))
    rows = [(53.2, -7.1), (itm["x"], 53.2), (itm["y"], itm["x"]), (None, 1.0), (3.0, 4.0), (900_000.0, 53.2)]
    got = [r["p"] for r in spark.createDataFrame(rows, "a double, b double").select(datum.resolved_place(F.col("a"), F.col("b")).alias("p")).collect()]
    for p in got[:3]:
        assert (p["lon"], p["lat"]) == pytest.approx((-7.1, 53.2), abs=1e-6)
    assert got[3] is got[4] is None and got[5] is None


def test_root_between_takes_few_values(spark):
    """A root within the tolerance; the ends as with bisect; null stays null."""
    assert one(spark, datum.root_between(lambda x: x * x * x - 2, 0, 3)) == pytest.approx(2 ** (1 / 3), abs=1e-11)
    assert one(spark, datum.root_between(lambda x: x + 10, 0, 3)) == 0 and one(spark, datum.root_between(lambda x: x - 10, 0, 3)) == 3
    assert one(spark, datum.root_between(lambda x: x - 1, 0, 3)) == 1 and one(spark, datum.root_between(lambda x: F.exp(x * 40) - 5, 0, 3)) == pytest.approx(0.0402359478, abs=1e-9)
    assert one(spark, datum.root_between(lambda x: x - F.lit(None).cast("double"), 0, 3)) is None


def test_a_place_is_searched_for_once(spark):
    """The formula names its search once, however often its place is tested and read."""
    p = datum.resolved_place(F.col("a"), F.col("b"))
    plan = spark.createDataFrame([(600_000.0, 53.5)], "a double, b double").select(p.alias("p")).select("p.lon", "p.lat")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("sequence(1, 60") <= 1
    assert [round(x, 6) for x in plan.first()] == [-8.0, 53.5]
