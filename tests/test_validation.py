from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from corridor_jobs.operators import validation
from corridor_jobs.operators.network import DIRECTIONS

WIDE = "TspAssetID int, osmid long, Name string, x double, y double, " + ", ".join(f"{d}_min double, {d}_max double" for d in DIRECTIONS)


def wide(spark, **sides):
    values = [v for d in DIRECTIONS for v in sides.get(d, (None, None))]
    return spark.createDataFrame([(1, 5, "s", 0.0, 0.0, *values)], WIDE)


def test_ranges_unpivot_and_pivot(spark):
    df = wide(spark, north=(300.0, 20.0), east=(40.0, None))
    got = validation.ranges_by_direction(validation.ranges_long(df.unionByName(df)))
    assert sorted((r.direction, r["min"], r["max"]) for r in got.collect()) == [("east", 40.0, None), ("north", 300.0, 20.0)]
    assert [(r.direction, r.bearing_lower_bound) for r in validation.corrected_long(df).collect()] == [("north", 300.0)]


def flags(spark, h, low, high, **kw):
    df = spark.createDataFrame([(1, "north", low, high, h)], "TspAssetID int, direction string, min double, max double, Heading double")
    r = validation.heading_flags(df, **kw).first()
    return r.error, r.success, r.heading_available


def test_only_wrapped_ranges_can_be_in_error(spark):
    assert flags(spark, 200.0, 10.0, 90.0) == (False, True, True)  # outside a plain range, yet no error
    assert flags(spark, 200.0, 10.0, 90.0, strict=True) == (True, False, True)
    assert flags(spark, 100.0, 300.0, 20.0) == (True, False, True)
    assert flags(spark, 310.0, 300.0, 20.0) == (False, True, True)
    assert flags(spark, 310.0, 300.0, 20.0, strict=True) == (False, True, True)
    assert flags(spark, None, 300.0, 20.0) == (False, False, False)
    assert flags(spark, 5.0, None, 20.0) == (False, False, True)


def test_match_and_rate(spark):
    ranges = spark.createDataFrame([(1, "north", 300.0, 20.0), (2, "east", 1.0, 9.0)], "TspAssetID int, direction string, min double, max double")
    sent = [(1, 310.0, "north", "r", "i", "s"), (1, 310.0, "north", "r", "i", "s"), (3, 1.0, "west", "r", "i", "t")]
    headings = spark.createDataFrame(sent, "TspAssetID int, Heading double, direction string, Route string, Intersection string, Name string")
    done = validation.heading_flags(validation.match_headings(ranges, headings))
    assert done.count() == 3
    assert validation.success_rate(done).first().success_rate == 0.5
    assert [tuple(r) for r in validation.signals_missing_ranges(done).collect()] == [("t", 3)]
    places = spark.createDataFrame([(3, 1.5, 2.5), (1, 0.0, 0.0)], "TspAssetID int, x double, y double")
    assert [tuple(r) for r in validation.signals_missing_ranges(done, places).select("Name", "TspAssetID", "x", "y").collect()] == [("t", 3, 1.5, 2.5)]
    with pytest.raises(PySparkException, match="repeated TspAssetID"):
        validation.signals_missing_ranges(done, places.unionByName(places)).collect()
    with pytest.raises(PySparkException, match="repeated TspAssetID, direction"):
        validation.match_headings(ranges.unionByName(ranges), headings).collect()
    assert validation.success_rate(done.filter("Heading IS NULL")).first().success_rate is None


def test_triangles_and_lines_point_back(spark):
    t = validation.validation_triangles(validation.corrected_long(wide(spark, north=(0.0, 90.0)))).first().triangle
    assert [tuple(p) for p in t] == [(0.0, 0.0), pytest.approx((0.0, -100.0)), pytest.approx((-100.0, 0.0))]
    signals = spark.createDataFrame([(1, 10.0, 10.0)], "TspAssetID int, x double, y double")
    headings = spark.createDataFrame([(1, 180.0), (1, None), (2, 5.0)], "TspAssetID int, Heading double")
    lines = [r.line for r in validation.request_lines(headings, signals).orderBy("TspAssetID", "Heading").collect()]
    assert lines[0] is None and lines[2] is None
    assert tuple(lines[1][1]) == pytest.approx((10.0, 192.0))
