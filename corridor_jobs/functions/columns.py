"""Column expressions, all built-in: no Python runs on the executors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TEXT = r"POINT\s*\(\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*\)"

# Fixed values of EPSG:3310 (Albers equal-area on GRS80): axis, flattening, origin, standard parallels, false northing.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
LAT0, LON0, SP1, SP2, FALSE_NORTHING = 0.0, -120.0, 34.0, 40.5, -4000000.0
_E = math.sqrt(GRS80_F * (2 - GRS80_F))


def decode_point(wkt: Column) -> Column:
    """WKT point -> struct(x, y); null for null or other text."""
    x, y = F.regexp_extract(wkt, POINT_TEXT, 1), F.regexp_extract(wkt, POINT_TEXT, 2)
    return F.when(x != "", F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def decode_line(points: Column) -> Column:
    """Array of WKT points -> array of struct(x, y); null for null, 0 or 1 points, as these make no line."""
    return F.when(F.size(points) > 1, F.transform(points, decode_point))


def line_text(line: Column) -> Column:
    """Array of struct(x, y) -> WKT line."""
    each = F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.when(line.isNotNull(), F.concat(F.lit("LINESTRING ("), F.array_join(each, ", "), F.lit(")")))


def point_text(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")))


def _q(sin: float) -> float:
    return (1 - _E**2) * (sin / (1 - (_E * sin) ** 2) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees -> metres (x, y) in EPSG:3310. WGS84 is taken for NAD83. Null where either is null."""
    m1, m2 = _m(math.radians(SP1)), _m(math.radians(SP2))
    q0, q1, q2 = (_q(math.sin(math.radians(d))) for d in (LAT0, SP1, SP2))
    n = (m1**2 - m2**2) / (q2 - q1)
    c = m1**2 + n * q1
    rho0 = GRS80_A * math.sqrt(c - n * q0) / n
    sin = F.sin(F.radians(lat))
    q = (1 - _E**2) * (sin / (1 - (sin * _E) * (sin * _E)) - F.log((1 - sin * _E) / (1 + sin * _E)) / (2 * _E))
    rho = F.sqrt(c - q * n) * GRS80_A / n
    theta = F.radians(lon - LON0) * n
    return rho * F.sin(theta), rho0 - rho * F.cos(theta) + FALSE_NORTHING


def distance_to_point(x: Column, y: Column, x0: Column | float, y0: Column | float) -> Column:
    """Planar distance."""
    return F.hypot(x - x0, y - y0)


def azimuth_from_point(x: Column, y: Column, x0: Column | float, y0: Column | float) -> Column:
    """Degrees clockwise from north, 0 to 360, from (x0, y0) to (x, y): from the signal to the bus."""
    return F.pmod(F.degrees(F.atan2(x - x0, y - y0)), F.lit(360.0))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing from the first point to the second, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def positive_distance_to_bearing(b1: Column, b2: Column) -> Column:
    """Clockwise gap from b1 to b2; equal bearings give 360."""
    return F.when(b2 > b1, b2 - b1).otherwise(b2 - b1 + 360)


def negative_distance_to_bearing(b1: Column, b2: Column) -> Column:
    """Anticlockwise gap from b1 to b2; equal bearings give 360."""
    return F.when(b1 > b2, b1 - b2).otherwise(b1 - b2 + 360)


def distance_to_bearing(b1: Column, b2: Column) -> Column:
    """The smaller gap; equal bearings give 360."""
    return F.least(positive_distance_to_bearing(b1, b2), negative_distance_to_bearing(b1, b2))


def door_open(doors: Sequence[Column]) -> Column:
    """Any door column set; null counts as closed."""
    return reduce(lambda a, b: a | b, (F.coalesce(d.cast("double"), F.lit(0.0)) != 0 for d in doors))


def ratio(high: Column, low: Column) -> Column:
    """high / low where a zero below gives infinity, or NaN if both are zero."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    zero = F.when(high == 0, nan).when(high > 0, inf).when(high < 0, -inf)
    return F.when(low == 0, zero).otherwise(F.try_divide(high, low))


def event_at(value: Column) -> Column:
    """Number yyMMddHHmmss -> timestamp without zone; null where it is none. Needs a UTC session."""
    digits = F.lpad(value.try_cast("decimal(12,0)").cast("string"), 12, "0")
    return F.try_to_timestamp(digits, F.lit("yyMMddHHmmss")).cast("timestamp_ntz")
