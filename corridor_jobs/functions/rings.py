"""EPSG:2229 feet to degrees, for the corners of a study area."""

from __future__ import annotations

import math

# Fixed values of EPSG:2229 (Lambert conformal conic on GRS80, US survey feet).
_FOOT = 1200 / 3937
_LAT0, _LON0, _SP1, _SP2 = 33.5, -118.0, 34 + 2 / 60, 35 + 28 / 60
_X0, _Y0 = 2000000.0001016, 500000.0001016
_A, _F = 6378137.0, 1 / 298.257222101
_E = math.sqrt(_F * (2 - _F))


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def feet_to_degrees(x: float, y: float) -> tuple[float, float]:
    """EPSG:2229 feet -> (longitude, latitude)."""
    m = [math.cos(p) / math.sqrt(1 - (_E * math.sin(p)) ** 2) for p in map(math.radians, (_SP1, _SP2))]
    t0, t1, t2 = (_t(math.radians(p)) for p in (_LAT0, _SP1, _SP2))
    n = (math.log(m[0]) - math.log(m[1])) / (math.log(t1) - math.log(t2))
    f = m[0] / (n * t1**n)
    rho0 = _A * f * t0**n
    dx, dy = x * _FOOT - _X0, rho0 - (y * _FOOT - _Y0)
    rho = math.copysign(math.hypot(dx, dy), n)
    t = (rho / (_A * f)) ** (1 / n)
    lat = math.pi / 2 - 2 * math.atan(t)
    for _ in range(8):
        s = _E * math.sin(lat)
        lat = math.pi / 2 - 2 * math.atan(t * ((1 - s) / (1 + s)) ** (_E / 2))
    return math.degrees(math.atan2(dx, dy) / n) + _LON0, math.degrees(lat)
