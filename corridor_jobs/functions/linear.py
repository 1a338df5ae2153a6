"""Line referencing on vertex arrays in built-in expressions: no Python runs on the executors.

A line is an array of struct(x, y). Measured, it is an array of struct(x, y, m), m being the distance along it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERTEX = "array<struct<x:double,y:double,m:double>>"


def _usable(line: Column) -> Column:
    return line.isNotNull() & (F.size(line) > 1)


def measured(line: Column) -> Column:
    """The line with the distance along it at each vertex, by one running sum; null for null and for fewer than two
    points. Lines are measured once each, before they meet their points."""

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        m = last["m"] + F.hypot(p["x"] - last["x"], p["y"] - last["y"])
        return F.concat(done, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), m.alias("m"))))

    first = F.array(F.struct(line[0]["x"].alias("x"), line[0]["y"].alias("y"), F.lit(0.0).alias("m"))).cast(_VERTEX)
    return F.when(_usable(line), F.aggregate(F.slice(line, 2, F.size(line)), first, add))


def _let(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of the values, each of which is then evaluated once however often f names it."""
    return F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), f)[0]


def project_measured(line: Column, x: Column, y: Column) -> Column:
    """Distance along a measured line of its point nearest to (x, y); the first leg of equals. Null without line or point."""

    def foot(a: Column, b: Column, p: Column) -> Column:
        """off and m of the leg's point nearest to p."""
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = _let(lambda v: F.when(v["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["dot"] / v["size"]))).otherwise(0.0), dot=(p["px"] - a["x"]) * dx + (p["py"] - a["y"]) * dy, size=dx * dx + dy * dy)
        return _let(
            lambda v: F.struct(F.hypot(a["x"] + v["t"] * dx - p["px"], a["y"] + v["t"] * dy - p["py"]).alias("off"), (a["m"] + v["t"] * F.sqrt(dx * dx + dy * dy)).alias("m")),
            t=along,
        )

    def best(p: Column) -> Column:
        start = F.struct(F.lit(float("inf")).alias("off"), F.lit(None).cast("double").alias("m"))
        legs = F.transform(F.slice(p["line"], 2, F.size(p["line"])), lambda b, i: foot(p["line"][i], b, p))
        return F.aggregate(legs, start, lambda s, leg: F.when(leg["off"] < s["off"], leg).otherwise(s), lambda s: s["m"])

    return _let(lambda p: F.when(_usable(p["line"]) & p["px"].isNotNull() & p["py"].isNotNull(), best(p)), line=line, px=x, py=y)


def _at(line: Column, d: Column) -> Column:
    """The point at a distance within the line: the last vertex not beyond it, and on towards the next."""

    def on(v: Column) -> Column:
        a, b = v["a"], v["b"]
        share = F.when(b["m"] > a["m"], (d - a["m"]) / (b["m"] - a["m"])).otherwise(0.0)
        return F.struct((a["x"] + share * (b["x"] - a["x"])).alias("x"), (a["y"] + share * (b["y"] - a["y"])).alias("y"))

    place = F.size(F.filter(line, lambda p: p["m"] <= d))
    return _let(lambda v: _let(on, a=line[v["i"] - 1], b=line[F.least(v["i"], F.size(line) - 1)]), i=place)


def between_measured(line: Column, start: Column, end: Column) -> Column:
    """The part of a measured line between two distances, reversed if start > end; one point if they are equal. Distances
    off the line count as its ends. Null where line, start or end is null."""
    clip = lambda d, v: F.greatest(F.lit(0.0), F.least(d, F.element_at(v["line"], -1)["m"]))

    def part(v: Column) -> Column:
        inner = F.transform(F.filter(v["line"], lambda p: (p["m"] > v["lo"]) & (p["m"] < v["hi"])), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        first = F.array(_at(v["line"], v["lo"]))
        return F.when(v["hi"] > v["lo"], F.concat(first, inner, F.array(_at(v["line"], v["hi"])))).otherwise(first)

    def turned(v: Column) -> Column:
        lo, hi = F.least(v["start"], v["end"]), F.greatest(v["start"], v["end"])
        whole = _let(part, line=v["line"], lo=clip(lo, v), hi=clip(hi, v))
        way = _let(lambda w: F.when(w["back"], F.reverse(w["points"])).otherwise(w["points"]), points=whole, back=v["start"] > v["end"])
        return F.when(_usable(v["line"]) & v["start"].isNotNull() & v["end"].isNotNull(), way)

    return _let(turned, line=line, start=start, end=end)


def project_on_line(line: Column, x: Column, y: Column) -> Column:
    """Planar distance along the line, in its own units (degrees for degrees); null without a line or point."""
    return project_measured(measured(line), x, y)


def segment_geometry(line: Column, start: Column, end: Column) -> Column:
    """Sub-line from start to end; null where either is null."""
    return between_measured(measured(line), start, end)
