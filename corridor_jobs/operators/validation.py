"""Heading ranges against submitted bus headings, and the rows behind review maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import asserted_many_to_one, asserted_unique
from .network import DIRECTIONS

RANGE_COLUMNS = [f"{d}_{t}" for d in DIRECTIONS for t in ("min", "max")]


def ranges_long(wide: DataFrame) -> DataFrame:
    """TspAssetID, direction, type, bearing: the eight range columns unpivoted, repeats and null ids dropped."""
    long = wide.unpivot(["TspAssetID"], RANGE_COLUMNS, "bearing_type", "bearing").distinct().dropna(subset=["TspAssetID"])
    parts = F.split("bearing_type", "_")
    return long.select("TspAssetID", parts[0].alias("direction"), parts[1].alias("type"), "bearing")


def ranges_by_direction(long: DataFrame) -> DataFrame:
    """TspAssetID, direction, min, max; without null bearings."""
    return long.dropna(subset=["bearing"]).groupBy("TspAssetID", "direction").pivot("type", ["min", "max"]).agg(F.first("bearing"))


def match_headings(ranges: DataFrame, headings: DataFrame) -> DataFrame:
    """Full outer join of ranges and distinct headings on signal and direction. Fails if a range repeats."""
    sent = headings.select("TspAssetID", "Heading", "direction", "Route", "Intersection", "Name").distinct()
    return asserted_unique(ranges, ["TspAssetID", "direction"]).join(sent, ["TspAssetID", "direction"], "full")


def _wrapped(h: Column, low: Column, high: Column) -> Column:
    return F.when(low <= high, (h >= low) & (h <= high)).otherwise((h >= low) | (h <= high))


def heading_flags(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds error, success and heading_available.

    As in the reference work, error asks for a heading that is neither above min nor below max; a plain range (min <
    max) cannot give one, only a range through north can. strict asks whether the heading lies in the range clockwise
    from min to max.
    """
    h, low, high = F.col("Heading"), F.col("min"), F.col("max")
    known = h.isNotNull() & low.isNotNull() & high.isNotNull()
    out = ~_wrapped(h, low, high) if strict else ~(h > low) & ~(h < high)
    error = F.coalesce(known & out, F.lit(False))
    return df.withColumns({"error": error, "success": known & ~error, "heading_available": h.isNotNull()})


def success_rate(df: DataFrame) -> DataFrame:
    """One row: headings in error or without a range count against those available; null if there are none."""
    n = F.count_if(F.col("heading_available"))
    return df.agg(F.try_divide(F.count_if(F.col("success") & F.col("heading_available")), n).alias("success_rate"))


def heading_errors(df: DataFrame) -> DataFrame:
    return df.filter("error")


def headings_without_success(df: DataFrame) -> DataFrame:
    return df.filter("heading_available AND NOT success")


def success_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("success").agg(F.count(F.lit(1)).alias("n_rows"))


def signals_missing_ranges(df: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Distinct signals with a heading, no success and no error; with x and y where places (TspAssetID, x, y) has them."""
    rows = df.filter("heading_available AND NOT success AND NOT error").select("Name", "TspAssetID").distinct()
    return rows if places is None else asserted_many_to_one(rows, places.select("TspAssetID", "x", "y"), ["TspAssetID"])


def signal_rows(df: DataFrame, signal: int) -> DataFrame:
    return df.filter(F.col("TspAssetID") == signal)


def corrected_long(wide: DataFrame) -> DataFrame:
    """One row per signal and direction that has both bounds, from the eight columns of corrected ranges."""
    each = F.array(
        *(
            F.struct(F.lit(d).alias("direction"), F.col(f"{d}_min").alias("bearing_lower_bound"), F.col(f"{d}_max").alias("bearing_upper_bound"))
            for d in DIRECTIONS
        )
    )
    rows = wide.select("TspAssetID", "osmid", "Name", "x", "y", F.inline(each))
    return rows.dropna(subset=["bearing_lower_bound", "bearing_upper_bound"])


def _back(x: Column, y: Column, degrees: Column, metres: float) -> Column:
    r = F.radians(degrees)
    return F.struct((x - F.sin(r) * metres).alias("x"), (y - F.cos(r) * metres).alias("y"))


def validation_triangles(df: DataFrame, draw_m: float = 100) -> DataFrame:
    """Adds triangle, in metres as x and y must be: the origin (x, y), and the points draw_m back along the lower and the upper bound."""
    x, y = F.col("x"), F.col("y")
    corners = [F.struct(x.alias("x"), y.alias("y")), _back(x, y, F.col("bearing_lower_bound"), draw_m), _back(x, y, F.col("bearing_upper_bound"), draw_m)]
    return df.withColumn("triangle", F.array(*corners))


def in_edge_triangles(edges: DataFrame, draw_m: float = 100) -> DataFrame:
    """validation_triangles() of edges that have both bounds, the origin (x, y) being where the edge arrives: the last point
    of its line from u to v. Edges without a line have none."""
    known = edges.dropna(subset=["bearing_lower_bound", "bearing_upper_bound", "line"])
    end = F.element_at("line", -1)
    return validation_triangles(known.withColumns({"x": end["x"], "y": end["y"]}), draw_m)


def request_lines(headings: DataFrame, signals: DataFrame, request_m: float = 182) -> DataFrame:
    """Headings with the line from their signal to the point request_m back along the heading; null without a signal. Fails
    if a signal repeats."""
    rows = asserted_many_to_one(headings, signals.select("TspAssetID", "x", "y"), ["TspAssetID"])
    here = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
    line = F.array(here, _back(F.col("x"), F.col("y"), F.col("Heading"), request_m))
    return rows.withColumn("line", F.when(F.col("x").isNotNull() & F.col("Heading").isNotNull(), line))


def bounds_tile_circle(edges: DataFrame, slack: float = 1.0) -> DataFrame:
    """Nodes whose in-edges' ranges do not add up to a whole turn, give or take slack per edge; for checks."""
    span = F.pmod(F.col("bearing_upper_bound") - F.col("bearing_lower_bound"), F.lit(360.0))
    sums = edges.dropna(subset=["bearing_lower_bound"]).groupBy("v").agg(F.sum(span).alias("turn"), F.count(F.lit(1)).alias("n"))
    return sums.filter(F.abs(F.col("turn") - 360) > F.col("n") * slack)
