"""Points in an area, or near it, whatever the number of its corners: cells of a grid are wholly in, wholly out, or on the
border, and only points of border cells are held against walls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WALL = ["x1", "y1", "x2", "y2"]


def walls_of(spark: SparkSession, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """The sides of a ring that the driver has, closed or not."""
    sides = [(*map(float, a), *map(float, b)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if tuple(a) != tuple(b)]
    return spark.createDataFrame(sides, ", ".join(f"{c} double" for c in WALL))


def ring_walls(corners: DataFrame) -> DataFrame:
    """The sides of a ring given as a table of corners (i from 0, x, y), of any length."""
    n = corners.agg(F.max("i").alias("_last"))
    following = corners.join(F.broadcast(n)).select(F.when(F.col("i") == 0, F.col("_last")).otherwise(F.col("i") - 1).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))  # one row
    sides = corners.select("i", F.col("x").alias("x1"), F.col("y").alias("y1")).join(following, "i").drop("i")
    return sides.filter("x1 <> x2 OR y1 <> y2")


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def bands(walls: DataFrame, cell: float) -> DataFrame:
    """Walls with every band _j of height cell that they are in."""
    return walls.withColumn("_j", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))


def border_cells(walls: DataFrame, reach: float, cell: float) -> DataFrame:
    """Walls with every cell (_i, _j) that may have a point within reach of them, band by band along the wall."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = walls.withColumn("_j", _cells(low - reach, high + reach, cell))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = lambda y: F.col("x1") + slope * (F.least(high, F.greatest(low, y)) - F.col("y1"))
    ends = (at(F.col("_j") * cell - reach), at((F.col("_j") + 1) * cell + reach))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(*ends))
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(*ends))
    return rows.withColumn("_i", _cells(left - reach, right + reach, cell))


def _odd(rows: DataFrame, walls: DataFrame, key: list[str], x: Column, y: Column) -> DataFrame:
    """The keys of rows (with _j) whose ray to the right meets an odd number of walls of the band."""
    cross = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    return rows.join(walls, "_j").filter(cross).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").drop("_n")


def within_area(points: DataFrame, walls: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """The rows of points (x, y) inside the walls (even-odd, so holes may be among them) or within reach of one. Rows
    without a place are out. No walls: none."""
    cell = cell or max(reach, 1.0)
    xy = points.select("x", "y").dropna().distinct().withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    by_band, by_cell = bands(walls, cell), border_cells(walls, reach, cell)
    border = by_cell.select("_i", "_j").distinct()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    off = F.hypot(F.col("x1") + t * dx - F.col("x"), F.col("y1") + t * dy - F.col("y"))
    near = xy.join(by_cell, ["_i", "_j"]).filter(off <= reach).select("x", "y")
    inside = _odd(xy.join(border, ["_i", "_j"], "left_semi"), by_band, ["x", "y"], F.col("x"), F.col("y"))
    clear = xy.join(border, ["_i", "_j"], "left_anti")
    filled = _odd(clear.select("_i", "_j").distinct(), by_band, ["_i", "_j"], (F.col("_i") + 0.5) * cell, (F.col("_j") + 0.5) * cell)
    kept = near.unionByName(inside).unionByName(clear.join(filled, ["_i", "_j"], "left_semi").select("x", "y"))
    return points.join(kept, ["x", "y"], "left_semi").select(points.columns)
