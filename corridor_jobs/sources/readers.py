"""Readers of the service warehouse, ping, signal and street files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rings import feet_to_degrees
from ..operators.avl import DOORS

SIGNALS = "TspAssetID int, Name string, Lat double, Long double, IPHostAddress string"
HEADINGS = ["Intersection", "Route Direction", "Heading", "Route", "Name"]


def read_mart(spark: SparkSession, root: str, table: str, filters: Mapping[str, Sequence] | None = None) -> DataFrame:
    """A warehouse table (Parquet), restricted to some values of its partition or key columns so that the scan is pruned."""
    df = spark.read.parquet(f"{root}/{table}")
    for column, values in (filters or {}).items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. Spark's reader takes a byte-order mark for part of the first name; it is cut off."""
    df = spark.read.csv(path, header=True, multiLine=False)
    return df.toDF(*(c.lstrip("﻿").strip("\r") for c in df.columns))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals with coordinates. Columns are taken by name."""
    df = _csv(spark, path)
    kinds = [f.strip().split(" ") for f in SIGNALS.split(",")]
    return df.select(*(F.col(n).try_cast(t).alias(n) for n, t in kinds)).dropna(subset=["Lat", "Long"])


def read_avl(spark: SparkSession, path: str) -> DataFrame:
    """Pings. A line that is no ping (the second of each file: units or a rule) has an EVENT_TIME that is no number and
    is dropped; pings without EVENT_TIME stay."""
    return _avl(spark, path, None)


def read_avl_counted(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """read_avl(), and what it drops: once a job has read the pings to their end, get of the observation has n_lines,
    n_blank and n_rejected (EVENT_TIME that is no number). The lines are read once, for both."""
    counts = Observation("avl")
    return _avl(spark, path, counts), counts


def _avl(spark: SparkSession, path: str, counts: Observation | None) -> DataFrame:
    df = _csv(spark, path)
    time = F.col("EVENT_TIME").try_cast("double")
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    no_time = F.col("EVENT_TIME").isNotNull() & time.isNull()
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(no_time & ~blank).alias("n_rejected"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return df.filter(~no_time & ~blank).select("ROUTE_ID", F.col("TRIP_KEY").try_cast("int").alias("TRIP_KEY"), time.alias("EVENT_TIME"), number("LONGITUDE"), number("LATITUDE"), *map(number, DOORS))


def with_heading_keys(df: DataFrame) -> DataFrame:
    """Adds TspAssetID, from the 14th character of Intersection on, and direction, the first word of Route Direction."""
    return df.withColumns(
        {
            "TspAssetID": F.expr("substring(Intersection, 14)").try_cast("int"),
            "direction": F.lower(F.split("Route Direction", " ")[0]),
        }
    )


def read_headings(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path).select(*HEADINGS)
    return with_heading_keys(df.withColumn("Heading", F.col("Heading").try_cast("double")))


def read_corrected_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Corrected ranges; review columns and an unnamed last column are left out."""
    df = _csv(spark, path)
    sides = [f"{d}_{t}" for d in ("north", "south", "east", "west") for t in ("min", "max")]
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return df.select(F.col("TspAssetID").try_cast("int").alias("TspAssetID"), F.col("osmid").try_cast("long").alias("osmid"), "Name", number("y"), number("x"), *map(number, sides))


def read_boundary(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The outer ring of a one-feature GeoJSON polygon in EPSG:2229, in EPSG:3310 metres; a few hundred points."""
    from ..functions.columns import albers

    ring = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f")).select(F.col("f.geometry.coordinates")[0].alias("r"))
    points = [feet_to_degrees(float(p[0]), float(p[1])) for p in ring.first().r]
    x, y = albers(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lon double, lat double")
    return [(r.x, r.y) for r in rows.select("i", x.alias("x"), y.alias("y")).orderBy("i").collect()]


def read_street_network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (osmid, lon, lat, and x, y in metres) and edges (u, v, key, name) of a street network kept as two tables."""
    from ..functions.columns import albers

    n = spark.read.parquet(nodes).select("osmid", F.col("x").alias("lon"), F.col("y").alias("lat"))
    x, y = albers(F.col("lon"), F.col("lat"))
    return n.withColumns({"x": x, "y": y}), spark.read.parquet(edges).select("u", "v", "key", "name")
