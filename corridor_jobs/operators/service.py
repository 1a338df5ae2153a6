"""Route, feed and shape selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decode_line
from .checks import asserted, asserted_many_to_one, asserted_one_to_one
from .shared import semi

MIN_TRIPS = 10


def feeds_on_dates(feeds: DataFrame, dates: Sequence[date], dataset_name: str) -> DataFrame:
    """feed_key, service_date: the feed of a dataset on each target date."""
    on = F.col("date").isin(list(dates)) & (F.col("gtfs_dataset_name") == dataset_name)
    return feeds.filter(on).select("feed_key", F.col("date").alias("service_date"))


def route_shape_counts(trips: DataFrame, dates: Sequence[date], route_short_name: str) -> DataFrame:
    """Trips (ct) by date, shape, route and feed, of one route on the target dates."""
    on = F.col("service_date").isin(list(dates)) & (F.col("route_short_name") == route_short_name)
    keys = ["service_date", "shape_id", "route_id", "route_short_name", "feed_key"]
    return trips.filter(on).groupBy(*keys).agg(F.count(F.lit(1)).alias("ct"))


def feed_shapes(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Feeds left-joined to counts; dates on which the route did not run have null shape_id. See by_trips() for the order."""
    return feeds.join(counts, ["feed_key", "service_date"], "left")


def by_trips(df: DataFrame) -> DataFrame:
    """Most trips first, for a last step: in mid-plan the order would be lost again."""
    return df.orderBy(F.desc_nulls_last("ct"))


def drop_unserved_dates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("shape_id").isNotNull())


def feed_dates(df: DataFrame) -> DataFrame:
    """Distinct (service_date, feed_key); taken before the minimum of trips is applied."""
    return df.select("service_date", "feed_key").distinct()


def total_trips_per_shape(df: DataFrame) -> DataFrame:
    """ct becomes the sum over all rows of the shape, whatever the feed."""
    return df.withColumn("ct", F.sum("ct").over(Window.partitionBy("shape_id")))


def latest_per_shape(df: DataFrame) -> DataFrame:
    """The last service_date of each (shape_id, feed_key), as last_seen_date; ties go to the least route_id."""
    latest = Window.partitionBy("shape_id", "feed_key").orderBy(F.desc("service_date"), "route_id")
    rows = df.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    return rows.withColumnRenamed("service_date", "last_seen_date")


def min_trips(df: DataFrame, n: int = MIN_TRIPS) -> DataFrame:
    return df.filter(F.col("ct") >= n)


def shape_geometry(shapes: DataFrame, dates: Sequence[date], feed_keys: DataFrame, chosen: DataFrame) -> DataFrame:
    """One point array per (shape_id, feed_key), of the latest of the last-seen dates of the chosen shapes (shape_id,
    last_seen_date), all of them among dates. Keys stay on the executors; the last-seen dates prune the scan's partitions."""
    seen = chosen.filter(F.col("last_seen_date").isin(list(dates)))
    rows = semi(shapes.filter(F.col("service_date").isin(list(dates))), seen, {"service_date": "last_seen_date"})
    rows = semi(semi(rows, feed_keys, {"feed_key": "feed_key"}), chosen, {"shape_id": "shape_id"})
    latest = Window.partitionBy("shape_id", "feed_key").orderBy(F.desc("service_date"))
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select("shape_id", "feed_key", "pt_array")


def attach_geometry(shapes: DataFrame, geometry: DataFrame) -> DataFrame:
    """Shapes that have points. Fails if a (shape_id, feed_key) repeats on either side."""
    return asserted_one_to_one(shapes, geometry, ["shape_id", "feed_key"]).dropna(subset=["pt_array"])


def with_lines(shapes: DataFrame) -> DataFrame:
    """Adds line, the decoded pt_array."""
    return shapes.withColumn("line", decode_line(F.col("pt_array")))


def feed_entries(dim_feeds: DataFrame, feed_keys: DataFrame) -> DataFrame:
    """feed_key, base64_url, _valid_from of each feed; fails if one has no entry, or more than one."""
    found = semi(dim_feeds, feed_keys, {"key": "feed_key"}).select(F.col("key").alias("feed_key"), "base64_url", "_valid_from")
    every = asserted_many_to_one(feed_keys.select("feed_key").distinct(), found.withColumn("_found", F.lit(True)), ["feed_key"])
    return asserted(every, F.col("_found"), "a feed without entry").drop("_found")


def attach_feed_entry(dates: DataFrame, entries: DataFrame) -> DataFrame:
    """Inner join on feed_key; fails if an entry repeats. Entries are few (one a feed); Spark broadcasts them by their size."""
    return asserted_many_to_one(dates, entries, ["feed_key"], "inner")
