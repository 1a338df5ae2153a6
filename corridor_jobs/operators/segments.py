"""Travel time between timepoints and how it varies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decode_point, ratio
from ..functions.linear import between_measured, measured, project_measured
from .percentiles import weighted_percentiles
from .shared import NULL_PARTS, all_known, checkpointed

TRIP = ["service_date", "shape_id", "feed_key", "trip_id"]
SEGMENT = ["shape_id", "feed_key", "stop_sequence"]
DAY = 86_400


def prior_departure(df: DataFrame) -> DataFrame:
    """Adds the departure from the row before on the same trip and date; null where a key is null. A trip has few rows on a
    date; rows with a null key, of which there may be many, are dealt out, as they have no row before them."""
    apart = F.when(~all_known(TRIP), F.pmod(F.hash("trip_key", "stop_sequence", "stop_id"), F.lit(NULL_PARTS)))
    order = Window.partitionBy(*TRIP, apart).orderBy("trip_key", "stop_sequence", "stop_id", "pt_geom")
    return df.withColumn("prior_departure", F.when(all_known(TRIP), F.lag("actual_departure_pacific").over(order)))


def segment_seconds(df: DataFrame) -> DataFrame:
    """Adds segment_seconds: the seconds field of arrival minus prior departure, without days or fractions; null if negative."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = micros("actual_arrival_pacific") - micros("prior_departure")
    return df.withColumn("segment_seconds", F.when(gap >= 0, F.floor(gap / 1_000_000) % DAY).cast("long"))


def _seconds_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows (n), and how many with a trip_id (n_trips), by key, date and whole seconds: at most a day of seconds
    a key and date, summed before the shuffle, however many rows there are. Percentiles, counts and dates all follow."""
    rows = df.dropna(subset=list(keys)).groupBy(*keys, "service_date", "segment_seconds")
    return checkpointed(rows.agg(F.count(F.lit(1)).alias("n"), F.count("trip_id").alias("n_trips")))


def _variability(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    spread = weighted_percentiles(counts, keys, "segment_seconds", "n", {"p80_travel_time_seconds": 0.8, "p20_travel_time_seconds": 0.2})
    rows = counts.select(*keys).distinct().join(spread, list(keys), "left")
    return rows.withColumn("travel_time_variability", ratio(F.col("p80_travel_time_seconds"), F.col("p20_travel_time_seconds")))


def travel_time_variability(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """80th and 20th percentile of segment_seconds (linear interpolation, exact) and their ratio by segment."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys, "segment_seconds").agg(F.count(F.lit(1)).alias("n"))
    return _variability(checkpointed(counts), keys)


def segment_counts(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Rows with a trip_id, and distinct dates, by segment."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("trip_id").alias("n_rt_trips"), F.count_distinct("service_date").alias("n_service_dates"))


def segment_report(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Variability and counts by segment from one aggregation of the rows; extra keys (such as a part of the day) may be
    added. Keys without null only."""
    counts = _seconds_counts(df, keys)
    trips = counts.groupBy(*keys).agg(F.sum("n_trips").alias("n_rt_trips"))
    dates = counts.select(*keys, "service_date").dropna().distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_service_dates"))
    rows = _variability(counts, keys).join(trips, list(keys)).join(dates, list(keys), "left").withColumn("n_service_dates", F.coalesce("n_service_dates", F.lit(0)))
    return rows.select(*keys, "travel_time_variability", "p80_travel_time_seconds", "p20_travel_time_seconds", "n_rt_trips", "n_service_dates")


def arrivals_per_day(df: DataFrame) -> DataFrame:
    """Non-null arrivals by date, most first."""
    day = F.to_date("actual_arrival_pacific").alias("arrival_date")
    return df.filter("actual_arrival_pacific IS NOT NULL").groupBy(day).agg(F.count(F.lit(1)).alias("n_arrivals")).orderBy(F.desc("n_arrivals"), "arrival_date")


def shape_date_validity(df: DataFrame) -> DataFrame:
    """First, last, number and list of service dates by shape and feed. Dates are collected once."""
    days = df.dropna(subset=["shape_id", "feed_key"]).groupBy("shape_id", "feed_key").agg(F.array_sort(F.collect_set("service_date")).alias("_d"))
    return days.select(
        "shape_id",
        "feed_key",
        F.array_min("_d").alias("first_service_date"),
        F.array_max("_d").alias("last_service_date"),
        F.size("_d").cast("long").alias("n_service_dates"),
        F.array_join(F.transform("_d", lambda d: d.cast("string")), ", ").alias("service_dates"),
    )


def rt_trip_counts(df: DataFrame) -> DataFrame:
    """shape_id, n_rt_trips: distinct (feed, date, trip) of each shape."""
    trips = df.select("shape_id", "feed_key", "service_date", "trip_id").distinct()
    return trips.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_rt_trips"))


def with_rt_trip_counts(validity: DataFrame, counts: DataFrame) -> DataFrame:
    return validity.join(counts, "shape_id", "left")


def covers_all_target_dates(validity: DataFrame, n_target_dates: int) -> DataFrame:
    return validity.withColumn("covers_all_target_dates", F.col("n_service_dates") == n_target_dates)


def timepoint_list(df: DataFrame) -> DataFrame:
    """Distinct timepoints of each shape and feed, with their point decoded."""
    rows = df.select("shape_id", "feed_key", "stop_sequence", "stop_id", "pt_geom").distinct()
    return rows.withColumn("point", decode_point(F.col("pt_geom")))


def projected_timepoints(timepoints: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds line (measured, once for each shape) and distance, the timepoint's distance along it."""
    ways = lines.select("shape_id", "feed_key", measured(F.col("line")).alias("line"))
    rows = timepoints.join(ways, ["shape_id", "feed_key"], "left")
    return rows.withColumn("distance", project_measured(F.col("line"), F.col("point.x"), F.col("point.y")))


def prior_distance(df: DataFrame) -> DataFrame:
    """Adds the distance of the timepoint before, by stop_sequence."""
    order = Window.partitionBy("shape_id", "feed_key").orderBy("stop_sequence", "stop_id", "pt_geom")
    return df.withColumn("prior_distance", F.lag("distance").over(order))


def segment_lines(df: DataFrame) -> DataFrame:
    """Adds segment, the line from the timepoint back to the one before."""
    return df.withColumn("segment", between_measured(F.col("line"), F.col("distance"), F.col("prior_distance")))


def segment_map_rows(segments: DataFrame, report: DataFrame, excluded_sequence: int | None = 2) -> DataFrame:
    """Segments with their report, without one stop_sequence that is known to be off. Null sequences stay."""
    rows = segments.join(report, SEGMENT, "left")
    return rows if excluded_sequence is None else rows.filter(~F.col("stop_sequence").eqNullSafe(excluded_sequence))


def corridor_variability(df: DataFrame) -> DataFrame:
    """Seconds from first departure to last arrival of each trip, and their spread by shape and feed."""
    order = F.struct("stop_sequence", "stop_id", "pt_geom")
    trips = df.dropna(subset=TRIP).groupBy(*TRIP).agg(
        F.min_by("actual_departure_pacific", order).alias("prior_departure"), F.max_by("actual_arrival_pacific", order).alias("actual_arrival_pacific")
    )
    return travel_time_variability(segment_seconds(trips), ["shape_id", "feed_key"])


def with_day_part(df: DataFrame, bounds: Sequence[int] = (6, 10, 15, 19)) -> DataFrame:
    """Adds day_part, the number of bounds (hours) that the arrival has reached; a further key for segment_report."""
    hour = F.hour("actual_arrival_pacific")
    return df.withColumn("day_part", sum((F.when(hour >= b, 1).otherwise(0) for b in bounds), F.lit(0)))
