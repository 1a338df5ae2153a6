"""Schedule and realtime stop times at timepoints."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import semi, small

RESULT = [
    "service_date",
    "trip_id",
    "trip_key",
    "stop_id",
    "feed_key",
    "shape_id",
    "stop_sequence",
    "actual_arrival_pacific",
    "actual_departure_pacific",
    "n_predictions",
    "pt_geom",
]


def stop_times_in_feeds(stop_times: DataFrame, entries: DataFrame, dates: Sequence[date]) -> DataFrame:
    """The five columns used of the stop times of some feeds (entries: feed_key, _valid_from), pruned by the partition
    column _feed_valid_from while they are scanned. Feeds that begin after the last of the dates are in effect on none."""
    begun = entries.filter(F.col("_valid_from") < F.lit(max(dates) + timedelta(days=1)))
    rows = semi(semi(stop_times, begun, {"_feed_valid_from": "_valid_from"}), begun, {"feed_key": "feed_key"})
    return rows.select("feed_key", "stop_id", "trip_id", "timepoint", "stop_sequence")


def valid_trips(trips: DataFrame, feed_dates: DataFrame, dates: Sequence[date], chosen: DataFrame) -> DataFrame:
    """Trips of the chosen shapes (shape_id) on each date, only with the feed in effect on it (feed_dates)."""
    rows = semi(trips.filter(F.col("service_date").isin(list(dates))), feed_dates, {"service_date": "service_date", "feed_key": "feed_key"})
    return semi(rows, chosen, {"shape_id": "shape_id"}).select("service_date", "feed_key", "trip_id", "shape_id", "direction_id")


def trip_stop_times(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """The one large join, on (trip_id, feed_key); a trip counts once for each date it runs. Both summaries read it."""
    return stop_times.join(trips.select("trip_id", "feed_key", "shape_id"), ["trip_id", "feed_key"])


def stop_counts(joined: DataFrame) -> DataFrame:
    """n_timepoint and n_stop_times by stop, shape and sequence: few rows, from which both summaries follow."""
    return joined.groupBy("stop_id", "shape_id", "stop_sequence").agg(F.sum("timepoint").alias("n_timepoint"), F.count(F.lit(1)).alias("n_stop_times"))


def summary_of_counts(counts: DataFrame) -> DataFrame:
    """timepoint_summary() of the same stop times, from their stop_counts()."""
    return counts.groupBy("stop_id", "shape_id").agg(F.sum("n_timepoint").alias("n_timepoint"), F.sum("n_stop_times").alias("n_stop_times"))


def stops_in_feeds(stops: DataFrame, dates: Sequence[date], feed_keys: DataFrame) -> DataFrame:
    """Stops of these dates and feeds."""
    return semi(stops.filter(F.col("service_date").isin(list(dates))), feed_keys, {"feed_key": "feed_key"})


def timepoint_summary(joined: DataFrame) -> DataFrame:
    """n_timepoint and n_stop_times by stop and shape. A null timepoint adds nothing to the first."""
    return joined.groupBy("stop_id", "shape_id").agg(F.sum("timepoint").alias("n_timepoint"), F.count(F.lit(1)).alias("n_stop_times"))


def stop_sequences(joined: DataFrame) -> DataFrame:
    """Distinct (stop_id, stop_sequence), whatever the shape."""
    return joined.select("stop_id", "stop_sequence").distinct()


def timepoints_on_route(stops: DataFrame, summary: DataFrame, sequences: DataFrame) -> DataFrame:
    """Stops that are a timepoint on every trip, with the least pt_geom of each.

    A stop on two shapes carries the sequences of both, as the join is by stop alone. stops is brought down to one row
    a stop first, so that its dates do not multiply.
    """
    places = stops.groupBy("stop_id").agg(F.min("pt_geom").alias("pt_geom"))
    always = summary.filter(F.col("n_timepoint") == F.col("n_stop_times"))
    return always.join(places, "stop_id").join(sequences, "stop_id").select("stop_id", "n_timepoint", "n_stop_times", "shape_id", "stop_sequence", "pt_geom")


def rt_stop_times(metrics: DataFrame, feed_dates: DataFrame) -> DataFrame:
    """Realtime rows of the (service_date, schedule_base64_url) in effect; feed_dates has service_date and base64_url. These
    pairs are counted: rows of so few keys are not to meet in a task for each."""
    pairs = feed_dates.select("service_date", F.col("base64_url").alias("schedule_base64_url")).distinct()
    return metrics.join(small(pairs), ["service_date", "schedule_base64_url"])


def schedule_rt_stop_times(rt: DataFrame, trips: DataFrame, timepoints: DataFrame, match_on: str | None = None) -> DataFrame:
    """Realtime rows with their trip and timepoint.

    The timepoint is matched by stop_sequence and shape_id, so that a row may meet several stops; stop_id is that of the
    realtime row. match_on="stop_id" asks for the same stop too. timepoints is counted; where it is small, a row meets its
    stops in place, and the rows, by then several times as many, still lie together by date and trip.
    """
    keys = ["stop_sequence", "shape_id"] + ([match_on] if match_on else [])
    with_trip = rt.join(trips.select("service_date", "trip_id", "feed_key", "shape_id"), ["service_date", "trip_id"])
    return with_trip.join(small(timepoints.select(*keys, "pt_geom")), keys).select(*RESULT)
