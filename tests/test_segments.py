from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corridor_jobs.functions.columns import ratio
from corridor_jobs.operators import segments

D = date(2024, 3, 4)
T = datetime(2024, 3, 4, 8)
SCHEMA = "service_date date, trip_id string, trip_key string, stop_id string, feed_key string, shape_id string, stop_sequence int, actual_arrival_pacific timestamp_ntz, actual_departure_pacific timestamp_ntz, n_predictions int, pt_geom string"


def row(trip, seq, arrive, depart, shape="a", day=D):
    at = lambda s: None if s is None else T + timedelta(seconds=s)
    return (day, trip, "k" + (trip or ""), f"p{seq}", "f0", shape, seq, at(arrive), at(depart), 1, None)


def seconds(spark, rows):
    df = segments.segment_seconds(segments.prior_departure(spark.createDataFrame(rows, SCHEMA)))
    return {(r.trip_id, r.stop_sequence): r.segment_seconds for r in df.collect()}


def test_seconds_field_without_days_or_fractions_and_no_negative(spark):
    got = seconds(spark, [row("t", 1, 0, 10), row("t", 2, 10 + 86405.9, 20), row("t", 3, 15, 30), row("t", 4, None, 40), row(None, 1, 0, 0), row(None, 2, 9, 9)])
    assert got[("t", 1)] is None
    assert got[("t", 2)] == 5  # one day and 5.9 seconds
    assert got[("t", 3)] is None  # arrival before the departure
    assert got[("t", 4)] is None
    assert got[(None, 2)] is None  # a null key has no row before it


def test_variability_and_counts(spark):
    rows = [r for i, gap in enumerate([10, 20, 30, 40, 50]) for r in (row(f"t{i}", 1, 0, 0), row(f"t{i}", 2, gap, gap))]
    df = segments.segment_seconds(segments.prior_departure(spark.createDataFrame(rows, SCHEMA)))
    r = {x.stop_sequence: x for x in segments.segment_report(df).collect()}
    assert (r[2].p80_travel_time_seconds, r[2].p20_travel_time_seconds, r[2].n_rt_trips, r[2].n_service_dates) == (42.0, 18.0, 5, 1)
    assert r[2].travel_time_variability == pytest.approx(42 / 18)
    assert r[1].p80_travel_time_seconds is None and r[1].n_rt_trips == 5  # rows without a duration count


def test_ratio_with_zero_below(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1] == math.inf and got[2] == 1.5 and got[3] is None


def test_audits(spark):
    rows = [row("t1", 1, 0, 0), row("t1", 2, 0, 0), row("t1", 1, 0, 0, day=date(2024, 3, 6)), row("t2", 1, None, 0, shape="b")]
    df = spark.createDataFrame(rows, SCHEMA)
    v = segments.covers_all_target_dates(segments.with_rt_trip_counts(segments.shape_date_validity(df), segments.rt_trip_counts(df)), 2)
    got = {r.shape_id: (r.service_dates, r.n_rt_trips, r.covers_all_target_dates) for r in v.collect()}
    assert got == {"a": ("2024-03-04, 2024-03-06", 2, True), "b": ("2024-03-04", 1, False)}
    assert [tuple(r) for r in segments.arrivals_per_day(df).collect()] == [(D, 3)]


def test_segment_lines_run_back_and_one_sequence_is_left_out(spark):
    lines = spark.createDataFrame([("a", "f0")], "shape_id string, feed_key string").withColumn("line", F.expr("array(struct(0D AS x, 0D AS y), struct(10D AS x, 0D AS y), struct(10D AS x, 10D AS y))"))
    rows = [("a", "f0", 1, "p1", "POINT(2 1)"), ("a", "f0", 2, "p2", "POINT(9 0)"), ("a", "f0", 3, "p3", "POINT(11 5)")]
    points = spark.createDataFrame(rows, "shape_id string, feed_key string, stop_sequence int, stop_id string, pt_geom string")
    done = segments.segment_lines(segments.prior_distance(segments.projected_timepoints(segments.timepoint_list(points), lines)))
    got = {r.stop_sequence: r for r in done.collect()}
    assert [got[i].distance for i in (1, 2, 3)] == [2.0, 9.0, 15.0]
    assert got[1].segment is None
    assert [tuple(p) for p in got[3].segment] == [(10.0, 5.0), (10.0, 0.0), (9.0, 0.0)]
    report = spark.createDataFrame([("a", "f0", 3, 1.5)], "shape_id string, feed_key string, stop_sequence int, travel_time_variability double")
    assert sorted(r.stop_sequence for r in segments.segment_map_rows(done, report).collect()) == [1, 3]


def test_rows_with_a_null_key_are_dealt_out(spark):
    rows = spark.createDataFrame([row(None, i, 0, 0) for i in range(50)], SCHEMA)
    assert segments.prior_departure(rows).filter("prior_departure IS NOT NULL").isEmpty()


def test_report_counts_rows_trips_and_dates_of_keys_without_durations(spark):
    rows = [row("t1", 1, 0, 0), row("t1", 1, 0, 0, day=date(2024, 3, 5)), row("t2", 1, 0, 0)]
    df = segments.segment_seconds(segments.prior_departure(spark.createDataFrame(rows, SCHEMA)))
    r = segments.segment_report(df).first()
    assert (r.p80_travel_time_seconds, r.travel_time_variability, r.n_rt_trips, r.n_service_dates) == (None, None, 3, 2)
    assert segments.segment_report(df.limit(0)).isEmpty()
