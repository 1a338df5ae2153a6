from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.functions import columns as C
from corridor_jobs.operators import avl


def test_event_times(spark):
    df = spark.createDataFrame([(240301080910.0,), (9.0,), (None,), (241399000000.0,)], "EVENT_TIME double")
    done = avl.parse_event_time(df)
    assert [r.event_at for r in done.collect()] == [datetime(2024, 3, 1, 8, 9, 10), None, None, None]
    assert tuple(avl.unparsed_event_times(done).first()) == (4, 3)


def test_gaps_follow_time_not_rows_and_nulls_come_last(spark):
    rows = [(1, 1, datetime(2024, 1, 1, 0, 1)), (2, 1, datetime(2024, 1, 1)), (3, 1, None), (4, None, datetime(2024, 1, 1)), (5, 1, datetime(2024, 1, 1, 0, 1, 29, 500000))]
    got = {r.id: r.gap_seconds for r in avl.ping_gaps(spark.createDataFrame(rows, "id int, TRIP_KEY int, event_at timestamp_ntz")).collect()}
    assert got == {1: 60.0, 2: None, 3: None, 4: None, 5: 29.5}


def test_histogram_closes_its_last_bin_and_lists_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    assert [r.n_rows for r in avl.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.n_rows for r in avl.histogram(same, "v", 2).orderBy("bin").collect()] == [0, 2]
    assert avl.histogram(df.filter("v > 99"), "v", 5).isEmpty()


def test_gap_bound_is_open(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (None,)], "gap_seconds double")
    assert [r[0] for r in avl.within_gap(df).collect()] == [29.9]


def test_projection_matches_the_formula_worked_by_hand(spark):
    x, y = C.albers(F.lit(-118.404851), F.lit(34.017122))
    got = spark.range(1).select(x, y).first()
    assert tuple(got) == pytest.approx((147328.594, -443028.316), abs=0.01)


def test_near_point_and_azimuth(spark):
    rows = [(1, " 104 ", 0.0, 199.9), (2, "104", 0.0, 200.0), (3, "105", 0.0, 1.0), (4, "104", 100.0, 0.0), (5, "104", -1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, ROUTE_ID string, x double, y double")
    near = avl.with_azimuth(avl.near_point(avl.with_distance(df, 0.0, 0.0)), 0.0, 0.0)
    got = {r.id: r.azimuth_to_signal for r in near.collect()}
    assert got == pytest.approx({1: 0.0, 4: 90.0, 5: 315.0})  # from the signal to the bus
    assert {r.id for r in avl.ahead_of_signal(near).collect()} == {1, 4}


def test_doors_and_dwell(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(7, at(0), None, None, None, None), (7, at(1), 1.0, None, 0.0, None), (7, at(4), None, 2.0, None, None), (7, at(5), 0.0, 0.0, 0.0, 0.0), (7, at(9), 1.0, None, None, None)]
    names = ", ".join(f"{d} double" for d in avl.DOORS)
    df = avl.with_door_open(spark.createDataFrame(rows, f"TRIP_KEY int, event_at timestamp_ntz, {names}"))
    assert [r.door_open for r in df.orderBy("event_at").collect()] == [False, True, True, False, True]
    assert sorted((r.n_pings, r.dwell_seconds) for r in avl.dwells(df).collect()) == [(1, 0.0), (2, 3.0)]


def test_pings_per_route_trip_leaves_out_null_keys(spark):
    df = spark.createDataFrame([("104", 1), ("104", 1), (None, 1), ("104", None)], "ROUTE_ID string, TRIP_KEY int")
    assert [tuple(r) for r in avl.pings_per_route_trip(df).collect()] == [("104_1", 2)]


def test_near_points_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    pings = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 2000, (300, 2)))] + [(900, None, 1.0)]
    signals = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 2000, (20, 2)))] + [(50, pings[0][1], pings[0][2] + 200.0), (51, None, None)]
    got = avl.near_points(spark.createDataFrame(pings, "event_id long, x double, y double"), spark.createDataFrame(signals, "TspAssetID long, x double, y double"))
    want = {(a, b): math.degrees(math.atan2(x - u, y - v)) % 360 for a, x, y in pings for b, u, v in signals if None not in (x, u) and math.hypot(x - u, y - v) < 200}
    rows = {(r.event_id, r.TspAssetID): r.azimuth_to_signal for r in got.collect()}
    assert rows == pytest.approx(want) and len(rows) > 50 and (0, 50) not in rows
