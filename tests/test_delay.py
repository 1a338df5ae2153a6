from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.operators import avl

T0 = datetime(2024, 3, 4, 7, 59)  # tracks go over the hour
EPOCH = (T0 - datetime(1970, 1, 1)).total_seconds()
PINGS = "TRIP_KEY int, event_at timestamp_ntz, x double, y double"
SIGNALS = "TspAssetID int, x double, y double"


def track(trip, *places, start=0.0):
    """Pings at (seconds, x, y)."""
    return [(trip, T0 + timedelta(seconds=start + t), float(x), float(y)) for t, x, y in places]


def found(spark, pings, signals, **more):
    rows = avl.intersection_delay(spark.createDataFrame(pings, PINGS), spark.createDataFrame(signals, SIGNALS), **more)
    return sorted(rows.collect(), key=lambda r: (r.TRIP_KEY, r.TspAssetID, r.entered))


def test_a_bus_that_waits_twenty_seconds(spark):
    """East at 10 m/s, a ping a second; it stands 20 m before the signal for 20 s."""
    x = lambda t: -300 + 10 * t if t < 28 else -20 if t < 48 else -20 + 10 * (t - 48)
    (r,) = found(spark, track(1, *((t, x(t), 3) for t in range(81))), [(7, 0.0, 0.0)])
    half = math.sqrt(100**2 - 3**2)
    assert r.entered - EPOCH == pytest.approx((300 - half) / 10, abs=1e-5) and r.left - EPOCH == pytest.approx(50 + half / 10, abs=1e-5)
    assert r.crossed - EPOCH == pytest.approx(50, abs=1e-5) and r.least_m == pytest.approx(3)
    assert r.seconds == pytest.approx(20 + 2 * half / 10, abs=1e-5) and r.metres == pytest.approx(2 * half)
    assert r.delay_seconds == pytest.approx(r.seconds - 2 * half / avl.FREE_SPEED) and r.comes_from == "west"
    assert r.approach_seconds == pytest.approx(r.crossed - r.entered)


def test_times_between_sparse_pings(spark):
    """Two pings 25 s apart on either side: both crossings lie on one leg."""
    (r,) = found(spark, track(1, (0, 0, 250), (25, 0, -250)), [(7, 0.0, 0.0)])
    assert (r.entered - EPOCH, r.crossed - EPOCH, r.left - EPOCH) == pytest.approx((7.5, 12.5, 17.5), abs=1e-5)
    assert r.comes_from == "north" and r.delay_seconds == 0  # faster than free speed


def test_stays_that_are_cut_are_left_out(spark):
    signal = [(7, 0.0, 0.0)]
    assert found(spark, track(1, (0, 0, 0), (10, 200, 0)), signal) == []  # begins inside
    assert found(spark, track(1, (0, -200, 0), (10, 0, 0)), signal) == []  # ends inside
    assert found(spark, track(1, (0, -150, 0), (10, -50, 0), (60, 50, 0), (70, 150, 0)), signal) == []  # a gap within
    assert found(spark, track(1, (0, -150, 0), (10, -50, 0), (60, 900, 0), (70, 150, 0), (80, 120, 0)), signal) == []  # lost inside
    lost, again = track(1, (0, -150, 0), (10, -50, 0), (60, 300, 0)), track(1, (70, 150, 0), (80, -150, 0))
    assert [r.comes_from for r in found(spark, lost + again, signal)] == ["east"]  # the way back counts


def test_each_passage_of_each_trip_and_signal(spark):
    there, back = [(t, -300 + 20 * t, 0) for t in range(0, 31, 2)], [(t, 300 - 20 * (t - 40), 0) for t in range(40, 71, 2)]
    signals = [(7, 0.0, 0.0), (8, 50.0, 0.0), (9, 5000.0, 0.0), (10, None, None)]
    rows = found(spark, track(1, *there, *back) + track(2, *there, start=3600) + track(None, *there), signals)
    assert [(r.TRIP_KEY, r.TspAssetID, r.comes_from) for r in rows] == [(1, 7, "west"), (1, 7, "east"), (1, 8, "west"), (1, 8, "east"), (2, 7, "west"), (2, 8, "west")]
    assert all(r.metres == pytest.approx(200) and r.seconds == pytest.approx(10, abs=1e-5) for r in rows)
    assert found(spark, track(1, (0, -100, 0), (10, -100, 50), (20, -100, -50)), signals) == []  # along the edge


def test_random_tracks_against_fine_steps(spark):
    """Entry, exit and way inside agree with a walk in small steps along the same legs."""
    rng = np.random.default_rng(4)
    pings, want = [], []
    for trip in range(30):
        steps = np.cumsum(rng.normal(0, 60, (40, 2)), axis=0)
        pings += track(trip, *((10 * i, *p) for i, p in enumerate(steps)))
        s = np.linspace(0, 39, 39 * 4000 + 1)
        fine = np.column_stack([np.interp(s, np.arange(40), steps[:, k]) for k in (0, 1)])
        inside = np.hypot(*(fine - (20.0, 10.0)).T) < 100
        edge = np.flatnonzero(np.diff(inside.astype(int)))
        runs = [(a, b) for a, b in zip(edge, edge[1:], strict=False) if inside[a + 1]]
        size = np.hypot(*np.diff(fine, axis=0).T)
        want += [(trip, 10 * s[a], 10 * s[b], size[a:b].sum()) for a, b in runs if b - a > 40]
    rows = found(spark, pings, [(7, 20.0, 10.0)])
    got = [(r.TRIP_KEY, r.entered - EPOCH, r.left - EPOCH, r.metres) for r in rows if r.seconds > 0.1]
    assert len(got) == len(want) > 20 and np.allclose(got, want, atol=0.1)


def test_no_pings_or_signals(spark):
    none = spark.createDataFrame([], PINGS)
    assert avl.intersection_delay(none, spark.createDataFrame([(1, 0.0, 0.0)], SIGNALS)).isEmpty()
    assert avl.intersection_delay(spark.createDataFrame(track(1, (0, -200, 0), (20, 200, 0)), PINGS), spark.createDataFrame([], SIGNALS)).isEmpty()
    assert avl.ping_legs(none).withColumn("n", F.lit(1)).isEmpty()


def test_legs_around_one_signal_are_no_single_task(spark):
    """All legs lie in one cell of the grid; their rows come from several tasks, and none is lost."""
    legs = spark.range(4000).selectExpr("CAST(id AS INT) AS TRIP_KEY", "CAST(id AS DOUBLE) AS t0", "-50.0D + id * 0.0D AS x0", "id * 0.0D AS y0", "id + 5.0D AS t1", "50.0D + id * 0.0D AS x1", "id * 0.0D AS y1", "true AS usable")
    signals = spark.createDataFrame([(7, 0.0, 0.0), (8, 20.0, 0.0), (9, 90_000.0, 0.0)], SIGNALS)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        rows = avl.legs_in_reach(legs, signals, 100).withColumn("task", F.spark_partition_id())
        counts = [r["count"] for r in rows.groupBy("task").count().collect()]
    finally:
        for k in off:
            spark.conf.unset(k)
    assert sum(counts) == 8000 and max(counts) < 6000
