from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.operators import avl
from corridor_jobs.operators.percentiles import weighted_percentiles
from corridor_jobs.operators.shared import with_previous


def test_previous_rows_equal_one_plain_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), rng.choice([None, 0.5, 1.5])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k int, t int, k2 string, v double")
    got = with_previous(df, ["k", "k2"], [F.floor(F.col("t") / 7)], ["t", "id"], "v", "before")
    want, last = {}, {}
    for i, k, t, k2, v in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = last.get((k, k2)) if None not in (k, k2) else None
        last[k, k2] = v
    assert {r.id: r.before for r in got.collect()} == want and got.count() == len(rows)


def test_a_hot_trip_is_no_single_task(spark):
    """Every shuffle of the pings themselves deals them out by more than the trip."""
    df = spark.range(5000).select(F.when(F.col("id") >= 0, 1).alias("TRIP_KEY"), F.col("id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("event_at"))
    done = avl.ping_gaps(df, tie="id")
    assert done.filter("gap_seconds <> 60").isEmpty() and done.filter("gap_seconds IS NULL").count() == 1
    plan = done._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "hashpartitioning(TRIP_KEY" in line and "_b0" not in line]
    assert len(wide) == 1 and "partial_max_by" in plan  # one row a trip and hour goes by trip alone


def test_percentiles_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v), int(n)) for k in ("a", "b", None) for v, n in zip(rng.integers(-40, 90, 300) / 4, rng.integers(0, 5, 300), strict=True)]
    rows += [("one", 7.0, 1), ("same", 2.5, 9), ("none", None, 4), ("far", -1e9, 1), ("far", 1e9, 2)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    shares = {"p20": 0.2, "p50": 0.5, "p80": 0.8, "least": 0.0, "most": 1.0}
    for buckets in (1, 3, 1024):
        got = {r.k: r for r in weighted_percentiles(df, ["k"], "v", "n", shares, buckets).collect()}
        assert set(got) == {"a", "b", None, "one", "same", "far"}
        for k, r in got.items():
            every = np.repeat([v for a, v, n in rows if a == k], [n for a, v, n in rows if a == k])
            assert [r[n] for n in shares] == pytest.approx([np.percentile(every, 100 * p) for p in shares.values()], rel=1e-12)
    assert weighted_percentiles(df.limit(0), ["k"], "v", "n", shares).isEmpty()


def test_summary_and_histogram_read_their_rows_once(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 9)], "gap_seconds double")
    r = avl.gap_summary(df).first()
    assert (r.n_gaps, r.mean_gap, r.min_gap, r.p25_gap, r.p50_gap, r.p75_gap, r.max_gap) == (5, 3.6, 1, 1, 2, 5, 9)
    assert r.std_gap == pytest.approx(np.std([1, 1, 2, 5, 9], ddof=1))
    none = avl.gap_summary(df.limit(0)).first()
    assert (none.n_gaps, none.mean_gap, none.std_gap, none.p50_gap) == (0, None, None, None)
    one = avl.gap_summary(df.limit(1)).first()
    assert (one.n_gaps, one.std_gap, one.p75_gap) == (1, None, 1.0)
    counts = avl.value_counts(df, "gap_seconds")
    plan = avl.histogram_of_counts(counts, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and [x.n_rows for x in avl.histogram_of_counts(counts, 4).orderBy("bin").collect()] == [3, 0, 1, 1]
    parts = avl.value_counts(df.filter("gap_seconds < 3"), "gap_seconds").unionByName(avl.value_counts(df.filter("gap_seconds >= 3"), "gap_seconds"))
    assert [x.n_rows for x in avl.histogram_of_counts(parts, 4).orderBy("bin").collect()] == [3, 0, 1, 1]
