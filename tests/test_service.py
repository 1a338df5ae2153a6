from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException

from corridor_jobs.operators import checks, segments, service, shared, stop_times

D1, D2, D3 = (date(2024, 3, d) for d in (4, 5, 6))


@pytest.fixture
def trips(spark):
    rows = [(D1, f"t{i}", "f0", "a", "r1", "3", 0) for i in range(6)]
    rows += [(D2, f"t{i}", "f1", "a", "r1", "3", 0) for i in range(5)]
    rows += [(D2, "t9", "f1", "a", "r0", "3", 0), (D2, "t8", "f1", None, "r1", "3", 0), (D1, "t7", "f1", "b", "r1", "3", 1), (D1, "t6", "f0", "b", "r2", "4", 1)]
    return spark.createDataFrame(rows, "service_date date, trip_id string, feed_key string, shape_id string, route_id string, route_short_name string, direction_id int")


@pytest.fixture
def feeds(spark):
    rows = [(D1, "f0", "City"), (D2, "f1", "City"), (D3, "f1", "City"), (D1, "f9", "Other")]
    return spark.createDataFrame(rows, "date date, feed_key string, gtfs_dataset_name string")


def test_dates_without_the_route_are_dropped_and_shapes_summed_over_feeds(feeds, trips):
    shown = service.feed_shapes(service.feeds_on_dates(feeds, [D1, D2, D3], "City"), service.route_shape_counts(trips, [D1, D2, D3], "3"))
    assert {r.service_date for r in shown.collect() if r.ct is None} == {D3}
    served = service.drop_unserved_dates(shown)
    assert {tuple(r) for r in service.feed_dates(served).collect()} == {(D1, "f0"), (D2, "f1")}
    totals = service.total_trips_per_shape(served)
    assert {r.ct for r in totals.collect()} == {12}  # 6 in one feed, 6 in the other
    latest = {(r.shape_id, r.feed_key): (r.last_seen_date, r.route_id) for r in service.latest_per_shape(totals).collect()}
    assert latest == {("a", "f0"): (D1, "r1"), ("a", "f1"): (D2, "r0")}  # two routes on one date: the least
    assert service.min_trips(totals, 13).count() == 0


def test_geometry_of_the_latest_date(spark):
    rows = [(D1, "a", "f0", ["POINT(0 0)"]), (D2, "a", "f0", ["POINT(0 0)", "POINT(1 -2.5)"]), (D2, "b", "f0", None)]
    shapes = spark.createDataFrame(rows, "service_date date, shape_id string, feed_key string, pt_array array<string>")
    chosen = spark.createDataFrame([("a", "f0", D2), ("b", "f0", D2)], "shape_id string, feed_key string, last_seen_date date")
    g = service.shape_geometry(shapes, [D1, D2], chosen.select("feed_key"), chosen)
    kept = service.with_lines(service.attach_geometry(g.select("shape_id", "feed_key"), g)).collect()
    assert [(r.shape_id, [tuple(p) for p in r.line]) for r in kept] == [("a", [(0.0, 0.0), (1.0, -2.5)])]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert [tuple(r) for r in checks.check_unique(df, ["k"]).collect()] == [("a", 2)]
    assert checks.check_unique(df, ["k", "v"]).isEmpty()
    missing = checks.check_count(df, ["k"], spark.createDataFrame([("b",), ("c",)], "k string"))
    assert [tuple(r) for r in missing.collect()] == [("c", 0)]
    with pytest.raises(ValueError, match="one feed"):
        checks.require(checks.check_unique(df, ["k"]), "one feed per key")


def test_timepoints_on_every_trip_and_the_fan_out_by_stop(spark):
    stop_rows = [("f0", "p1", "t1", 1, 1), ("f0", "p1", "t2", 1, 1), ("f0", "p2", "t1", 1, 2), ("f0", "p2", "t2", None, 2), ("f0", "p1", "t3", 1, 7)]
    st = spark.createDataFrame(stop_rows, "feed_key string, stop_id string, trip_id string, timepoint int, stop_sequence int")
    trip_rows = [(D1, "f0", "t1", "a"), (D2, "f0", "t1", "a"), (D1, "f0", "t2", "a"), (D1, "f0", "t3", "b")]
    trips = spark.createDataFrame(trip_rows, "service_date date, feed_key string, trip_id string, shape_id string")
    joined = stop_times.trip_stop_times(st, trips)
    summary = {(r.stop_id, r.shape_id): (r.n_timepoint, r.n_stop_times) for r in stop_times.timepoint_summary(joined).collect()}
    assert summary == {("p1", "a"): (3, 3), ("p2", "a"): (2, 3), ("p1", "b"): (1, 1)}  # t1 counts on both dates; null adds nothing
    stops = spark.createDataFrame([(D1, "p1", "POINT(2 2)"), (D2, "p1", "POINT(1 1)"), (D1, "p2", None)], "service_date date, stop_id string, pt_geom string")
    counts = stop_times.stop_counts(joined)
    assert sorted(map(tuple, stop_times.summary_of_counts(counts).collect())) == sorted(map(tuple, stop_times.timepoint_summary(joined).collect()))
    assert stop_times.stop_sequences(counts).exceptAll(stop_times.stop_sequences(joined)).isEmpty()
    points = stop_times.timepoints_on_route(stops, stop_times.timepoint_summary(joined), stop_times.stop_sequences(joined))
    assert sorted((r.stop_id, r.shape_id, r.stop_sequence, r.pt_geom) for r in points.collect()) == [
        ("p1", "a", 1, "POINT(1 1)"),
        ("p1", "a", 7, "POINT(1 1)"),  # the sequence of shape b
        ("p1", "b", 1, "POINT(1 1)"),
        ("p1", "b", 7, "POINT(1 1)"),
    ]
    at = datetime(2024, 3, 4, 8)
    rt = spark.createDataFrame([(D1, "t1", "k", "p9", 1, at, at, 3, "u")], "service_date date, trip_id string, trip_key string, stop_id string, stop_sequence int, actual_arrival_pacific timestamp_ntz, actual_departure_pacific timestamp_ntz, n_predictions int, schedule_base64_url string")
    rows = stop_times.schedule_rt_stop_times(rt, trips, points).collect()
    assert [(r.stop_id, r.pt_geom) for r in rows] == [("p9", "POINT(1 1)")]
    assert stop_times.schedule_rt_stop_times(rt, trips, points, match_on="stop_id").isEmpty()


def test_trips_only_with_the_feed_of_their_date(spark, trips):
    pairs = spark.createDataFrame([(D1, "f0"), (D2, "f1")], "service_date date, feed_key string")
    got = stop_times.valid_trips(trips, pairs, [D1, D2], spark.createDataFrame([("a",), ("b",)], "shape_id string"))
    assert got.filter("trip_id = 't7'").isEmpty()  # its feed is not in effect
    assert got.count() == 13


def fails(df, what):
    with pytest.raises(PySparkException, match=what):
        df.collect()


def test_jobs_fail_on_doubled_keys(spark):
    """Within the plan: no second pass over the rows."""
    once, twice = [("a", "f0", ["POINT(0 0)"])], [("a", "f0", ["POINT(0 0)"]), ("a", "f0", ["POINT(1 1)"])]
    shape = "shape_id string, feed_key string, pt_array array<string>"
    one, two = spark.createDataFrame(once, shape), spark.createDataFrame(twice, shape)
    assert service.attach_geometry(one.drop("pt_array"), one).count() == 1
    fails(service.attach_geometry(one.drop("pt_array"), two), "repeated shape_id, feed_key")
    fails(service.attach_geometry(two.drop("pt_array"), one), "repeated shape_id, feed_key")
    feeds = spark.createDataFrame([("f0",), ("f1",)], "feed_key string")
    dim = lambda *keys: spark.createDataFrame([(k, "u", datetime(2024, 1, 1)) for k in keys], "key string, base64_url string, _valid_from timestamp_ntz")
    assert service.feed_entries(dim("f0", "f1", "f9"), feeds).count() == 2
    fails(service.feed_entries(dim("f0", "f9"), feeds), "a feed without entry")
    fails(service.feed_entries(dim("f0", "f1", "f1"), feeds), "repeated feed_key")
    dates = spark.createDataFrame([(D1, "f0"), (D2, "f0")], "service_date date, feed_key string")
    entries = dim("f0").withColumnRenamed("key", "feed_key")
    assert service.attach_feed_entry(dates, entries).count() == 2
    fails(service.attach_feed_entry(dates, entries.unionByName(entries)), "repeated feed_key")
    assert checks.asserted_unique(one, ["shape_id"]).collect() == one.collect()


def test_keys_prune_partitions_without_the_driver(spark, tmp_path, monkeypatch):
    days = [date(2024, 3, d) for d in range(1, 29)]
    spark.createDataFrame([(d, "a", "f0", ["POINT(0 0)", f"POINT(1 {d.day})"]) for d in days], "service_date date, shape_id string, feed_key string, pt_array array<string>").write.partitionBy("service_date").parquet(f"{tmp_path}/shapes")
    spark.createDataFrame([("f0", "p", "t", 1, 1, datetime(2024, 1, d)) for d in range(1, 20)], "feed_key string, stop_id string, trip_id string, timepoint int, stop_sequence int, _feed_valid_from timestamp_ntz").write.partitionBy("_feed_valid_from").parquet(f"{tmp_path}/stop_times")
    shapes, times = spark.read.parquet(f"{tmp_path}/shapes"), spark.read.schema("feed_key string, stop_id string, trip_id string, timepoint int, stop_sequence int, _feed_valid_from timestamp_ntz").parquet(f"{tmp_path}/stop_times")
    chosen = spark.createDataFrame([("a", D2)], "shape_id string, last_seen_date date").repartition(1)
    entries = spark.createDataFrame([("f0", "u", datetime(2024, 1, 7))], "feed_key string, base64_url string, _valid_from timestamp_ntz").repartition(1)
    feeds = entries.select("feed_key")
    for rows, want in ((service.shape_geometry(shapes, days, feeds, chosen), 1), (stop_times.stop_times_in_feeds(times, entries, days), 1)):
        assert len(rows.collect()) == want
        assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)  # as for larger sets
    spread = service.shape_geometry(shapes, days, feeds, chosen)
    assert [r.pt_array[1] for r in spread.collect()] == ["POINT(1 5)"]


def test_realtime_rows_meet_timepoints_in_place(spark):
    """The rows that meet several stops are not shuffled for it, nor by their few dates and feeds, nor again by trip."""
    day = date(2024, 3, 4)
    metrics = spark.range(500).selectExpr("DATE '2024-03-04' AS service_date", "CAST(id % 50 AS STRING) AS trip_id", "'k' AS trip_key", "'p' AS stop_id", "CAST(id % 7 AS INT) AS stop_sequence", "TIMESTAMP_NTZ '2024-03-04 07:00:00' AS actual_arrival_pacific", "TIMESTAMP_NTZ '2024-03-04 07:00:00' AS actual_departure_pacific", "1 AS n_predictions", "'u' AS schedule_base64_url")
    dated = spark.createDataFrame([(day, "u")], "service_date date, base64_url string")
    trips = spark.range(50).selectExpr("DATE '2024-03-04' AS service_date", "CAST(id AS STRING) AS trip_id", "'f' AS feed_key", "'s' AS shape_id")
    points = spark.createDataFrame([(i % 7, "s", f"POINT({i} 0)") for i in range(14)], "stop_sequence int, shape_id string, pt_geom string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = segments.prior_departure(stop_times.schedule_rt_stop_times(stop_times.rt_stop_times(metrics, dated), trips, points))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(trip_id") == 2
    assert "hashpartitioning(stop_sequence" not in plan and "SinglePartition" not in plan


def test_the_corridor_keeps_its_few_rows(spark):
    """Audit and timepoint list are worked out once: what reads them scans kept rows and aggregates nothing again."""
    from corridor_jobs.jobs.workloads import Corridor

    w = Corridor(spark, "/root/testdata/sf0.001")
    for kept in (w.timepoint_list, w.validity):
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and "Aggregate" not in plan
