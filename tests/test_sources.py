from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corridor_jobs.functions.columns import decode_point
from corridor_jobs.sources import readers, writers


def test_signals_with_mark_and_carriage_returns(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("﻿TspAssetID,Name,Lat,Long,IPHostAddress\r\n1,A & B,34.1,-118.2,none\r\n2,C,,-118.3,none\r\n".encode())
    assert [tuple(r) for r in readers.read_signals(spark, str(p)).collect()] == [(1, "A & B", 34.1, -118.2, "none")]


def test_avl_drops_the_second_line_only(spark, tmp_path):
    names = "ROUTE_ID,TRIP_KEY,EVENT_TIME,LONGITUDE,LATITUDE,STOP_BACK_DOOR_ENTRY,STOP_FRONT_DOOR_ENTRY,STOP_FRONT_DOOR_EXIT,STOP_BACK_DOOR_EXIT"
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text(f"{names}\n---,---,---,---,---,,,,\n 104 ,{k},240301080910.0,-118.1,34.0,1,,,\n104,{k},,-118.1,34.0,,,,\n")
    got = readers.read_avl(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sum(r.EVENT_TIME is None for r in got) == 2


def test_dropped_lines_are_counted_in_the_same_pass(spark, tmp_path):
    names = "ROUTE_ID,TRIP_KEY,EVENT_TIME,LONGITUDE,LATITUDE,STOP_BACK_DOOR_ENTRY,STOP_FRONT_DOOR_ENTRY,STOP_FRONT_DOOR_EXIT,STOP_BACK_DOOR_EXIT"
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text(f"{names}\n---,---,---,---,---,,,,\n 104 ,{k},240301080910.0,-118.1,34.0,1,,,\n104,{k},,-118.1,34.0,,,,\n , ,  , , ,,,,\n1,2,x,,,,,,\n")
    df, counts = readers.read_avl_counted(spark, str(tmp_path))
    assert len(df.collect()) == 4 and counts.get == {"n_lines": 10, "n_blank": 2, "n_rejected": 4}


def test_headings(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("Intersection,Route Direction,Heading,Route,Name\nIntersection 27,North Bound,310,1,X\n")
    r = readers.read_headings(spark, str(p)).first()
    assert (r.TspAssetID, r.direction, r.Heading) == (27, "north", 310.0)


def test_corrected_ranges_with_an_unnamed_column(spark, tmp_path):
    sides = [f"{d}_{t}" for d in ("north", "south", "east", "west") for t in ("min", "max")]
    p = tmp_path / "c.csv"
    p.write_text("TspAssetID,osmid,Name,y,x," + ",".join(sides) + ",check,note,\n" + '1,77,A,34.0,-118.0,300,20,,,,,,,1,"left, then right",\n')
    r = readers.read_corrected_ranges(spark, str(p)).first()
    assert (r.osmid, r.north_min, r.north_max, r.south_min, r.x) == (77, 300.0, 20.0, None, -118.0)


def test_boundary(spark, tmp_path):
    ring = [[6561666.667, 1640416.667], [6571666.667, 1640416.667], [6571666.667, 1650416.667], [6561666.667, 1640416.667]]
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    got = readers.read_boundary(spark, str(p))
    assert len(got) == 4 and got[0] == pytest.approx(got[-1])
    assert ((got[1][0] - got[0][0]) ** 2 + (got[1][1] - got[0][1]) ** 2) ** 0.5 == pytest.approx(3048, rel=0.01)


def test_mart_filters_reach_the_scan(spark, tmp_path):
    df = spark.range(9).select(F.col("id"), (F.col("id") % 3).alias("day"))
    df.write.partitionBy("day").parquet(f"{tmp_path}/t")
    got = readers.read_mart(spark, str(tmp_path), "t", {"day": [1]})
    assert got.count() == 3
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString() or "day" in str(got.inputFiles())


def test_street_network_and_geometry_round_trip(spark, tmp_path):
    spark.createDataFrame([(1, -118.4, 34.0)], "osmid long, x double, y double").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([(1, 1, 0, "a")], "u long, v long, key int, name string").write.parquet(f"{tmp_path}/e")
    nodes, edges = readers.read_street_network(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert nodes.columns == ["osmid", "lon", "lat", "x", "y"] and edges.count() == 1
    df = spark.createDataFrame([("s", "f")], "shape_id string, feed_key string").withColumn("line", F.expr("array(struct(0D AS x, 1D AS y), struct(2D AS x, 3.5D AS y))"))
    writers.write_geometry_table(df, f"{tmp_path}/g", ["line"])
    assert spark.read.parquet(f"{tmp_path}/g").first().line == "LINESTRING (0.0 1.0, 2.0 3.5)"


def test_signal_ranges_round_trip(spark, tmp_path):
    values = {c: F.lit(1.0) for c in writers.SIGNAL_RANGES}
    writers.write_signal_ranges(spark.range(1).withColumns(values), f"{tmp_path}/r")
    assert spark.read.csv(f"{tmp_path}/r", header=True).columns == writers.SIGNAL_RANGES


def test_points(spark):
    df = spark.createDataFrame([("POINT(-118.5 34)",), ("POINT (1e-3 -2)",), ("LINE",), (None,)], "p string")
    got = [r.q and tuple(r.q) for r in df.select(decode_point(F.col("p")).alias("q")).collect()]
    assert got == [(-118.5, 34.0), (0.001, -2.0), None, None]
