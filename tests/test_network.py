from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corridor_jobs.functions import columns as C
from corridor_jobs.functions.rings import feet_to_degrees
from corridor_jobs.jobs import workloads
from corridor_jobs.operators import areas, network, validation
from corridor_jobs.sources import adapters

EDGE = "u long, v long, key int, bearing double, orientation int"


def test_equal_bearings_are_a_whole_turn_apart(spark):
    df = spark.createDataFrame([(10.0, 10.0), (350.0, 10.0), (10.0, 350.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(C.positive_distance_to_bearing(a, b), C.negative_distance_to_bearing(a, b), C.distance_to_bearing(a, b)).collect()
    assert [tuple(r) for r in got] == [(360, 360, 360), (20, 340, 20), (340, 20, 20)]


def test_bounds_are_half_way_to_the_neighbours(spark):
    rows = [(1, 9, 0, 0.0, None), (2, 9, 0, 91.0, None), (3, 9, 0, 180.0, None), (4, 8, 0, 5.0, None), (5, 7, 0, 1.0, None), (6, 7, 0, 358.0, None)]
    got = {(r.u, r.v): (r.bearing_lower_bound, r.bearing_upper_bound) for r in network.bearing_bounds(spark.createDataFrame(rows, EDGE)).collect()}
    assert got[(1, 9)] == (270.0, 46.0)  # 45.5, half to even
    assert got[(2, 9)] == (46.0, 136.0)
    assert got[(4, 8)] == (None, None)  # no other edge
    assert got[(5, 7)][0] == 360.0  # 359.5 rounds to 360


def test_bounds_tile_the_circle(spark):
    rng = random.Random(3)
    rows = [(i, v, 0, float(b), None) for v in range(20) for i, b in enumerate(rng.sample(range(360), rng.randint(2, 6)))]
    assert validation.bounds_tile_circle(network.bearing_bounds(spark.createDataFrame(rows, EDGE))).isEmpty()


def test_orientation_is_passed_on_once(spark):
    rows = [(1, 9, 0, 0.0, 1), (2, 9, 0, 90.0, 0), (3, 9, 0, 180.0, None), (4, 8, 0, 5.0, None)]
    got = {r.u: r.orientation for r in network.propagate_orientation(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: None}  # the first configured edge is 1, so the other way is 0


def test_directions(spark):
    rows = [(1, 1, 0, 40.0, 0), (1, 2, 0, 122.5, 0), (1, 3, 0, 50.0, 0), (2, 3, 0, 31.0, 0)]
    rows += [(1, 4, 0, 10.0, 0), (2, 4, 0, 20.0, 0), (3, 4, 0, 30.0, 0), (1, 5, 0, 320.0, 1), (1, 6, 0, 5.0, None)]
    got = {(r.u, r.v): r.direction for r in network.assign_directions(spark.createDataFrame(rows, EDGE)).collect()}
    assert got[(1, 1)] == "east"
    assert got[(1, 2)] == "west"  # as far from 30 as from 215: the second
    assert (got[(2, 3)], got[(1, 3)]) == ("east", "west")  # the nearer one first, the other opposite
    assert got[(1, 4)] is got[(2, 4)] is got[(3, 4)] is None
    assert got[(1, 5)] == "west" or got[(1, 5)] in ("north", "south")
    assert got[(1, 6)] is None


def test_equal_to_a_canonical_bearing_counts_as_a_whole_turn(spark):
    rows = [(1, 5, 0, 320.0, 1)]
    assert network.assign_directions(spark.createDataFrame(rows, EDGE)).first().direction == "south"


def test_node_ranges_pivot(spark):
    rows = [(9, "north", 300.0, 20.0), (9, "east", None, None), (8, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "v long, direction string, bearing_lower_bound double, bearing_upper_bound double")
    got = network.node_heading_ranges(df).collect()
    assert [(r.osmid, r.north_min, r.north_max, r.east_min) for r in got] == [(9, 300.0, 20.0, None)]


def test_grid_join_equals_brute_force_and_ties_are_kept(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-100, 100, (60, 2)), rng.uniform(-100, 100, (80, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "osmid int, x double, y double")
    got = {(r.id, r.osmid) for r in network.grid_pairs(left, right, 25.0).collect()}
    d = np.hypot(*(a[:, None] - b).transpose(2, 0, 1))
    assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(d <= 25)), strict=True))
    tied = spark.createDataFrame([(1, 3.0, 0.0), (2, -3.0, 0.0), (3, 9.0, 0.0)], "osmid int, x double, y double")
    here = spark.createDataFrame([(7, 0.0, 0.0), (8, 500.0, 0.0)], "id int, x double, y double")
    assert sorted((r.id, r.osmid or 0) for r in network.nearest_within(here, tied, "id").collect()) == [(7, 1), (7, 2), (8, 0)]


def test_signal_keeps_one_of_tied_nodes(spark):
    signals = spark.createDataFrame([(7, "s", 0.0, 0.0)], "TspAssetID int, Name string, x double, y double")
    nodes = spark.createDataFrame([(2, 3.0, 0.0), (1, -3.0, 0.0)], "osmid long, x double, y double")
    ranges = spark.createDataFrame([(1, 5.0)], "osmid long, north_min double")
    assert [(r.osmid, r.north_min) for r in network.signals_with_ranges(signals, nodes, ranges).collect()] == [(1, 5.0)]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    got = {r.node: r.label for r in network.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in up}


def test_components_of_long_chains_take_few_rounds(spark):
    rng = random.Random(6)
    mixed = rng.sample(range(1000, 3000), 2000)
    edges = [*zip(mixed, mixed[1:]), *((i, i + 1) for i in range(500)), *((10_000 - i, 9_999 - i) for i in range(500))]
    got = {r.node: r.label for r in network.components(spark.createDataFrame(edges, "u long, v long"), rounds=16).collect()}
    assert got == dict.fromkeys(mixed, 1000) | dict.fromkeys(range(501), 0) | dict.fromkeys(range(9_500, 10_001), 9_500)


def test_junctions_merge_and_dead_ends_go(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 15.0, 0.0), (3, 30.0, 0.0), (4, 500.0, 0.0), (5, 900.0, 0.0)], "osmid long, x double, y double")
    nodes = nodes.withColumns({"lon": F.col("x"), "lat": F.col("y")})
    rows = [(1, 2, 0), (2, 3, 0), (3, 4, 0), (4, 1, 0), (4, 5, 0), (5, 4, 0)]
    edges = spark.createDataFrame([(*r, "n") for r in rows], "u long, v long, key int, name string")
    merged, left = network.consolidate_intersections(nodes, edges)
    assert sorted((r.osmid, r.x) for r in merged.collect()) == [(1, 15.0), (4, 500.0)]  # a chain of three, and 5 is a dead end
    assert sorted((r.u, r.v) for r in left.collect()) == [(1, 4), (4, 1)]


def test_edges_that_meet_after_a_merge_keep_keys_apart(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 15.0, 0.0), (4, 500.0, 0.0), (6, 500.0, 300.0)], "osmid long, x double, y double")
    nodes = nodes.withColumns({"lon": F.col("x"), "lat": F.col("y")})
    rows = [(1, 4, 0, "a"), (2, 4, 0, "b"), (2, 4, 1, "c"), (4, 6, 0, "d"), (6, 1, 0, "e"), (6, 4, 3, "f"), (2, 6, 5, "g")]
    edges = spark.createDataFrame(rows, "u long, v long, key int, name string")
    _, left = network.consolidate_intersections(nodes, edges)
    assert sorted((r.u, r.v, r.key, r.name) for r in left.collect()) == [(1, 4, 0, "a"), (1, 4, 1, "b"), (1, 4, 2, "c"), (1, 6, 0, "g"), (4, 6, 0, "d"), (6, 1, 0, "e"), (6, 4, 0, "f")]


def near_ring(points, rings, buffer):
    """Inside the rings (even-odd) or within buffer of them, wall by wall."""
    x, y = (np.array(c, dtype=float) for c in zip(*points, strict=True))
    odd, near = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            near |= np.hypot(x1 + t * dx - x, y1 + t * dy - y) <= buffer
    return (odd | near).tolist()


def inside(spark, points, ring, buffer, **more):
    walls = ring if not isinstance(ring, list) else areas.walls_of(spark, ring)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "osmid int, x double, y double")
    got = {r.osmid for r in areas.within_area(df, walls, buffer, **more).collect()}
    return [i in got for i in range(len(points))]


def test_an_area_with_thousands_of_corners_and_a_hole(spark):
    rng = np.random.default_rng(8)
    turn = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    far = 3000 + 900 * np.sin(9 * turn) + rng.normal(0, 8, 5000)
    outer = [(float(a), float(b)) for a, b in zip(far * np.cos(turn), far * np.sin(turn), strict=True)]
    hole = [(-600.0, -600.0), (600.0, -600.0), (600.0, 900.0), (-600.0, 900.0)]
    points = rng.uniform(-4500, 4500, (3000, 2)).tolist() + outer[:50] + [(0.0, 0.0), (600.0, 0.0), (650.0, 100.0)]
    corners = spark.createDataFrame([(i, *p) for i, p in enumerate(outer)], "i int, x double, y double")
    walls = areas.ring_walls(corners).select(areas.WALL).unionByName(areas.walls_of(spark, hole))
    for buffer, cell in ((0.0, 250.0), (120.0, None), (120.0, 37.0)):
        got = inside(spark, points, walls, buffer, cell=cell)
        want = near_ring(points, [outer, hole], buffer)
        edge = 50 if buffer == 0 else 0  # corners themselves are neither in nor out
        assert got[:3000] == want[:3000] and got[3000 + edge :] == want[3000 + edge :]
    plan = areas.within_area(corners, areas.walls_of(spark, outer), 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_walls_no_places(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0)], "osmid int, x double, y double")
    assert areas.within_area(df, areas.walls_of(spark, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]).limit(0), 3.0).isEmpty()
    assert [r.osmid for r in areas.within_area(df, areas.walls_of(spark, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]), 3.0).collect()] == [2]


def test_lines_survive_clip_and_merge(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 15.0, 0.0), (3, 7.0, 400.0), (4, 500.0, 0.0), (5, 9000.0, 0.0)], "osmid long, x double, y double")
    nodes = nodes.withColumns({"lon": F.col("x"), "lat": F.col("y")})
    rows = [(2, 4, 0, [(15.0, 0.0), (300.0, 90.0), (500.0, 0.0)]), (4, 1, 0, None), (1, 3, 0, None), (3, 4, 0, [(7.0, 400.0), (480.0, 9.0)]), (4, 3, 0, None), (2, 3, 0, None), (5, 3, 0, None), (5, 9, 0, None)]
    edges = spark.createDataFrame(rows, "u long, v long, key int, line array<struct<x:double,y:double>>")
    clipped = network.clip_to_study_area(nodes, network.with_lines(edges, nodes), [(-50.0, -50.0), (600.0, -50.0), (600.0, 600.0), (-50.0, 600.0)], 10)
    _, left = network.consolidate_intersections(nodes, clipped)
    got = {(r.u, r.v, r.key): [tuple(p) for p in r.line] for r in left.collect()}
    assert got == {
        (1, 4, 0): [(7.5, 0.0), (15.0, 0.0), (300.0, 90.0), (500.0, 0.0)],  # 1 and 2 are one node now
        (4, 1, 0): [(500.0, 0.0), (0.0, 0.0), (7.5, 0.0)],
        (1, 3, 0): [(7.5, 0.0), (0.0, 0.0), (7.0, 400.0)],
        (1, 3, 1): [(7.5, 0.0), (15.0, 0.0), (7.0, 400.0)],
        (3, 4, 0): [(7.0, 400.0), (480.0, 9.0), (500.0, 0.0)],  # led on to its node
        (4, 3, 0): [(500.0, 0.0), (7.0, 400.0)],
    }
    triangles = validation.in_edge_triangles(left.withColumns({"bearing_lower_bound": F.when(F.col("v") == 4, 0.0), "bearing_upper_bound": F.lit(90.0)}), 10)
    assert {(r.u, r.v): [tuple(round(c, 6) for c in p) for p in r.triangle] for r in triangles.collect()} == dict.fromkeys([(1, 4), (3, 4)], [(500.0, 0.0), (500.0, -10.0), (490.0, 0.0)])


def test_a_doubled_direction_or_signal_is_an_error(spark):
    rows = [(9, "north", 300.0, 20.0), (9, "north", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "v long, direction string, bearing_lower_bound double, bearing_upper_bound double")
    with pytest.raises(PySparkException, match="two edges of one direction"):
        network.node_heading_ranges(df).collect()
    assert network.node_heading_ranges(df.filter("bearing_lower_bound > 99")).count() == 1
    signals = spark.createDataFrame([(7, "s", 0.0, 0.0), (7, "t", 1.0, 1.0)], "TspAssetID int, Name string, x double, y double")
    nodes, ranges = spark.createDataFrame([(2, 3.0, 0.0)], "osmid long, x double, y double"), spark.createDataFrame([(2, 5.0)], "osmid long, north_min double")
    with pytest.raises(PySparkException, match="repeated TspAssetID"):
        network.signals_with_ranges(signals, nodes, ranges).collect()


def test_study_area(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    points = [(50.0, 50.0), (105.0, 50.0), (120.0, 50.0), (-5.0, -5.0), (50.0, 111.0)]
    assert inside(spark, points, ring, 10) == [True, True, False, True, False]
    nodes = spark.createDataFrame([(1, 50.0, 50.0), (2, 120.0, 50.0), (3, 500.0, 0.0), (4, None, 0.0)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, "a"), (2, 3, 0, "b"), (3, 1, 0, None)], "u long, v long, key int, name string")
    assert sorted((r.u, r.v) for r in network.clip_to_study_area(nodes, edges, ring, 10).collect()) == [(1, 2), (3, 1)]


def test_feet_to_degrees_at_the_origin():
    assert feet_to_degrees(6561666.66666667, 1640416.66666667) == pytest.approx((-118.0, 33.5), abs=1e-6)


def test_no_table_of_the_network_is_broadcast(spark, tmp_path):
    """A node listed in nine cells was broadcast, as were the nodes and the keys that edges are made of."""
    spark.range(4000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(190).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    streets = workloads.Streets(spark, str(tmp_path))
    for df in (streets.near, streets.bearings, adapters.adapted(spark, str(tmp_path), "bends")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert streets.near.filter("osmid IS NOT NULL").count() > 100


def test_in_edges_are_worked_out_once_and_streets_meet_in_place(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(workloads, "checkpointed", lambda df: kept.append(df) or workloads.network.checkpointed(df))
    streets = workloads.Streets(spark, "/root/testdata/sf0.001")
    plan = streets.bounds._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 2  # streets and in-edges
    assert "part.parquet" not in plan and "Scan parquet" not in plan and "BroadcastHashJoin" not in plan
    assert sum("BroadcastHashJoin [name" in line for line in streets.oriented._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
