"""Street network: junctions, bearings, orientations, directions, and heading ranges at signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bearing, distance_to_bearing, distance_to_point, negative_distance_to_bearing, positive_distance_to_bearing
from .areas import walls_of, within_area
from .checks import asserted, asserted_unique
from .shared import checkpointed, small

EAST_WEST, NORTH_SOUTH = 0, 1
#: (direction, bearing, orientation); of two as near, the second of an orientation is taken.
CANONICAL = (("east", 30.0, EAST_WEST), ("west", 215.0, EAST_WEST), ("north", 320.0, NORTH_SOUTH), ("south", 140.0, NORTH_SOUTH))
DIRECTIONS = ("north", "south", "east", "west")


#: Parts that the rows of a cell are dealt to where a cell may hold most of them.
CELL_PARTS = 64


def grid_pairs(left: DataFrame, right: DataFrame, reach: float, strict: bool = False, parts: int = 1) -> DataFrame:
    """Pairs of points (x, y) at most reach apart (less than reach if strict), with distance.

    Cells are reach wide; the right side, which should be the shorter, is listed in its nine neighbouring cells and joined
    on the cell. Neither is broadcast, as the listing makes a table much larger than Spark takes it for. Columns of the
    right side must not clash with those of the left, x and y apart, which are dropped.

    With more than one of parts, the left rows of a cell are dealt to so many, and the right ones are listed for those parts
    of a cell that hold any, so that a cell with most of the rows is no single task. The left side is then read twice.
    """
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    r = right.withColumnsRenamed({"x": "_x", "y": "_y"}).filter("_x IS NOT NULL AND _y IS NOT NULL")
    r = r.withColumn("_i", near).withColumn("_j", near)
    r = r.withColumns({"_i": F.floor(F.col("_x") / reach) + F.col("_i"), "_j": F.floor(F.col("_y") / reach) + F.col("_j")})
    placed = left.withColumns({"_i": F.floor(F.col("x") / reach), "_j": F.floor(F.col("y") / reach)})
    cell = ["_i", "_j"]
    if parts > 1:
        cell = [*cell, "_part"]
        placed = placed.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
        r = r.join(placed.select(*cell).distinct().hint("merge"), ["_i", "_j"])
    pairs = placed.hint("merge").join(r.hint("merge"), cell)
    pairs = pairs.withColumn("distance", distance_to_point(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")))
    return pairs.filter(F.col("distance") < reach if strict else F.col("distance") <= reach).drop(*cell, "_x", "_y")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, max_m: float = 50, how: str = "left") -> DataFrame:
    """Each left point with its nearest right points within max_m, all of equals; without any, nulls (how="left"). The left
    points, mostly fewer than the right ones, are those listed in nine cells."""
    pairs = grid_pairs(right, left.select(left_id, "x", "y"), max_m).drop("x", "y")
    best = F.rank().over(Window.partitionBy(left_id).orderBy("distance"))
    return left.join(pairs.withColumn("_n", best).filter("_n = 1").drop("_n"), left_id, how)


def clip_to_study_area(nodes: DataFrame, edges: DataFrame, ring: Sequence[tuple[float, float]] | DataFrame, buffer_m: float = 1000) -> DataFrame:
    """Edges with an end in the ring or within buffer_m of it. nodes has x, y in the ring's metres; the ring is a list of
    corners or a table of walls (see areas). Further columns of the edges, lines among them, stay as they are."""
    walls = ring if isinstance(ring, DataFrame) else walls_of(nodes.sparkSession, ring)
    inside = within_area(nodes.select("osmid", "x", "y"), walls, buffer_m).select("osmid")
    ends = edges.withColumn("osmid", F.explode(F.array("u", "v"))).join(inside, "osmid", "left_semi")
    return ends.drop("osmid").distinct()


def with_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds line, in the metres of the nodes (osmid, x, y) from u to v, where edges have none: straight between them."""
    a = nodes.select(F.col("osmid").alias("u"), F.struct("x", "y").alias("_a"))
    b = nodes.select(F.col("osmid").alias("v"), F.struct("x", "y").alias("_b"))
    rows = edges.join(a.hint("merge"), "u", "left").join(b.hint("merge"), "v", "left")
    straight = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.array("_a", "_b"))
    return rows.withColumn("line", F.coalesce(F.col("line"), straight) if "line" in edges.columns else straight).drop("_a", "_b")


def with_ends_moved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose line begins and ends at their nodes: led on to them where these were merged and moved."""
    a = nodes.select(F.col("osmid").alias("u"), F.struct("x", "y").alias("_a"))
    b = nodes.select(F.col("osmid").alias("v"), F.struct("x", "y").alias("_b"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    before = F.when(F.col("line")[0] != F.col("_a"), F.array("_a")).otherwise(none)
    after = F.when(F.element_at("line", -1) != F.col("_b"), F.array("_b")).otherwise(none)
    return edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").withColumn("line", F.concat(before, "line", after)).drop("_a", "_b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the least node reachable over undirected edges (u, v).

    Each round a node takes the least label among its neighbours, all nodes of a label take the least that one of them
    found, and every label jumps to its own label, so that long chains take about as many rounds as their length has bits.
    """
    both = checkpointed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")))
    for _ in range(rounds):
        told = both.join(label.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), F.col("label").alias("near"))
        heard = checkpointed(told.groupBy("node").agg(F.min("near").alias("near")).join(label, "node"))
        hook = heard.groupBy("label").agg(F.min("near").alias("hook"))
        near = heard.join(hook, "label").select("node", "label", F.least("label", "hook").alias("near"))
        root = near.select(F.col("node").alias("near"), F.col("near").alias("root"))
        step = checkpointed(near.join(root, "near").select("node", F.col("root").alias("new"), "label"))
        if step.filter("new <> label").isEmpty():
            return step.select("node", "label")
        label = step.select("node", F.col("new").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def consolidate_intersections(nodes: DataFrame, edges: DataFrame, tolerance_m: float = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (osmid, x, y, lon, lat) and edges with junctions whose tolerance buffers touch merged into one.

    Dead ends (nodes with one neighbour) go first, with their edges. A merged node has its least osmid and the mean
    place of its members. Edges within it go; the others are numbered anew (key, from 0) among those that now have the
    same ends, in order of their old ends and keys. Lines of edges that have them are led on to the merged nodes.
    """
    flat = edges.select("u", "v").filter("u <> v")
    sides = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    dead = sides.groupBy(F.col("u").alias("osmid")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("osmid")
    nodes = nodes.join(dead, "osmid", "left_anti")
    for end in ("u", "v"):
        edges = edges.join(dead.withColumnRenamed("osmid", end), end, "left_anti")
    pairs = grid_pairs(nodes.select(F.col("osmid").alias("u"), "x", "y"), nodes.select(F.col("osmid").alias("v"), "x", "y"), 2 * tolerance_m)
    label = components(pairs.filter("u < v"))
    placed = nodes.join(label.withColumnRenamed("node", "osmid"), "osmid", "left").withColumn("label", F.coalesce("label", "osmid"))
    merged = placed.groupBy(F.col("label").alias("osmid")).agg(*(F.avg(c).alias(c) for c in ("x", "y", "lon", "lat")))
    edges = edges.withColumns({"_u": F.col("u"), "_v": F.col("v"), "_key": F.col("key")})
    for end in ("u", "v"):
        to = label.select(F.col("node").alias(end), F.col("label").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    place = F.row_number().over(Window.partitionBy("u", "v").orderBy("_u", "_v", "_key")) - 1
    edges = edges.filter("u <> v").withColumn("key", place).drop("_u", "_v", "_key")
    return merged, with_ends_moved(edges, merged) if "line" in edges.columns else edges


def edge_bearings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds bearing, from u to v; null for loops. nodes has lon, lat."""
    a = nodes.select(F.col("osmid").alias("u"), F.col("lon").alias("_lon1"), F.col("lat").alias("_lat1"))
    b = nodes.select(F.col("osmid").alias("v"), F.col("lon").alias("_lon2"), F.col("lat").alias("_lat2"))
    there = bearing(*(F.col(c) for c in ("_lon1", "_lat1", "_lon2", "_lat2")))
    rows = edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").withColumn("bearing", F.when(F.col("u") != F.col("v"), there))
    return rows.drop("_lon1", "_lat1", "_lon2", "_lat2")


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("bearing").isNotNull())


def street_orientation(edges: DataFrame, config: DataFrame) -> DataFrame:
    """Adds orientation and transit to edges whose name is exactly that of a configured street (name, orientation). config
    is counted; where it is small, edges meet it in place: they have few names, and by name would meet in a task for each."""
    return edges.join(small(config.withColumn("transit", F.lit(True))), "name", "left")


def in_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that end at the nodes (osmid)."""
    return edges.join(nodes.select(F.col("osmid").alias("v")).distinct(), "v", "left_semi")


def bearing_bounds(edges: DataFrame) -> DataFrame:
    """Adds bearing_lower_bound and bearing_upper_bound: half way to the nearest other in-edge of v on either side.

    Whole degrees, halves to even, so that 360 may occur. An only in-edge has null bounds. An edge is told from the
    others by (u, key). In-edges are as many as the signals let them be, so neither join is a broadcast.
    """
    other = edges.select("v", F.col("u").alias("_u"), F.col("key").alias("_key"), F.col("bearing").alias("_b"))
    pairs = edges.select("v", "u", "key", "bearing").hint("merge").join(other, "v").filter(~((F.col("u") == F.col("_u")) & (F.col("key") == F.col("_key"))))
    up, down = positive_distance_to_bearing(F.col("bearing"), F.col("_b")), negative_distance_to_bearing(F.col("bearing"), F.col("_b"))
    gaps = pairs.groupBy("v", "u", "key").agg(F.min(up).alias("_up"), F.min(down).alias("_down"))
    whole = lambda c: F.bround(F.pmod(c, F.lit(360.0)), 0)
    rows = edges.join(gaps.hint("merge"), ["v", "u", "key"], "left")
    return rows.withColumns(
        {"bearing_lower_bound": whole(F.col("bearing") - F.col("_down") / 2), "bearing_upper_bound": whole(F.col("bearing") + F.col("_up") / 2)}
    ).drop("_up", "_down")


def propagate_orientation(edges: DataFrame) -> DataFrame:
    """In-edges of a node without orientation take the other one than the node's first configured in-edge, by (u, key)."""
    order = Window.partitionBy("v").orderBy("u", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("orientation", ignorenulls=True).over(order)
    return edges.withColumn("orientation", F.coalesce(F.col("orientation"), F.lit(1) - first))


def _gap(direction: str) -> Column:
    return distance_to_bearing(F.col("bearing"), F.lit(next(b for d, b, _ in CANONICAL if d == direction)))


def assign_directions(edges: DataFrame) -> DataFrame:
    """Adds direction: at each node, one in-edge of an orientation gets the nearer canonical direction; of two, the one
    nearest to any gets its own and the other the opposite; of more, none gets one. Ties go by (u, key)."""
    ew = F.col("orientation") == EAST_WEST
    d1, d2 = F.when(ew, _gap("east")).otherwise(_gap("north")), F.when(ew, _gap("west")).otherwise(_gap("south"))
    both = Window.partitionBy("v", "orientation")
    order = both.orderBy(F.least("_d1", "_d2"), "u", "key")
    rows = edges.withColumns({"_d1": d1, "_d2": d2}).withColumns(
        {"_n": F.count(F.lit(1)).over(both), "_rank": F.row_number().over(order), "_lead": F.first(F.col("_d1") < F.col("_d2")).over(order)}
    )
    first = F.when(F.col("_rank") == 1, F.col("_lead")).otherwise(~F.col("_lead"))
    name = F.when(ew, F.when(first, "east").otherwise("west")).otherwise(F.when(first, "north").otherwise("south"))
    direction = F.when(F.col("orientation").isNotNull() & (F.col("_n") <= 2), name)
    return rows.withColumn("direction", direction).drop("_d1", "_d2", "_n", "_rank", "_lead")


def node_heading_ranges(edges: DataFrame) -> DataFrame:
    """osmid and eight columns <direction>_min, <direction>_max, from the edges that have direction and bounds. Fails if two
    edges of a node have one direction."""
    known = edges.dropna(subset=["direction", "bearing_lower_bound", "bearing_upper_bound"])
    wide = known.groupBy(F.col("v").alias("osmid")).pivot("direction", list(DIRECTIONS))
    rows = wide.agg(F.first("bearing_lower_bound").alias("min"), F.first("bearing_upper_bound").alias("max"), F.count(F.lit(1)).alias("n"))
    counts = [F.col(f"{d}_n") for d in DIRECTIONS]
    return asserted(rows, F.coalesce(F.greatest(*counts), F.lit(0)) <= 1, "two edges of one direction at a node").drop(*(f"{d}_n" for d in DIRECTIONS))


def signals_with_ranges(signals: DataFrame, nodes: DataFrame, ranges: DataFrame, max_m: float = 50) -> DataFrame:
    """Every signal once, with the ranges of its nearest node within max_m (of equals the least osmid), if any.

    signals: TspAssetID, Name, x, y (metres); fails if a TspAssetID repeats. nodes: osmid, x, y.
    """
    near = nearest_within(asserted_unique(signals, ["TspAssetID"]), nodes.select("osmid", "x", "y"), "TspAssetID", max_m)
    one = Window.partitionBy("TspAssetID").orderBy("distance", "osmid")
    return near.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "distance").join(ranges, "osmid", "left")
