"""The three workloads, step by step, on the tables of sources.adapters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import albers
from ..operators import avl, checks, network, segments, service, stop_times, validation
from ..operators.shared import checkpointed
from ..sources.adapters import adapted
from ..sources.readers import with_heading_keys

DATES = tuple(date(2024, 3, d) for d in range(4, 9))
DATASET, ROUTE = "City Schedule", "3"
#: A stop / signal in longitude and latitude.
PLACE = (-118.41, 34.01)


@dataclass
class Service:
    """W1: how travel time varies between the timepoints of a route."""

    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return adapted(self.spark, self.sf_dir, name)

    @cached_property
    def feeds(self) -> DataFrame:
        return service.feeds_on_dates(self._t("feeds"), DATES, DATASET)

    @cached_property
    def counts(self) -> DataFrame:
        return service.route_shape_counts(self._t("trips"), DATES, ROUTE)

    @cached_property
    def served(self) -> DataFrame:
        """A row a date, shape and feed of the route: kept, as all that selects trips, stops and shapes follows from it."""
        return checkpointed(service.drop_unserved_dates(service.feed_shapes(self.feeds, self.counts)))

    @cached_property
    def feed_dates(self) -> DataFrame:
        return service.feed_dates(self.served)

    @cached_property
    def totals(self) -> DataFrame:
        return service.total_trips_per_shape(self.served)

    @cached_property
    def latest(self) -> DataFrame:
        return service.latest_per_shape(self.totals)

    @cached_property
    def chosen(self) -> DataFrame:
        return service.min_trips(self.latest)

    @cached_property
    def feed_keys(self) -> DataFrame:
        """The feeds that serve the route on the dates, before shapes with few trips go."""
        return self.feed_dates.select("feed_key").distinct()

    @cached_property
    def geometry(self) -> DataFrame:
        return service.shape_geometry(self._t("shapes"), DATES, self.feed_keys, self.chosen)

    @cached_property
    def lines(self) -> DataFrame:
        return service.with_lines(service.attach_geometry(self.chosen, self.geometry))

    @cached_property
    def entries(self) -> DataFrame:
        return checkpointed(service.feed_entries(self._t("dim_feeds"), self.feed_keys))

    @cached_property
    def dated_entries(self) -> DataFrame:
        return service.attach_feed_entry(self.feed_dates, self.entries)

    @cached_property
    def trips(self) -> DataFrame:
        return stop_times.valid_trips(self._t("trips"), self.feed_dates, DATES, self.chosen)

    @cached_property
    def stop_times(self) -> DataFrame:
        return stop_times.stop_times_in_feeds(self._t("stop_times"), self.entries, DATES)

    @cached_property
    def joined(self) -> DataFrame:
        return stop_times.trip_stop_times(self.stop_times, self.trips)

    @cached_property
    def summary(self) -> DataFrame:
        return stop_times.timepoint_summary(self.joined)

    @cached_property
    def sequences(self) -> DataFrame:
        return stop_times.stop_sequences(self.joined)

    @cached_property
    def timepoints(self) -> DataFrame:
        """The join of stop times to trips is made once, for its few counts; both summaries follow from these. Kept, as it is
        counted before realtime rows are joined to it."""
        counts = checkpointed(stop_times.stop_counts(self.joined))
        stops = stop_times.stops_in_feeds(self._t("stops"), DATES, self.feed_keys)
        return checkpointed(stop_times.timepoints_on_route(stops, stop_times.summary_of_counts(counts), stop_times.stop_sequences(counts)))

    @cached_property
    def rt(self) -> DataFrame:
        return stop_times.rt_stop_times(self._t("metrics").filter(F.col("service_date").isin(list(DATES))), self.dated_entries)

    @cached_property
    def matched(self) -> DataFrame:
        return stop_times.schedule_rt_stop_times(self.rt, self.trips, self.timepoints)

    @cached_property
    def timed(self) -> DataFrame:
        return segments.segment_seconds(segments.prior_departure(self.matched))

    @cached_property
    def report(self) -> DataFrame:
        return segments.segment_report(self.timed)

    @cached_property
    def validity(self) -> DataFrame:
        rows = segments.with_rt_trip_counts(segments.shape_date_validity(self.timed), segments.rt_trip_counts(self.timed))
        return segments.covers_all_target_dates(rows, len(DATES))

    @cached_property
    def timepoint_list(self) -> DataFrame:
        return segments.timepoint_list(self.matched)

    @cached_property
    def projected(self) -> DataFrame:
        return segments.prior_distance(segments.projected_timepoints(self.timepoint_list, self.lines))

    @cached_property
    def map_rows(self) -> DataFrame:
        return segments.segment_map_rows(segments.segment_lines(self.projected), self.report)


@dataclass
class Corridor(Service):
    """W1 to its end: the timed rows are kept, and report, audit and map rows all follow from them."""

    @cached_property
    def timed(self) -> DataFrame:
        return checkpointed(segments.segment_seconds(segments.prior_departure(self.matched)))

    @cached_property
    def timepoint_list(self) -> DataFrame:
        """Kept, as it is few rows of all the timed ones; so is the audit, which is read to be checked and to be joined."""
        return checkpointed(segments.timepoint_list(self.timed))

    @cached_property
    def validity(self) -> DataFrame:
        return checkpointed(super().validity)

    @cached_property
    def report(self) -> DataFrame:
        return checkpointed(segments.segment_report(self.timed))

    @cached_property
    def rows(self) -> DataFrame:
        """map_rows with the audit of their shape and feed."""
        names = {"n_service_dates": "shape_service_dates", "n_rt_trips": "shape_rt_trips"}
        audit = self.validity.withColumnsRenamed(names)
        return checks.asserted_many_to_one(self.map_rows, audit, ["shape_id", "feed_key"])


@dataclass
class Pings:
    """W3: how often vehicles report, and pings near a stop or signal."""

    spark: SparkSession
    sf_dir: str
    max_gap: float = 40_000

    @cached_property
    def place(self) -> tuple[float, float]:
        x, y = albers(F.lit(PLACE[0]), F.lit(PLACE[1]))
        return tuple(self.spark.range(1).select(x, y).first())

    @cached_property
    def parsed(self) -> DataFrame:
        return avl.parse_event_time(adapted(self.spark, self.sf_dir, "pings"))

    @cached_property
    def gaps(self) -> DataFrame:
        return avl.ping_gaps(self.parsed, tie="event_id")

    @cached_property
    def placed(self) -> DataFrame:
        return avl.with_door_open(avl.with_distance(avl.project_points(self.gaps), *self.place))

    @cached_property
    def near(self) -> DataFrame:
        return avl.with_azimuth(avl.near_point(self.placed), *self.place)

    @cached_property
    def near_signals(self) -> DataFrame:
        return avl.near_points(avl.project_points(self.parsed), self.signals)

    @cached_property
    def signals(self) -> DataFrame:
        x, y = albers(F.col("Long"), F.col("Lat"))
        return adapted(self.spark, self.sf_dir, "signals").select("TspAssetID", x.alias("x"), y.alias("y"))

    @cached_property
    def delays(self) -> DataFrame:
        """Trips of these tables report every few hours: the bounds that pings a second apart want are let go."""
        return avl.intersection_delay(avl.project_points(self.parsed), self.signals, tie="event_id", max_gap=self.max_gap)

    @cached_property
    def ahead(self) -> DataFrame:
        return avl.ahead_of_signal(self.near)


@dataclass
class PingReport(Pings):
    """W3 to its end: gaps are worked out once, and summary, histogram, approach and delay follow from them."""

    @cached_property
    def gaps(self) -> DataFrame:
        return checkpointed(avl.ping_gaps(self.parsed, tie="event_id"))

    @cached_property
    def delays(self) -> DataFrame:
        return avl.intersection_delay(avl.project_points(self.gaps), self.signals, tie="event_id", max_gap=self.max_gap)

    @cached_property
    def overall(self) -> DataFrame:
        """One row: of all gaps the median and third quartile, and the fullest of 50 bins (of equals the first)."""
        summary = avl.gap_summary(self.gaps).select("p50_gap", "p75_gap")
        fullest = avl.histogram(self.gaps, "gap_seconds", 50).agg(F.max_by("bin", F.struct("n_rows", -F.col("bin"))).alias("fullest_bin"), F.max("n_rows").alias("fullest_rows"))
        return summary.join(F.broadcast(fullest))  # one row each

    @cached_property
    def rows(self) -> DataFrame:
        """A row a trip: gaps, those within max_gap, pings near the place and ahead of it, passages of signals and their
        delay; and the overall figures."""
        own = self.placed.groupBy("TRIP_KEY").agg(F.count("gap_seconds").alias("n_gaps"), F.avg("gap_seconds").alias("mean_gap"), F.count_if(F.col("gap_seconds") < self.max_gap).alias("n_within"), F.min("distance").alias("least_distance"))
        near = avl.with_azimuth(avl.near_point(self.placed), *self.place)
        seen = near.groupBy("TRIP_KEY").agg(F.count(F.lit(1)).alias("n_near"), F.count_if(F.col("door_open")).alias("n_open"), F.count_if(F.col("azimuth_to_signal") < 120).alias("n_ahead"))
        held = self.delays.groupBy("TRIP_KEY").agg(F.count(F.lit(1)).alias("n_passages"), F.avg("delay_seconds").alias("mean_delay"))
        rows = own.join(seen, own["TRIP_KEY"].eqNullSafe(seen["TRIP_KEY"]), "left").drop(seen["TRIP_KEY"]).join(held, "TRIP_KEY", "left")
        counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_near", "n_open", "n_ahead", "n_passages")}
        return rows.withColumns(counts).join(F.broadcast(self.overall))  # one row


@dataclass
class Streets:
    """W2: heading ranges at signals, and their validation."""

    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return adapted(self.spark, self.sf_dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        x, y = albers(F.col("lon"), F.col("lat"))
        return self._t("nodes").withColumns({"x": x, "y": y})

    @cached_property
    def signals(self) -> DataFrame:
        x, y = albers(F.col("Long"), F.col("Lat"))
        return self._t("signals").select("TspAssetID", "Name", x.alias("x"), y.alias("y"))

    @cached_property
    def bearings(self) -> DataFrame:
        return network.drop_loops(network.edge_bearings(self.nodes, self._t("edges")))

    def lined(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges with their line: by way of their bend, if they have one, else straight."""
        x, y = albers(F.col("lon"), F.col("lat"))
        bend = self._t("bends").select("u", "v", "key", F.struct(x.alias("x"), y.alias("y")).alias("_bend"))
        rows = network.with_lines(edges, nodes).join(bend, ["u", "v", "key"], "left")
        bent = F.array(F.col("line")[0], F.col("_bend"), F.col("line")[1])
        return rows.withColumn("line", F.when(F.col("_bend").isNotNull(), bent).otherwise(F.col("line"))).drop("_bend")

    @cached_property
    def oriented(self) -> DataFrame:
        """The configured streets follow from the whole network here, but are few: kept, and met in place."""
        return network.street_orientation(self.bearings, checkpointed(self._t("streets")))

    @cached_property
    def near(self) -> DataFrame:
        return network.nearest_within(self.signals, self.nodes.select("osmid", "x", "y"), "TspAssetID")

    @cached_property
    def ends(self) -> DataFrame:
        """Kept: later steps join the in-edges with themselves, and would plan and run the whole network for each side."""
        return checkpointed(network.in_edges(self.oriented, self.near.filter("osmid IS NOT NULL").select("osmid")))

    @cached_property
    def bounds(self) -> DataFrame:
        return network.bearing_bounds(self.ends)

    @cached_property
    def triangles(self) -> DataFrame:
        """At the ends of in-edges; the network must have lines, as that of StudyArea has."""
        return validation.in_edge_triangles(self.directed)

    @cached_property
    def propagated(self) -> DataFrame:
        return network.propagate_orientation(self.bounds)

    @cached_property
    def directed(self) -> DataFrame:
        return network.assign_directions(self.propagated)

    @cached_property
    def ranges(self) -> DataFrame:
        return network.node_heading_ranges(self.directed)

    @cached_property
    def signal_ranges(self) -> DataFrame:
        return network.signals_with_ranges(self.signals, self.nodes, self.ranges)

    @cached_property
    def headings(self) -> DataFrame:
        return with_heading_keys(self._t("headings").withColumnRenamed("Route_Direction", "Route Direction"))

    @cached_property
    def long(self) -> DataFrame:
        return validation.ranges_long(self._t("ranges"))

    @cached_property
    def matched(self) -> DataFrame:
        return validation.match_headings(validation.ranges_by_direction(self.long), self.headings)

    @cached_property
    def flags(self) -> DataFrame:
        return validation.heading_flags(self.matched)


@dataclass
class StudyArea(Streets):
    """W2 from the raw network on: clipped to the study area (a ring in metres), its junctions merged, then as Streets."""

    ring: tuple[tuple[float, float], ...] = ()

    @cached_property
    def merged(self) -> tuple[DataFrame, DataFrame]:
        every = Streets(self.spark, self.sf_dir).nodes
        edges = checkpointed(network.clip_to_study_area(every, self.lined(self._t("edges"), every), self.ring))
        ends = edges.select(F.explode(F.array("u", "v")).alias("osmid")).distinct()
        nodes, edges = network.consolidate_intersections(every.join(ends, "osmid", "left_semi"), edges)
        return checkpointed(nodes), checkpointed(edges)

    @cached_property
    def near(self) -> DataFrame:
        """Kept, as small as the signals are; the in-edges, of which all else follows, are too."""
        return checkpointed(network.nearest_within(self.signals, self.nodes.select("osmid", "x", "y"), "TspAssetID"))

    @cached_property
    def long(self) -> DataFrame:
        """Of the ranges worked out here, not of given ones."""
        return validation.ranges_long(self.signal_ranges)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.merged[0]

    @cached_property
    def bearings(self) -> DataFrame:
        return network.drop_loops(network.edge_bearings(self.nodes, self.merged[1]))
