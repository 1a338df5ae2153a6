"""Vehicle pings: reporting frequency, and approach to stops and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .network import CELL_PARTS, grid_pairs
from .percentiles import weighted_percentiles
from .shared import checkpointed, with_previous

DOORS = ("STOP_BACK_DOOR_ENTRY", "STOP_FRONT_DOOR_ENTRY", "STOP_FRONT_DOOR_EXIT", "STOP_BACK_DOOR_EXIT")


def parse_event_time(df: DataFrame) -> DataFrame:
    """Adds event_at; null where EVENT_TIME is null or no date."""
    return df.withColumn("event_at", C.event_at(F.col("EVENT_TIME")))


def unparsed_event_times(df: DataFrame) -> DataFrame:
    """One row: pings, and those without a time."""
    return df.agg(F.count(F.lit(1)).alias("n_pings"), F.count_if(F.col("event_at").isNull()).alias("n_unparsed"))


def pings_per_route_trip(df: DataFrame) -> DataFrame:
    """Pings by route_trip, sorted by it; without pings whose route or trip is null."""
    label = F.concat("ROUTE_ID", F.lit("_"), F.col("TRIP_KEY").cast("string")).alias("route_trip")
    return df.select(label).dropna().groupBy("route_trip").agg(F.count(F.lit(1)).alias("n_pings")).orderBy("route_trip")


def _seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def ping_gaps(df: DataFrame, keys: Sequence[str] = ("TRIP_KEY",), tie: str | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Adds gap_seconds since the ping before of the same keys. Pings without a time come last; a null key has no gap.

    Trip keys recur every day: give the date and vehicle as further keys where they are known. A key's pings are put in
    order within bucket_seconds at a time, so that a key with most of the pings is spread over many tasks.
    """
    bucket = F.floor(_seconds(F.col("event_at")) / bucket_seconds)
    rows = with_previous(df, keys, [bucket], ["event_at", *([tie] if tie else [])], "event_at", "_prior")
    return rows.withColumn("gap_seconds", _seconds(F.col("event_at")) - _seconds(F.col("_prior"))).drop("_prior")


def value_counts(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """v (and by): how many rows, n, have each value; nulls left out. Written once: summaries and histograms follow from it
    without the rows. Tables of parts of the rows may be added up."""
    keys = [by] if by else []
    return checkpointed(df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")))


def gap_summary(df: DataFrame, column: str = "gap_seconds") -> DataFrame:
    """One row: count, mean, sample standard deviation, least, quartiles (exact), largest; from the counts of distinct
    values, which are far fewer than pings, as gaps are mostly whole seconds."""
    counts = value_counts(df, column)
    plain = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_gaps"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_gap"), F.min("v").alias("min_gap"), F.max("v").alias("max_gap"))
    around = counts.join(F.broadcast(plain.select("mean_gap", "n_gaps")))  # one row
    spread = around.agg(F.sqrt(F.sum((F.col("v") - F.col("mean_gap")) ** 2 * F.col("n")) / F.nullif(F.first("n_gaps") - 1, F.lit(0))).alias("std_gap"))
    quart = weighted_percentiles(counts, [], "v", "n", {"p25_gap": 0.25, "p50_gap": 0.5, "p75_gap": 0.75})
    rows = plain.join(F.broadcast(spread)).join(F.broadcast(quart), how="left")  # one row each
    return rows.select("n_gaps", "mean_gap", "std_gap", "min_gap", "max_gap", "p25_gap", "p50_gap", "p75_gap")


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """bin, n_rows (by the column by, if any): equal widths from the least to the largest value, the last bin closed.

    Bins without rows are listed. If all values are equal the range is widened by half to each side. The rows are read
    once, for their value_counts().
    """
    return histogram_of_counts(value_counts(df, column, by), bins, by)


def histogram_of_counts(counts: DataFrame, bins: int, by: str | None = None) -> DataFrame:
    """histogram() of rows whose value_counts() these are."""
    keys = [by] if by else []
    v, lo, hi = F.col("v"), F.col("_lo"), F.col("_hi")
    wide = F.when(F.col("least") == F.col("most"), 0.5).otherwise(0)
    ends = counts.agg(F.min("v").alias("least"), F.max("v").alias("most")).filter("least IS NOT NULL").select((F.col("least") - wide).alias("_lo"), (F.col("most") + wide).alias("_hi"))
    place = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    filled = counts.join(F.broadcast(ends)).groupBy(*keys, place.alias("bin")).agg(F.sum("n").alias("n_rows"))  # one row
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every = (counts.select(*keys).distinct() if by else ends).select(*keys, numbers)
    same = every["bin"] == filled["bin"]
    if by:
        same = same & every[by].eqNullSafe(filled[by])
    return every.join(filled, same, "left").select(*(every[k] for k in keys), every["bin"], F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def within_gap(df: DataFrame, max_gap: float = 30) -> DataFrame:
    return df.filter(F.col("gap_seconds") < max_gap)


def project_points(df: DataFrame, lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Adds x, y in metres; drops rows without coordinates."""
    x, y = C.albers(F.col(lon), F.col(lat))
    return df.dropna(subset=[lon, lat]).withColumns({"x": x, "y": y})


def with_distance(df: DataFrame, x0: float, y0: float, name: str = "distance") -> DataFrame:
    return df.withColumn(name, C.distance_to_point(F.col("x"), F.col("y"), x0, y0))


def with_door_open(df: DataFrame) -> DataFrame:
    return df.withColumn("door_open", C.door_open([F.col(d) for d in DOORS]))


def near_point(df: DataFrame, max_m: float = 200, route: str | None = "104") -> DataFrame:
    """Pings less than max_m from the point, of one route (blanks around its name do not count)."""
    near = df.filter(F.col("distance") < max_m)
    return near if route is None else near.filter(F.trim("ROUTE_ID") == route)


def near_points(df: DataFrame, places: DataFrame, max_m: float = 200) -> DataFrame:
    """Pings (x, y) with every place (x, y, and columns of its own) less than max_m away, the distance, and the direction
    from the place to the bus (azimuth_to_signal). Joined on the cells of a grid; without places or coordinates no rows."""
    where = places.withColumns({"_px": F.col("x"), "_py": F.col("y")})
    pairs = grid_pairs(df, where, max_m, strict=True, parts=CELL_PARTS)
    return pairs.withColumn("azimuth_to_signal", C.azimuth_from_point(F.col("x"), F.col("y"), F.col("_px"), F.col("_py"))).drop("_px", "_py")


def with_azimuth(df: DataFrame, x0: float, y0: float) -> DataFrame:
    """Adds azimuth_to_signal, which is the direction from the signal to the bus."""
    return df.withColumn("azimuth_to_signal", C.azimuth_from_point(F.col("x"), F.col("y"), x0, y0))


def ahead_of_signal(df: DataFrame, max_azimuth: float = 120) -> DataFrame:
    return df.filter(F.col("azimuth_to_signal") < max_azimuth)


def trip_pings(df: DataFrame, trip_key: int, columns: Sequence[str]) -> DataFrame:
    return df.filter(F.col("TRIP_KEY") == trip_key).select(*columns)


def dwells(df: DataFrame, keys: Sequence[str] = ("TRIP_KEY",), tie: str | None = None) -> DataFrame:
    """Runs of pings with a door open: keys, start, end, n_pings, dwell_seconds. Pings without a time are left out."""
    order = Window.partitionBy(*keys).orderBy("event_at", *([tie] if tie else []))
    begins = F.when(F.col("door_open") & ~F.coalesce(F.lag("door_open").over(order), F.lit(False)), 1).otherwise(0)
    runs = df.filter("event_at IS NOT NULL").withColumn("_new", begins).withColumn("_run", F.sum("_new").over(order)).filter("door_open")
    each = runs.groupBy(*keys, "_run").agg(F.min("event_at").alias("start"), F.max("event_at").alias("end"), F.count(F.lit(1)).alias("n_pings"))
    return each.withColumn("dwell_seconds", _seconds(F.col("end")) - _seconds(F.col("start"))).drop("_run")


#: Speed in metres a second that a bus has where nothing holds it.
FREE_SPEED = 11.0


def ping_legs(df: DataFrame, keys: Sequence[str] = ("TRIP_KEY",), tie: str | None = None, max_gap: float = 30, max_leg_m: float = 600) -> DataFrame:
    """keys, t0, x0, y0, t1, x1, y1 (seconds and metres) of every ping and the one before it on the trip, and usable: that
    they are at most max_gap seconds and max_leg_m apart, so that the way between them may be taken for straight. Pings
    without time or place are left out."""
    known = df.dropna(subset=["event_at", "x", "y", *keys]).withColumn("_at", F.struct(_seconds(F.col("event_at")).alias("t"), "x", "y"))
    tied = [tie] if tie else ["x", "y"]
    rows = with_previous(known, keys, [F.floor(_seconds(F.col("event_at")) / 3600)], ["event_at", *tied], "_at", "_prior").filter("_prior IS NOT NULL")
    ends = {f"{c}{i}": F.col(f"{s}.{c}") for c in ("t", "x", "y") for i, s in ((0, "_prior"), (1, "_at"))}
    legs = rows.select(*keys, *(e.alias(n) for n, e in ends.items()))
    return legs.withColumn("usable", (F.col("t1") - F.col("t0") <= max_gap) & (F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= max_leg_m))


def legs_in_reach(legs: DataFrame, signals: DataFrame, reach_m: float, max_leg_m: float = 600) -> DataFrame:
    """Legs with every signal (TspAssetID, x, y) whose circle of reach_m they touch, and what they do there, as shares of
    the leg: from in_share to out_share it is inside, nearest at near_share (near_m away); enters and leaves say whether it
    crosses the circle. An unusable leg that ends inside comes as broken, without shares.

    Legs meet signals on the cells of a grid that is as wide as the reach and half the longest leg; those of a cell are
    dealt to many parts, as most legs may lie around one signal.
    """
    mid = lambda a: F.when(F.col("usable"), (F.col(f"{a}0") + F.col(f"{a}1")) / 2).otherwise(F.col(f"{a}1"))
    places = signals.select("TspAssetID", F.col("x").alias("_sx"), F.col("y").alias("_sy"), "x", "y")
    pairs = grid_pairs(legs.withColumns({"x": mid("x"), "y": mid("y")}), places, reach_m + max_leg_m / 2, parts=CELL_PARTS).drop("x", "y", "distance")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fx, fy = F.col("x0") - F.col("_sx"), F.col("y0") - F.col("_sy")
    pairs = pairs.withColumns({"_a": dx * dx + dy * dy, "_b": fx * dx + fy * dy, "_c": fx * fx + fy * fy - reach_m * reach_m})
    root = F.sqrt(F.greatest(F.col("_b") * F.col("_b") - F.col("_a") * F.col("_c"), F.lit(0.0)))
    still = F.col("_a") == 0
    lo = F.when(still, F.lit(float("-inf"))).otherwise(F.try_divide(-F.col("_b") - root, F.col("_a")))
    hi = F.when(still, F.lit(float("inf"))).otherwise(F.try_divide(-F.col("_b") + root, F.col("_a")))
    touches = F.when(still, F.col("_c") < 0).otherwise(F.col("_b") * F.col("_b") > F.col("_a") * F.col("_c"))
    pairs = pairs.withColumns({"_lo": lo, "_hi": hi, "_touches": touches, "length": F.sqrt("_a")})
    pairs = pairs.withColumns({"in_share": F.greatest(F.lit(0.0), "_lo"), "out_share": F.least(F.lit(1.0), "_hi"), "broken": ~F.col("usable")})
    ends_inside = F.hypot(F.col("x1") - F.col("_sx"), F.col("y1") - F.col("_sy")) < reach_m
    near = F.when(still, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-F.col("_b"), F.col("_a")))))
    rows = pairs.filter(F.when(F.col("usable"), F.col("_touches") & (F.col("in_share") < F.col("out_share"))).otherwise(ends_inside)).withColumn("near_share", near)
    rows = rows.withColumns(
        {"near_m": F.hypot(fx + F.col("near_share") * dx, fy + F.col("near_share") * dy), "enters": F.col("usable") & (F.col("_lo") >= 0), "leaves": F.col("usable") & (F.col("_hi") <= 1), "entry_azimuth": C.azimuth_from_point(fx + F.col("in_share") * dx, fy + F.col("in_share") * dy, 0.0, 0.0)}
    )
    return rows.drop("_a", "_b", "_c", "_lo", "_hi", "_touches", "_sx", "_sy", "usable")


def passages(legs: DataFrame, keys: Sequence[str] = ("TRIP_KEY",)) -> DataFrame:
    """Each time a trip goes through a signal's circle: keys, TspAssetID, entered, crossed (nearest to the signal), left
    (seconds), metres driven inside, least_m to the signal, entry_azimuth (from the signal to the bus as it enters).

    legs: legs_in_reach(). An entry is matched with the exit that follows it on the trip. Stays that begin or end in a gap
    of the pings, or have one within, are left out.
    """
    group = Window.partitionBy(*keys, "TspAssetID").orderBy("t0", "t1", "x0", "y0")
    begins = F.when(F.col("enters") | F.col("broken"), 1).otherwise(0)
    stays = legs.withColumn("_stay", F.sum(begins).over(group))
    at = lambda share: F.col("t0") + F.col(share) * (F.col("t1") - F.col("t0"))
    each = stays.groupBy(*keys, "TspAssetID", "_stay").agg(
        F.max("enters").alias("_in"),
        F.max("leaves").alias("_out"),
        F.max("broken").alias("_broken"),
        F.min(at("in_share")).alias("entered"),
        F.min_by(at("near_share"), F.struct("near_m", "t0")).alias("crossed"),
        F.max(at("out_share")).alias("left"),
        F.sum((F.col("out_share") - F.col("in_share")) * F.col("length")).alias("metres"),
        F.min("near_m").alias("least_m"),
        F.min_by("entry_azimuth", F.struct("t0", "t1")).alias("entry_azimuth"),
    )
    return each.filter("_in AND _out AND NOT _broken").drop("_in", "_out", "_broken", "_stay")


def intersection_delay(pings: DataFrame, signals: DataFrame, keys: Sequence[str] = ("TRIP_KEY",), tie: str | None = None, reach_m: float = 100, max_gap: float = 30, max_leg_m: float = 600, free_speed: float = FREE_SPEED) -> DataFrame:
    """passages() of the pings (event_at, x, y) at the signals, with seconds inside, approach_seconds (entry to crossing),
    delay_seconds: what the passage took beyond its way at free_speed, none below zero, and direction: the compass quarter
    that the bus comes from."""
    rows = passages(legs_in_reach(ping_legs(pings, keys, tie, max_gap, max_leg_m), signals, reach_m, max_leg_m), keys)
    seconds = F.col("left") - F.col("entered")
    quarter = F.element_at(F.array(*map(F.lit, ("north", "east", "south", "west"))), (F.floor(F.pmod(F.col("entry_azimuth") + 45, F.lit(360.0)) / 90) + 1).cast("int"))
    return rows.withColumns(
        {"seconds": seconds, "approach_seconds": F.col("crossed") - F.col("entered"), "delay_seconds": F.greatest(F.lit(0.0), seconds - F.col("metres") / free_speed), "comes_from": quarter}
    )
