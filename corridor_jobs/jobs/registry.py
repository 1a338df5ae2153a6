"""Every operator as a query over the test tables, with DuckDB SQL for its result."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.linear import measured
from ..operators import avl, checks, network, segments, service, stop_times, validation
from ..sources.adapters import adapted, oracle
from .workloads import DATES, PLACE, Corridor, PingReport, Pings, Service, Streets, StudyArea

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ON = "(" + ", ".join(f"DATE '{d}'" for d in DATES) + ")"


def _r(column: str, digits: int) -> str:
    return f"round({column}, {digits}) AS {column}"


def _albers(lon: str, lat: str) -> tuple[str, str]:
    """EPSG:3310 in SQL, its constants from the same definition."""
    q = lambda s: C._q(s)
    m1, m2 = C._m(math.radians(C.SP1)), C._m(math.radians(C.SP2))
    q0, q1, q2 = (q(math.sin(math.radians(d))) for d in (C.LAT0, C.SP1, C.SP2))
    n = (m1**2 - m2**2) / (q2 - q1)
    c, e = m1**2 + n * q1, C._E
    rho0 = C.GRS80_A * math.sqrt(c - n * q0) / n
    s = f"sin(radians({lat}))"
    qq = f"(CAST({1 - e * e!r} AS DOUBLE) * ({s} / (1 - ({s} * {e!r}) * ({s} * {e!r})) - ln((1 - {s} * {e!r}) / (1 + {s} * {e!r})) / (2 * {e!r})))"
    rho = f"(sqrt(CAST({c!r} AS DOUBLE) - {qq} * {n!r}) * {C.GRS80_A!r} / {n!r})"
    theta = f"(radians({lon} - ({C.LON0!r})) * {n!r})"
    return f"({rho} * sin({theta}))", f"({rho0!r} - {rho} * cos({theta}) + ({C.FALSE_NORTHING!r}))"


def _pmod(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


_X, _Y = _albers("lon", "lat")
_PX, _PY = _albers("LONGITUDE", "LATITUDE")
_X0, _Y0 = _albers(f"CAST('{PLACE[0]}' AS DOUBLE)", f"CAST('{PLACE[1]}' AS DOUBLE)")
_UP = "CASE WHEN {b} > {a} THEN {b} - {a} ELSE {b} - {a} + 360 END"
_DOWN = "CASE WHEN {a} > {b} THEN {a} - {b} ELSE {a} - {b} + 360 END"


def _gap(a: str, b: str) -> str:
    return f"least({_UP.format(a=a, b=b)}, {_DOWN.format(a=a, b=b)})"


_BEARING = _pmod(
    "degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)),"
    " cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))))"
)
_DIRS = ("north", "south", "east", "west")
_WIDE = ", ".join(f"max(bearing_lower_bound) FILTER (WHERE direction = '{d}') AS {d}_min, max(bearing_upper_bound) FILTER (WHERE direction = '{d}') AS {d}_max" for d in _DIRS)
_RATIO = "CASE WHEN p20 = 0 THEN CASE WHEN p80 = 0 THEN CAST('nan' AS DOUBLE) WHEN p80 > 0 THEN CAST('inf' AS DOUBLE) END ELSE p80 / p20 END"

#: Results of the steps as common table expressions for the oracles.
STEPS = {
    "feeds_on": f"SELECT feed_key, date AS service_date FROM feeds WHERE date IN {_ON} AND gtfs_dataset_name = 'City Schedule'",
    "counts": f"SELECT service_date, shape_id, route_id, route_short_name, feed_key, count(*) AS ct FROM trips WHERE service_date IN {_ON} AND route_short_name = '3' GROUP BY ALL",
    "feedshapes": "SELECT f.feed_key, f.service_date, shape_id, route_id, route_short_name, ct FROM feeds_on f LEFT JOIN counts c ON f.feed_key = c.feed_key AND f.service_date = c.service_date",
    "served": "SELECT * FROM feedshapes WHERE shape_id IS NOT NULL",
    "fdates": "SELECT DISTINCT service_date, feed_key FROM served",
    "totals": "SELECT feed_key, service_date, shape_id, route_id, route_short_name, CAST(sum(ct) OVER (PARTITION BY shape_id) AS BIGINT) AS ct FROM served",
    "latest": "SELECT feed_key, service_date AS last_seen_date, shape_id, route_id, route_short_name, ct FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, feed_key ORDER BY service_date DESC, route_id) AS n FROM totals) WHERE n = 1",
    "chosen": "SELECT * FROM latest WHERE ct >= 10",
    "geometry": f"SELECT shape_id, feed_key, pt_array FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, feed_key ORDER BY service_date DESC) AS n FROM shapes WHERE service_date IN (SELECT last_seen_date FROM chosen) AND shape_id IN (SELECT shape_id FROM chosen) AND feed_key IN (SELECT feed_key FROM fdates)) WHERE n = 1",
    "drawn": "SELECT c.shape_id, c.feed_key, last_seen_date, route_id, route_short_name, ct, pt_array FROM chosen c JOIN geometry g ON c.shape_id = g.shape_id AND c.feed_key = g.feed_key WHERE pt_array IS NOT NULL",
    "entries": "SELECT key AS feed_key, base64_url, _valid_from FROM dim_feeds WHERE key IN (SELECT feed_key FROM fdates)",
    "dated": "SELECT f.feed_key, service_date, base64_url, _valid_from FROM fdates f JOIN entries e ON f.feed_key = e.feed_key",
    "vtrips": f"SELECT t.service_date, t.feed_key, trip_id, shape_id, direction_id FROM trips t JOIN fdates f ON t.service_date = f.service_date AND t.feed_key = f.feed_key WHERE t.service_date IN {_ON} AND shape_id IN (SELECT shape_id FROM chosen) AND t.feed_key IN (SELECT feed_key FROM fdates)",
    "vstops": "SELECT feed_key, stop_id, trip_id, timepoint, stop_sequence FROM stop_times WHERE feed_key IN (SELECT feed_key FROM fdates) AND _feed_valid_from IN (SELECT _valid_from FROM entries)",
    "joined": "SELECT s.*, shape_id FROM vstops s JOIN vtrips t ON s.trip_id = t.trip_id AND s.feed_key = t.feed_key",
    "summary": "SELECT stop_id, shape_id, CAST(sum(timepoint) AS BIGINT) AS n_timepoint, count(*) AS n_stop_times FROM joined GROUP BY stop_id, shape_id",
    "sequences": "SELECT DISTINCT stop_id, stop_sequence FROM joined",
    "timepoints": f"SELECT m.stop_id, n_timepoint, n_stop_times, shape_id, stop_sequence, pt_geom FROM summary m JOIN (SELECT stop_id, min(pt_geom) AS pt_geom FROM stops WHERE service_date IN {_ON} AND feed_key IN (SELECT feed_key FROM fdates) GROUP BY stop_id) p ON m.stop_id = p.stop_id JOIN sequences q ON m.stop_id = q.stop_id WHERE n_timepoint = n_stop_times",
    "rt": f"SELECT m.* FROM metrics m JOIN (SELECT DISTINCT service_date, base64_url FROM dated) d ON m.service_date = d.service_date AND m.schedule_base64_url = d.base64_url WHERE m.service_date IN {_ON}",
    "matched": "SELECT r.service_date, r.trip_id, trip_key, r.stop_id, t.feed_key, t.shape_id, r.stop_sequence, actual_arrival_pacific, actual_departure_pacific, n_predictions, pt_geom FROM rt r JOIN vtrips t ON r.service_date = t.service_date AND r.trip_id = t.trip_id JOIN timepoints p ON r.stop_sequence = p.stop_sequence AND t.shape_id = p.shape_id",
    "priors": "SELECT *, lag(actual_departure_pacific) OVER (PARTITION BY service_date, shape_id, feed_key, trip_id ORDER BY trip_key, stop_sequence, stop_id, pt_geom NULLS FIRST) AS prior_departure FROM matched",
    "timed": "SELECT *, CASE WHEN epoch_us(actual_arrival_pacific) >= epoch_us(prior_departure) THEN CAST((epoch_us(actual_arrival_pacific) - epoch_us(prior_departure)) // 1000000 % 86400 AS BIGINT) END AS segment_seconds FROM priors",
    "spread": "SELECT shape_id, feed_key, stop_sequence, quantile_cont(segment_seconds, 0.8) AS p80, quantile_cont(segment_seconds, 0.2) AS p20, count(trip_id) AS n_rt_trips, count(DISTINCT service_date) AS n_service_dates FROM timed GROUP BY shape_id, feed_key, stop_sequence",
    "report": f"SELECT shape_id, feed_key, stop_sequence, {_RATIO} AS travel_time_variability, CAST(p80 AS DOUBLE) AS p80_travel_time_seconds, CAST(p20 AS DOUBLE) AS p20_travel_time_seconds, n_rt_trips, n_service_dates FROM spread",
    "validity": "SELECT shape_id, feed_key, min(service_date) AS first_service_date, max(service_date) AS last_service_date, count(DISTINCT service_date) AS n_service_dates, string_agg(DISTINCT CAST(service_date AS VARCHAR), ', ' ORDER BY CAST(service_date AS VARCHAR)) AS service_dates FROM timed GROUP BY shape_id, feed_key",
    "tripcounts": "SELECT shape_id, count(*) AS n_rt_trips FROM (SELECT DISTINCT shape_id, feed_key, service_date, trip_id FROM timed) GROUP BY shape_id",
    "tplist": "SELECT DISTINCT shape_id, feed_key, stop_sequence, stop_id, pt_geom FROM matched",
    "vertices": "SELECT shape_id, feed_key, i, CAST(regexp_extract(pt_array[i], '\\(([-0-9.]+) ', 1) AS DOUBLE) AS x, CAST(regexp_extract(pt_array[i], ' ([-0-9.]+)\\)', 1) AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, len(pt_array) + 1)) AS i FROM drawn WHERE len(pt_array) > 1)",
    "legs": "SELECT *, sum(size) OVER (PARTITION BY shape_id, feed_key ORDER BY i) - size AS m FROM (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS size FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY shape_id, feed_key ORDER BY i)) a WHERE x2 IS NOT NULL) b",
    "tppoints": "SELECT *, CAST(regexp_extract(pt_geom, '\\(([-0-9.]+) ', 1) AS DOUBLE) AS px, CAST(regexp_extract(pt_geom, ' ([-0-9.]+)\\)', 1) AS DOUBLE) AS py FROM tplist WHERE pt_geom IS NOT NULL",
    "feet": "SELECT *, m + t * size AS d, sqrt((x + t * (x2 - x) - px) * (x + t * (x2 - x) - px) + (y + t * (y2 - y) - py) * (y + t * (y2 - y) - py)) AS off FROM (SELECT p.*, i, x, y, x2, y2, size, m, CASE WHEN size > 0 THEN greatest(0, least(1, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / (size * size))) ELSE 0 END AS t FROM tppoints p JOIN legs l ON p.shape_id = l.shape_id AND p.feed_key = l.feed_key) z",
    "nearfeet": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, feed_key, stop_sequence, stop_id, pt_geom ORDER BY off, i) AS n FROM feet) WHERE n = 1",
    "onlines": "SELECT t.*, f.d AS distance, lag(f.d) OVER (PARTITION BY t.shape_id, t.feed_key ORDER BY t.stop_sequence, t.stop_id, t.pt_geom NULLS FIRST) AS prior_distance FROM tplist t LEFT JOIN nearfeet f ON t.shape_id = f.shape_id AND t.feed_key = f.feed_key AND t.stop_sequence = f.stop_sequence AND t.stop_id = f.stop_id AND t.pt_geom = f.pt_geom",
    "cutends": "SELECT shape_id, feed_key, stop_sequence, stop_id, pt_geom, least(distance, prior_distance) AS lo, greatest(distance, prior_distance) AS hi, distance > prior_distance AS back FROM onlines WHERE distance IS NOT NULL AND prior_distance IS NOT NULL",
    "cutpoints": "SELECT c.shape_id, c.feed_key, stop_sequence, stop_id, pt_geom, back, lo AS d, 0 AS part FROM cutends c UNION ALL SELECT c.shape_id, c.feed_key, stop_sequence, stop_id, pt_geom, back, m, 1 FROM cutends c JOIN legs l ON c.shape_id = l.shape_id AND c.feed_key = l.feed_key AND m > lo AND m < hi UNION ALL SELECT shape_id, feed_key, stop_sequence, stop_id, pt_geom, back, hi, 2 FROM cutends WHERE hi > lo",
    "cutvertices": "SELECT c.shape_id, c.feed_key, stop_sequence, stop_id, pt_geom, row_number() OVER (PARTITION BY c.shape_id, c.feed_key, stop_sequence, stop_id, pt_geom ORDER BY CASE WHEN back THEN -d ELSE d END, CASE WHEN back THEN -part ELSE part END) AS vertex, x + (d - m) / size * (x2 - x) AS x, y + (d - m) / size * (y2 - y) AS y FROM cutpoints c ASOF JOIN legs l ON c.shape_id = l.shape_id AND c.feed_key = l.feed_key AND c.d >= l.m",
    # pings
    "parsed": "SELECT *, try_strptime(lpad(CAST(CAST(EVENT_TIME AS BIGINT) AS VARCHAR), 12, '0'), '%y%m%d%H%M%S') AS event_at FROM pings",
    "gaps": "SELECT *, CASE WHEN TRIP_KEY IS NOT NULL THEN epoch_us(event_at) / 1e6 - epoch_us(lag(event_at) OVER (PARTITION BY TRIP_KEY ORDER BY event_at NULLS LAST, event_id)) / 1e6 END AS gap_seconds FROM parsed",
    "spot": f"SELECT {_X0} AS x0, {_Y0} AS y0",
    "placed0": f"SELECT *, {_PX} AS x, {_PY} AS y FROM gaps WHERE LONGITUDE IS NOT NULL AND LATITUDE IS NOT NULL",
    "placed": "SELECT *, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS distance, coalesce(STOP_BACK_DOOR_ENTRY, 0) <> 0 OR coalesce(STOP_FRONT_DOOR_ENTRY, 0) <> 0 OR coalesce(STOP_FRONT_DOOR_EXIT, 0) <> 0 OR coalesce(STOP_BACK_DOOR_EXIT, 0) <> 0 AS door_open FROM placed0, spot",
    "nearby": f"SELECT *, {_pmod('degrees(atan2(x - x0, y - y0))')} AS azimuth_to_signal FROM placed WHERE distance < 200 AND trim(ROUTE_ID) = '104'",
    "plegs": "SELECT * FROM (SELECT TRIP_KEY, event_id, epoch_us(lag(event_at) OVER w) / 1e6 AS t0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, epoch_us(event_at) / 1e6 AS t1, x AS x1, y AS y1 FROM placed0 WHERE event_at IS NOT NULL AND TRIP_KEY IS NOT NULL WINDOW w AS (PARTITION BY TRIP_KEY ORDER BY event_at, event_id)) z WHERE t0 IS NOT NULL",
    # streets
    "xynodes": f"SELECT osmid, lon, lat, {_X} AS x, {_Y} AS y FROM nodes",
    "xysignals0": "SELECT TspAssetID, Name, Long AS lon, Lat AS lat FROM signals",
    "xysignals": f"SELECT TspAssetID, Name, {_X} AS x, {_Y} AS y FROM xysignals0",
    "pairs0": "SELECT l.*, TspAssetID, t1 - t0 <= 40000 AND sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) <= 600 AS usable, x0 - s.x AS fx, y0 - s.y AS fy, x1 - x0 AS dx, y1 - y0 AS dy, sqrt((x1 - s.x) * (x1 - s.x) + (y1 - s.y) * (y1 - s.y)) < 100 AS inside FROM plegs l, xysignals s WHERE greatest(x0, x1) > s.x - 100 AND least(x0, x1) < s.x + 100 AND greatest(y0, y1) > s.y - 100 AND least(y0, y1) < s.y + 100",
    "pairs1": "SELECT *, dx * dx + dy * dy AS a, fx * dx + fy * dy AS b, fx * fx + fy * fy - 10000 AS c FROM pairs0",
    "pairs2": "SELECT *, CASE WHEN a = 0 THEN CAST('-inf' AS DOUBLE) ELSE (-b - sqrt(greatest(b * b - a * c, 0))) / a END AS lo, CASE WHEN a = 0 THEN CAST('inf' AS DOUBLE) ELSE (-b + sqrt(greatest(b * b - a * c, 0))) / a END AS hi, CASE WHEN a = 0 THEN 0 ELSE greatest(0, least(1, -b / a)) END AS near FROM pairs1",
    "reaches": "SELECT *, greatest(0, lo) AS ins, least(1, hi) AS outs, sqrt((fx + near * dx) * (fx + near * dx) + (fy + near * dy) * (fy + near * dy)) AS near_m, usable AND lo >= 0 AS enters, usable AND hi <= 1 AS leaves FROM pairs2 WHERE CASE WHEN usable THEN CASE WHEN a = 0 THEN c < 0 ELSE b * b > a * c END AND greatest(0, lo) < least(1, hi) ELSE inside END",
    "stays": "SELECT *, sum(CASE WHEN enters OR NOT usable THEN 1 ELSE 0 END) OVER (PARTITION BY TRIP_KEY, TspAssetID ORDER BY t0, t1, x0, y0 ROWS UNBOUNDED PRECEDING) AS stay FROM reaches",
    "passed": f"SELECT TRIP_KEY, TspAssetID, min(t0 + ins * (t1 - t0)) AS entered, arg_min(t0 + near * (t1 - t0), {{'a': near_m, 'b': t0}}) AS crossed, max(t0 + outs * (t1 - t0)) AS gone, sum((outs - ins) * sqrt(a)) AS metres, min(near_m) AS least_m, arg_min({_pmod('degrees(atan2(fx + ins * dx, fy + ins * dy))')}, t0) AS entry_azimuth FROM stays GROUP BY TRIP_KEY, TspAssetID, stay HAVING bool_or(enters) AND bool_or(leaves) AND bool_and(usable)",
    "bearings": f"SELECT u, v, key, name, {_BEARING} AS bearing FROM edges e JOIN nodes a ON e.u = a.osmid JOIN nodes b ON e.v = b.osmid WHERE u <> v",
    "oriented": "SELECT e.*, orientation, CASE WHEN s.name IS NOT NULL THEN true END AS transit FROM bearings e LEFT JOIN streets s ON e.name = s.name",
    "reach": "SELECT s.TspAssetID, n.osmid, sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) AS distance FROM xysignals s, xynodes n",
    "nearest": "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY TspAssetID ORDER BY distance) AS n FROM reach WHERE distance <= 50) WHERE n = 1",
    "ends": "SELECT * FROM oriented WHERE v IN (SELECT osmid FROM nearest)",
    "halves": f"SELECT a.v, a.u, a.key, min({_UP.format(a='a.bearing', b='b.bearing')}) / 2 AS up, min({_DOWN.format(a='a.bearing', b='b.bearing')}) / 2 AS down FROM ends a JOIN ends b ON a.v = b.v AND NOT (a.u = b.u AND a.key = b.key) GROUP BY a.v, a.u, a.key",
    "bounds": f"SELECT e.*, round_even({_pmod('bearing - down')}, 0) AS bearing_lower_bound, round_even({_pmod('bearing + up')}, 0) AS bearing_upper_bound FROM ends e LEFT JOIN halves h ON e.v = h.v AND e.u = h.u AND e.key = h.key",
    "propagated": "SELECT u, v, key, name, bearing, transit, bearing_lower_bound, bearing_upper_bound, coalesce(orientation, 1 - first_value(orientation IGNORE NULLS) OVER (PARTITION BY v ORDER BY u, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS orientation FROM bounds",
    "canon": f"SELECT *, CASE WHEN orientation = 0 THEN {_gap('bearing', '30')} ELSE {_gap('bearing', '320')} END AS d1, CASE WHEN orientation = 0 THEN {_gap('bearing', '215')} ELSE {_gap('bearing', '140')} END AS d2 FROM propagated",
    "ranked": "SELECT *, count(*) OVER (PARTITION BY v, orientation) AS n, row_number() OVER (PARTITION BY v, orientation ORDER BY least(d1, d2), u, key) AS place, first_value(d1 < d2) OVER (PARTITION BY v, orientation ORDER BY least(d1, d2), u, key) AS lead1 FROM canon",
    "directed": "SELECT u, v, key, name, bearing, transit, bearing_lower_bound, bearing_upper_bound, orientation, CASE WHEN orientation IS NOT NULL AND n <= 2 THEN CASE WHEN orientation = 0 THEN CASE WHEN lead1 = (place = 1) THEN 'east' ELSE 'west' END ELSE CASE WHEN lead1 = (place = 1) THEN 'north' ELSE 'south' END END END AS direction FROM ranked",
    "noderanges": f"SELECT v AS osmid, {_WIDE} FROM directed WHERE direction IS NOT NULL AND bearing_lower_bound IS NOT NULL AND bearing_upper_bound IS NOT NULL GROUP BY v",
    "signalranges": "SELECT s.TspAssetID, s.Name, s.x, s.y, m.osmid, "
    + ", ".join(f"{d}_{t}" for d in _DIRS for t in ("min", "max"))
    + " FROM xysignals s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY TspAssetID ORDER BY distance, osmid) AS one FROM nearest) m ON s.TspAssetID = m.TspAssetID AND one = 1 LEFT JOIN noderanges r ON m.osmid = r.osmid",
    "sides": "SELECT DISTINCT a, b FROM (SELECT u AS a, v AS b FROM edges WHERE u <> v UNION ALL SELECT v, u FROM edges WHERE u <> v) z",
    "alive": "SELECT * FROM xynodes WHERE osmid NOT IN (SELECT a FROM sides GROUP BY a HAVING count(*) = 1)",
    "links": "SELECT a.osmid AS p, b.osmid AS q FROM alive a JOIN alive b ON abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20",
    "walk": "SELECT osmid AS node, osmid AS reached FROM alive UNION SELECT w.node, l.q FROM walk w JOIN links l ON w.reached = l.p",
    "labels": "SELECT node, min(reached) AS label FROM walk GROUP BY node",
    # validation
    "keyed": "SELECT Intersection, Route_Direction, Heading, Route, Name, CAST(substr(Intersection, 14) AS INTEGER) AS TspAssetID, lower(split_part(Route_Direction, ' ', 1)) AS direction FROM headings",
    "rlong": "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT TspAssetID, '{d}' AS direction, '{t}' AS type, {d}_{t} AS bearing FROM ranges" for d in _DIRS for t in ("min", "max")) + ") z WHERE TspAssetID IS NOT NULL",
    "rdirs": 'SELECT TspAssetID, direction, max(bearing) FILTER (WHERE type = \'min\') AS "min", max(bearing) FILTER (WHERE type = \'max\') AS "max" FROM rlong WHERE bearing IS NOT NULL GROUP BY TspAssetID, direction',
    "vmatched": 'SELECT coalesce(r.TspAssetID, h.TspAssetID) AS TspAssetID, coalesce(r.direction, h.direction) AS direction, r."min", r."max", Heading, Route, Intersection, Name FROM rdirs r FULL JOIN (SELECT DISTINCT TspAssetID, Heading, direction, Route, Intersection, Name FROM keyed) h ON r.TspAssetID = h.TspAssetID AND r.direction = h.direction',
    "vflags": 'SELECT *, error0 AS error, known AND NOT error0 AS success, Heading IS NOT NULL AS heading_available FROM (SELECT *, coalesce(known AND NOT (Heading > "min") AND NOT (Heading < "max"), false) AS error0 FROM (SELECT *, Heading IS NOT NULL AND "min" IS NOT NULL AND "max" IS NOT NULL AS known FROM vmatched) y) z',
    "corrected": " UNION ALL ".join(f"SELECT TspAssetID, osmid, Name, x, y, '{d}' AS direction, {d}_min AS bearing_lower_bound, {d}_max AS bearing_upper_bound FROM ranges WHERE {d}_min IS NOT NULL AND {d}_max IS NOT NULL" for d in _DIRS),
}

#: Corners of the study area, longitude and latitude.
CORNERS = ((-118.44, 34.005), (-118.41, 34.003), (-118.405, 34.02), (-118.43, 34.03))
_ALONG = "greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_OFF = f"sqrt((x1 + {_ALONG} * (x2 - x1) - x) * (x1 + {_ALONG} * (x2 - x1) - x) + (y1 + {_ALONG} * (y2 - y1) - y) * (y1 + {_ALONG} * (y2 - y1) - y))"
STEPS |= {
    "corners": " UNION ALL ".join(f"SELECT {i} AS i, CAST({lon} AS DOUBLE) AS lon, CAST({lat} AS DOUBLE) AS lat" for i, (lon, lat) in enumerate(CORNERS)),
    "xycorners": f"SELECT i, {_X} AS x, {_Y} AS y FROM corners",
    "walls": f"SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM xycorners a JOIN xycorners b ON b.i = (a.i + 1) % {len(CORNERS)}",
    "within": f"SELECT osmid FROM xynodes, walls GROUP BY osmid HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 OR min({_OFF}) <= 1000",
    "clipped": "SELECT DISTINCT u, v, key, name FROM edges WHERE u IN (SELECT osmid FROM within) OR v IN (SELECT osmid FROM within)",
    "clippednodes": "SELECT * FROM xynodes WHERE osmid IN (SELECT u FROM clipped UNION SELECT v FROM clipped)",
}


def _again(names: tuple[str, ...], over: dict[str, str]) -> dict[str, str]:
    """These steps once more, their names ending in _s, over other tables."""
    to = over | {n: f"{n}_s" for n in names}
    return {to[n]: re.sub(r"\b\w+\b", lambda m: to.get(m[0], m[0]), STEPS[n]) for n in names}


STEPS |= _again(("sides", "alive", "links", "walk", "labels"), {"edges": "clipped", "xynodes": "clippednodes"})
STEPS |= {
    "nodes_s": "SELECT label AS osmid, avg(lon) AS lon, avg(lat) AS lat, avg(x) AS x, avg(y) AS y FROM labels_s JOIN alive_s ON node = osmid GROUP BY label",
    "edges_s": "SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY u0, v0, key0) - 1 AS key, name FROM (SELECT a.label AS u, b.label AS v, e.u AS u0, e.v AS v0, key AS key0, name FROM clipped e JOIN labels_s a ON e.u = a.node JOIN labels_s b ON e.v = b.node) z WHERE u <> v",
}
STEPS |= {
    "xybends": f"SELECT u, v, key, {_X} AS bendx, {_Y} AS bendy FROM bends",
    "lines_s": "SELECT a.label AS u, b.label AS v, row_number() OVER (PARTITION BY a.label, b.label ORDER BY e.u, e.v, e.key) - 1 AS key, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, bendx, bendy FROM clipped e JOIN labels_s a ON e.u = a.node JOIN labels_s b ON e.v = b.node JOIN xynodes p ON e.u = p.osmid JOIN xynodes q ON e.v = q.osmid LEFT JOIN xybends w ON e.u = w.u AND e.v = w.v AND e.key = w.key WHERE a.label <> b.label",
    "ways_s": "SELECT l.u, l.v, l.key, n.x, n.y, 2 + CASE WHEN bendx IS NULL THEN 0 ELSE 1 END + CASE WHEN m.x <> x1 OR m.y <> y1 THEN 1 ELSE 0 END + CASE WHEN n.x <> x2 OR n.y <> y2 THEN 1 ELSE 0 END AS n_vertices, sqrt((m.x - x1) * (m.x - x1) + (m.y - y1) * (m.y - y1)) + sqrt((n.x - x2) * (n.x - x2) + (n.y - y2) * (n.y - y2)) + CASE WHEN bendx IS NULL THEN sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) ELSE sqrt((x1 - bendx) * (x1 - bendx) + (y1 - bendy) * (y1 - bendy)) + sqrt((bendx - x2) * (bendx - x2) + (bendy - y2) * (bendy - y2)) END AS metres FROM lines_s l JOIN nodes_s m ON l.u = m.osmid JOIN nodes_s n ON l.v = n.osmid",
}
_CHAIN = ("bearings", "oriented", "reach", "nearest", "ends", "halves", "bounds", "propagated", "canon", "ranked", "directed", "noderanges", "signalranges")
STEPS |= _again(_CHAIN, {"nodes": "nodes_s", "xynodes": "nodes_s", "edges": "edges_s"})
STEPS |= _again(("rlong", "rdirs", "vmatched", "vflags"), {"ranges": "signalranges_s"})


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its name, with the select of its oracle."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = oracle(STEPS, sql)
        return f

    return keep


def _step(cls: type, attribute: str, sql: str | None, key: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(cls(spark, sf_dir), attribute)
        return df.selectExpr(*columns) if columns else df

    query(sql, key)(run)


# Service and shapes
_step(Service, "feeds", "SELECT * FROM feeds_on", "feeds_on_dates")
_step(Service, "counts", "SELECT * FROM counts", "route_shape_counts")
query("SELECT * FROM feedshapes", "feed_shapes")(lambda s, d: service.by_trips(service.feed_shapes(Service(s, d).feeds, Service(s, d).counts)))
_step(Service, "served", "SELECT * FROM served", "drop_unserved_dates")
_step(Service, "feed_dates", "SELECT * FROM fdates", "feed_dates")
_step(Service, "totals", "SELECT * FROM totals", "total_trips_per_shape")
_step(Service, "latest", "SELECT * FROM latest", "latest_per_shape")
_step(Service, "chosen", "SELECT * FROM chosen", "min_trips")
query("SELECT shape_id, feed_key, array_to_string(pt_array, ';') AS points FROM geometry", "shape_geometry")(
    lambda s, d: Service(s, d).geometry.select("shape_id", "feed_key", F.array_join("pt_array", ";").alias("points"))
)
query("SELECT shape_id, feed_key, last_seen_date, route_id, route_short_name, ct, len(pt_array) AS n_points FROM drawn", "attach_geometry")(
    lambda s, d: Service(s, d).lines.withColumn("n_points", F.size("pt_array").cast("long")).drop("pt_array", "line")
)
_step(Service, "entries", "SELECT * FROM entries", "feed_entries")
_step(Service, "dated_entries", "SELECT * FROM dated", "attach_feed_entry")


@query("SELECT shape_id, service_date, feed_key, i AS vertex, CAST(regexp_extract(pt_array[i], '\\(([-0-9.]+) ', 1) AS DOUBLE) AS x, CAST(regexp_extract(pt_array[i], ' ([-0-9.]+)\\)', 1) AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, len(pt_array) + 1)) AS i FROM shapes WHERE len(pt_array) > 1)")
def decode_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapted(spark, sf_dir, "shapes").withColumn("line", C.decode_line(F.col("pt_array")))
    return lines.select("shape_id", "service_date", "feed_key", F.posexplode("line").alias("i", "p")).select(
        "shape_id", "service_date", "feed_key", (F.col("i") + 1).cast("long").alias("vertex"), F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


@query("SELECT DISTINCT stop_id, CAST(regexp_extract(pt_geom, '\\(([-0-9.]+) ', 1) AS DOUBLE) AS x, CAST(regexp_extract(pt_geom, ' ([-0-9.]+)\\)', 1) AS DOUBLE) AS y FROM stops WHERE pt_geom IS NOT NULL")
def decode_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapted(spark, sf_dir, "stops").withColumn("p", C.decode_point(F.col("pt_geom"))).filter("p IS NOT NULL")
    return p.select("stop_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()


# Stop times
_step(Service, "stop_times", "SELECT * FROM vstops", "stop_times_in_feeds")
_step(Service, "trips", "SELECT * FROM vtrips", "valid_trips")
_step(Service, "summary", "SELECT * FROM summary", "timepoint_summary")
_step(Service, "sequences", "SELECT * FROM sequences", "stop_sequences")
_step(Service, "timepoints", "SELECT * FROM timepoints", "timepoints_on_route")
_step(Service, "rt", "SELECT * FROM rt", "rt_stop_times")
_step(Service, "matched", "SELECT * FROM matched", "schedule_rt_stop_times")
query("SELECT m.* FROM (SELECT r.service_date, r.trip_id, trip_key, r.stop_id, t.feed_key, t.shape_id, r.stop_sequence, actual_arrival_pacific, actual_departure_pacific, n_predictions, pt_geom FROM rt r JOIN vtrips t ON r.service_date = t.service_date AND r.trip_id = t.trip_id JOIN timepoints p ON r.stop_sequence = p.stop_sequence AND t.shape_id = p.shape_id AND r.stop_id = p.stop_id) m", "schedule_rt_stop_times_by_stop")(
    lambda s, d: (lambda w: stop_times.schedule_rt_stop_times(w.rt, w.trips, w.timepoints, match_on="stop_id"))(Service(s, d))
)

# Segments
query("SELECT * FROM priors", "prior_departure")(lambda s, d: segments.prior_departure(Service(s, d).matched))
_step(Service, "timed", "SELECT * FROM timed", "segment_seconds")
query("SELECT shape_id, feed_key, stop_sequence, travel_time_variability, p80_travel_time_seconds, p20_travel_time_seconds FROM report", "travel_time_variability")(
    lambda s, d: segments.travel_time_variability(Service(s, d).timed)
)
query("SELECT shape_id, feed_key, stop_sequence, n_rt_trips, n_service_dates FROM report", "segment_counts")(lambda s, d: segments.segment_counts(Service(s, d).timed))
_step(Service, "report", "SELECT * FROM report", "segment_report")
query("SELECT CAST(actual_arrival_pacific AS DATE) AS arrival_date, count(*) AS n_arrivals FROM timed WHERE actual_arrival_pacific IS NOT NULL GROUP BY 1", "arrivals_per_day")(
    lambda s, d: segments.arrivals_per_day(Service(s, d).timed)
)
query("SELECT * FROM validity", "shape_date_validity")(lambda s, d: segments.shape_date_validity(Service(s, d).timed))
query("SELECT * FROM tripcounts", "rt_trip_counts")(lambda s, d: segments.rt_trip_counts(Service(s, d).timed))
_step(Service, "validity", "SELECT v.*, n_rt_trips, n_service_dates = 5 AS covers_all_target_dates FROM validity v LEFT JOIN tripcounts t ON v.shape_id = t.shape_id", "covers_all_target_dates")
_step(Service, "timepoint_list", "SELECT * FROM tplist", "timepoint_list", "shape_id", "feed_key", "stop_sequence", "stop_id", "pt_geom")
_AT = "shape_id, feed_key, stop_sequence, stop_id"
_ONLINE = ["shape_id", "feed_key", "stop_sequence", "stop_id", _r("distance", 9)]
_step(Service, "projected", f"SELECT {_AT}, round(distance, 9) AS distance FROM onlines", "project_on_line", *_ONLINE)
_step(Service, "projected", f"SELECT {_AT}, round(distance, 9) AS distance, round(prior_distance, 9) AS prior_distance FROM onlines", "prior_distance", *_ONLINE, _r("prior_distance", 9))


@query(f"SELECT {_AT}, pt_geom, vertex, round(x, 7) AS x, round(y, 7) AS y FROM cutvertices")
def segment_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segments.segment_lines(Service(spark, sf_dir).projected).select("shape_id", "feed_key", "stop_sequence", "stop_id", "pt_geom", F.posexplode("segment").alias("i", "p"))
    return parts.select("shape_id", "feed_key", "stop_sequence", "stop_id", "pt_geom", (F.col("i") + 1).cast("long").alias("vertex"), F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query(
    "SELECT t.shape_id, t.feed_key, t.stop_sequence, t.stop_id, t.pt_geom, round(distance, 9) AS distance, round(prior_distance, 9) AS prior_distance, n_vertices, round(x1, 7) AS x1, round(y1, 7) AS y1, travel_time_variability, p80_travel_time_seconds, p20_travel_time_seconds, n_rt_trips, n_service_dates FROM onlines t"
    " LEFT JOIN (SELECT shape_id, feed_key, stop_sequence, stop_id, pt_geom, count(*) AS n_vertices, arg_min(x, vertex) AS x1, arg_min(y, vertex) AS y1 FROM cutvertices GROUP BY ALL) g ON t.shape_id = g.shape_id AND t.feed_key = g.feed_key AND t.stop_sequence = g.stop_sequence AND t.stop_id = g.stop_id AND t.pt_geom = g.pt_geom"
    " LEFT JOIN report r ON t.shape_id = r.shape_id AND t.feed_key = r.feed_key AND t.stop_sequence = r.stop_sequence WHERE t.stop_sequence <> 2"
)
def segment_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Service(spark, sf_dir).map_rows
    first = {c: F.round(F.col("segment")[0][c[0]], 7) for c in ("x1", "y1")}
    rows = rows.withColumns(first | {"n_vertices": F.when(F.col("segment").isNotNull(), F.size("segment")).cast("long"), "distance": F.round("distance", 9), "prior_distance": F.round("prior_distance", 9)})
    return rows.drop("line", "point", "segment")


@query("SELECT shape_id, feed_key, CAST(p80 AS DOUBLE) AS p80_travel_time_seconds, CAST(p20 AS DOUBLE) AS p20_travel_time_seconds, " + _RATIO + " AS travel_time_variability FROM (SELECT shape_id, feed_key, quantile_cont(secs, 0.8) AS p80, quantile_cont(secs, 0.2) AS p20 FROM (SELECT shape_id, feed_key, CASE WHEN b >= a THEN (b - a) // 1000000 % 86400 END AS secs FROM (SELECT service_date, shape_id, feed_key, trip_id, max(CASE WHEN up = 1 THEN epoch_us(actual_departure_pacific) END) AS a, max(CASE WHEN down = 1 THEN epoch_us(actual_arrival_pacific) END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY service_date, shape_id, feed_key, trip_id ORDER BY stop_sequence, stop_id, pt_geom NULLS FIRST) AS up, row_number() OVER (PARTITION BY service_date, shape_id, feed_key, trip_id ORDER BY stop_sequence DESC, stop_id DESC, pt_geom DESC NULLS LAST) AS down FROM matched) GROUP BY service_date, shape_id, feed_key, trip_id)) GROUP BY shape_id, feed_key)")
def corridor_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.corridor_variability(Service(spark, sf_dir).matched)


@query("SELECT shape_id, feed_key, stop_sequence, day_part, " + _RATIO + " AS travel_time_variability, CAST(p80 AS DOUBLE) AS p80_travel_time_seconds, CAST(p20 AS DOUBLE) AS p20_travel_time_seconds, n_rt_trips, n_service_dates FROM (SELECT shape_id, feed_key, stop_sequence, day_part, quantile_cont(segment_seconds, 0.8) AS p80, quantile_cont(segment_seconds, 0.2) AS p20, count(trip_id) AS n_rt_trips, count(DISTINCT service_date) AS n_service_dates FROM (SELECT *, CAST(CASE WHEN hour(actual_arrival_pacific) >= 19 THEN 4 WHEN hour(actual_arrival_pacific) >= 15 THEN 3 WHEN hour(actual_arrival_pacific) >= 10 THEN 2 WHEN hour(actual_arrival_pacific) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS day_part FROM timed) GROUP BY ALL)")
def segment_report_by_day_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_report(segments.with_day_part(Service(spark, sf_dir).timed), [*segments.SEGMENT, "day_part"])


# Pings
_PING = ["event_id", "ROUTE_ID", "TRIP_KEY", "event_at"]
_step(Pings, "parsed", "SELECT event_id, ROUTE_ID, TRIP_KEY, event_at FROM parsed", "parse_event_time", *_PING)
query("SELECT count(*) AS n_pings, count(*) FILTER (WHERE event_at IS NULL) AS n_unparsed FROM parsed", "unparsed_event_times")(lambda s, d: avl.unparsed_event_times(Pings(s, d).parsed))
query("SELECT ROUTE_ID || '_' || CAST(TRIP_KEY AS VARCHAR) AS route_trip, count(*) AS n_pings FROM pings WHERE TRIP_KEY IS NOT NULL AND ROUTE_ID IS NOT NULL GROUP BY 1", "pings_per_route_trip")(
    lambda s, d: avl.pings_per_route_trip(adapted(s, d, "pings"))
)
_step(Pings, "gaps", "SELECT event_id, ROUTE_ID, TRIP_KEY, event_at, round(gap_seconds, 6) AS gap_seconds FROM gaps", "ping_gaps", *_PING, _r("gap_seconds", 6))
query(
    "SELECT count(gap_seconds) AS n_gaps, round(avg(gap_seconds), 6) AS mean_gap, round(stddev_samp(gap_seconds), 6) AS std_gap, min(gap_seconds) AS min_gap, max(gap_seconds) AS max_gap, quantile_cont(gap_seconds, 0.25) AS p25_gap, quantile_cont(gap_seconds, 0.5) AS p50_gap, quantile_cont(gap_seconds, 0.75) AS p75_gap FROM gaps",
    "gap_summary",
)(lambda s, d: avl.gap_summary(Pings(s, d).gaps).withColumns({"mean_gap": F.round("mean_gap", 6), "std_gap": F.round("std_gap", 6)}))
_BIN = "CAST(least(floor((gap_seconds - lo) / (hi - lo) * {n}), {n} - 1) AS INTEGER)"
query(
    f"SELECT i AS bin, coalesce(n, 0) AS n_rows FROM (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS i) k LEFT JOIN (SELECT {_BIN.format(n=50)} AS b, count(*) AS n FROM gaps, (SELECT min(gap_seconds) AS lo, max(gap_seconds) AS hi FROM gaps) e WHERE gap_seconds IS NOT NULL GROUP BY 1) c ON i = b",
    "histogram",
)(lambda s, d: avl.histogram(Pings(s, d).gaps, "gap_seconds", 50))
query(
    f"SELECT t.TRIP_KEY, i AS bin, coalesce(n, 0) AS n_rows FROM (SELECT DISTINCT TRIP_KEY FROM gaps WHERE gap_seconds < 40000) t, (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS i) k LEFT JOIN (SELECT TRIP_KEY, {_BIN.format(n=30)} AS b, count(*) AS n FROM gaps, (SELECT min(gap_seconds) AS lo, max(gap_seconds) AS hi FROM gaps WHERE gap_seconds < 40000) e WHERE gap_seconds < 40000 GROUP BY 1, 2) c ON i = b AND t.TRIP_KEY = c.TRIP_KEY",
    "histogram_by_trip",
)(lambda s, d: avl.histogram(avl.within_gap(Pings(s, d).gaps, 40_000), "gap_seconds", 30, by="TRIP_KEY"))
query("SELECT event_id, round(gap_seconds, 6) AS gap_seconds FROM gaps WHERE gap_seconds < 40000", "within_gap")(
    lambda s, d: avl.within_gap(Pings(s, d).gaps, 40_000).selectExpr("event_id", _r("gap_seconds", 6))
)
_step(Pings, "placed", "SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM placed", "project_points", "event_id", _r("x", 3), _r("y", 3))
_step(Pings, "placed", "SELECT event_id, round(distance, 3) AS distance FROM placed", "distance_to_point", "event_id", _r("distance", 3))
_step(Pings, "placed", "SELECT event_id, door_open FROM placed", "door_open", "event_id", "door_open")
_step(Pings, "near", "SELECT event_id, ROUTE_ID, round(distance, 3) AS distance FROM nearby", "near_point", "event_id", "ROUTE_ID", _r("distance", 3))
_step(Pings, "near", "SELECT event_id, round(azimuth_to_signal, 6) AS azimuth_to_signal FROM nearby", "azimuth_from_point", "event_id", _r("azimuth_to_signal", 6))
_step(
    Pings,
    "near_signals",
    f"SELECT event_id, TspAssetID, round(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 3) AS distance, round({_pmod('degrees(atan2(p.x - s.x, p.y - s.y))')}, 4) AS azimuth_to_signal FROM (SELECT event_id, {_PX} AS x, {_PY} AS y FROM parsed WHERE LONGITUDE IS NOT NULL AND LATITUDE IS NOT NULL) p JOIN xysignals s ON abs(p.x - s.x) < 200 AND abs(p.y - s.y) < 200 WHERE sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) < 200",
    "near_points", "event_id", "TspAssetID", _r("distance", 3), _r("azimuth_to_signal", 4),
)
_step(Pings, "ahead", "SELECT event_id, round(azimuth_to_signal, 6) AS azimuth_to_signal FROM nearby WHERE azimuth_to_signal < 120", "ahead_of_signal", "event_id", _r("azimuth_to_signal", 6))
query("SELECT event_id, event_at, round(distance, 3) AS distance, door_open FROM placed WHERE TRIP_KEY = 7", "trip_pings")(
    lambda s, d: avl.trip_pings(Pings(s, d).placed, 7, ["event_id", "event_at", "distance", "door_open"]).withColumn("distance", F.round("distance", 3))
)
query(
    'SELECT TRIP_KEY, min(event_at) AS "start", max(event_at) AS "end", count(*) AS n_pings, epoch_us(max(event_at)) / 1e6 - epoch_us(min(event_at)) / 1e6 AS dwell_seconds FROM (SELECT *, sum(CASE WHEN door_open AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY TRIP_KEY ORDER BY event_at, event_id) AS run FROM (SELECT *, coalesce(lag(door_open) OVER (PARTITION BY TRIP_KEY ORDER BY event_at, event_id), false) AS was FROM placed WHERE event_at IS NOT NULL) a) b WHERE door_open GROUP BY TRIP_KEY, run',
    "dwells",
)(lambda s, d: avl.dwells(Pings(s, d).placed, tie="event_id"))

query(
    "SELECT TRIP_KEY, TspAssetID, round(entered, 3) AS entered, round(crossed, 3) AS crossed, round(gone, 3) AS left_at, round(metres, 3) AS metres, round(least_m, 3) AS least_m, round(entry_azimuth, 4) AS entry_azimuth, round(gone - entered, 3) AS seconds, round(greatest(0, gone - entered - metres / 11), 3) AS delay_seconds, (['north', 'east', 'south', 'west'])[CAST(floor(((entry_azimuth + 45) - 360 * floor((entry_azimuth + 45) / 360)) / 90) AS INTEGER) + 1] AS comes_from FROM passed",
    "intersection_delay",
)(
    lambda s, d: Pings(s, d).delays.select(
        "TRIP_KEY", "TspAssetID", *(F.round(c, 3).alias(n) for c, n in (("entered", "entered"), ("crossed", "crossed"), ("left", "left_at"), ("metres", "metres"), ("least_m", "least_m"))), F.round("entry_azimuth", 4).alias("entry_azimuth"), *(F.round(c, 3).alias(c) for c in ("seconds", "delay_seconds")), "comes_from"
    )
)

# Streets
_EDGE = ["u", "v", "key", "name", _r("bearing", 6)]
_E6 = "u, v, key, name, round(bearing, 6) AS bearing"
_step(Streets, "bearings", f"SELECT {_E6} FROM bearings", "edge_bearings", *_EDGE)
_step(Streets, "oriented", f"SELECT {_E6}, orientation, transit FROM oriented", "street_orientation", *_EDGE, "orientation", "transit")
_step(
    Streets,
    "near",
    "SELECT s.TspAssetID, s.Name, osmid, round(distance, 3) AS distance FROM xysignals s LEFT JOIN nearest n ON s.TspAssetID = n.TspAssetID",
    "nearest_within",
    "TspAssetID",
    "Name",
    "osmid",
    _r("distance", 3),
)
_step(Streets, "ends", f"SELECT {_E6} FROM ends", "in_edges", *_EDGE)
_BOUNDS = ["bearing_lower_bound", "bearing_upper_bound"]
_step(Streets, "bounds", "SELECT u, v, key, bearing_lower_bound, bearing_upper_bound FROM bounds", "bearing_bounds", "u", "v", "key", *_BOUNDS)
_step(Streets, "propagated", "SELECT u, v, key, orientation FROM propagated", "propagate_orientation", "u", "v", "key", "orientation")
_step(Streets, "directed", "SELECT u, v, key, orientation, direction FROM directed", "assign_directions", "u", "v", "key", "orientation", "direction")
_step(Streets, "ranges", "SELECT * FROM noderanges", "node_heading_ranges")
query("SELECT TspAssetID, Name, round(x, 3) AS x, round(y, 3) AS y, osmid, " + ", ".join(validation.RANGE_COLUMNS) + " FROM signalranges", "signals_with_ranges")(
    lambda s, d: Streets(s, d).signal_ranges.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})
)


@query(
    f"SELECT u, v, round({_UP.format(a='bearing', b='30.0')}, 6) AS clockwise, round({_DOWN.format(a='bearing', b='30.0')}, 6) AS anticlockwise, round({_gap('bearing', '30.0')}, 6) AS nearer FROM bearings"
)
def bearing_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, to = F.col("bearing"), F.lit(30.0)
    gaps = {"clockwise": C.positive_distance_to_bearing(b, to), "anticlockwise": C.negative_distance_to_bearing(b, to), "nearer": C.distance_to_bearing(b, to)}
    return Streets(spark, sf_dir).bearings.select("u", "v", *(F.round(g, 6).alias(n) for n, g in gaps.items()))


def _ring(spark: SparkSession) -> list[tuple[float, float]]:
    x, y = C.albers(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CORNERS)], "i int, lon double, lat double").select("i", x.alias("x"), y.alias("y"))
    return [(r.x, r.y) for r in rows.orderBy("i").collect()]


@query("SELECT u, v, key, name FROM clipped")
def clip_to_study_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.clip_to_study_area(Streets(spark, sf_dir).nodes, adapted(spark, sf_dir, "edges"), _ring(spark))


@query("SELECT label AS osmid, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM labels JOIN alive ON node = osmid GROUP BY label")
def consolidate_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Streets(spark, sf_dir)
    merged, _ = network.consolidate_intersections(w.nodes.withColumn("one", F.lit(1)), adapted(spark, sf_dir, "edges"))
    return merged.select("osmid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# Validation
_step(Streets, "headings", "SELECT TspAssetID, direction, Heading, Route, Name FROM keyed", "read_headings", "TspAssetID", "direction", "Heading", "Route", "Name")
_step(Streets, "long", "SELECT * FROM rlong", "ranges_long")
query("SELECT * FROM rdirs", "ranges_by_direction")(lambda s, d: validation.ranges_by_direction(Streets(s, d).long))
_step(Streets, "matched", "SELECT * FROM vmatched", "match_headings")
_FLAGS = 'SELECT TspAssetID, direction, "min", "max", Heading, Route, Intersection, Name, error, success, heading_available FROM vflags'
_step(Streets, "flags", _FLAGS, "heading_flags")
query("SELECT count(*) FILTER (WHERE success AND heading_available) / count(*) FILTER (WHERE heading_available) AS success_rate FROM vflags", "success_rate")(lambda s, d: validation.success_rate(Streets(s, d).flags))
query(_FLAGS + " WHERE error", "heading_errors")(lambda s, d: validation.heading_errors(Streets(s, d).flags))
query(_FLAGS + " WHERE heading_available AND NOT success", "headings_without_success")(lambda s, d: validation.headings_without_success(Streets(s, d).flags))
query("SELECT success, count(*) AS n_rows FROM vflags GROUP BY success", "success_counts")(lambda s, d: validation.success_counts(Streets(s, d).flags))
query(
    "SELECT f.Name, f.TspAssetID, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT DISTINCT Name, TspAssetID FROM vflags WHERE heading_available AND NOT success AND NOT error) f LEFT JOIN xysignals s ON f.TspAssetID = s.TspAssetID",
    "signals_missing_ranges",
)(lambda s, d: validation.signals_missing_ranges(Streets(s, d).flags, Streets(s, d).signals).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)}))
query("SELECT * FROM corrected", "corrected_long")(lambda s, d: validation.corrected_long(adapted(s, d, "ranges")))


@query(
    "SELECT TspAssetID, direction, round(x - 100 * sin(radians(bearing_lower_bound)), 6) AS x1, round(y - 100 * cos(radians(bearing_lower_bound)), 6) AS y1, round(x - 100 * sin(radians(bearing_upper_bound)), 6) AS x2, round(y - 100 * cos(radians(bearing_upper_bound)), 6) AS y2 FROM (SELECT * EXCLUDE (x, y), {} AS x, {} AS y FROM corrected)".format(*_albers("x", "y"))
)
def validation_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = C.albers(F.col("x"), F.col("y"))  # the ranges have degrees
    t = validation.validation_triangles(validation.corrected_long(adapted(spark, sf_dir, "ranges").withColumns({"x": x, "y": y})))
    at = lambda i, k: F.round(F.col("triangle")[i][k], 6).alias(f"{k}{i}")
    return t.select("TspAssetID", "direction", at(1, "x"), at(1, "y"), at(2, "x"), at(2, "y"))


@query(
    "SELECT d.u, d.v, d.key, direction, n_vertices, round(metres, 3) AS metres, round(x, 3) AS x0, round(y, 3) AS y0, round(x - 100 * sin(radians(bearing_lower_bound)), 3) AS x1, round(y - 100 * cos(radians(bearing_lower_bound)), 3) AS y1, round(x - 100 * sin(radians(bearing_upper_bound)), 3) AS x2, round(y - 100 * cos(radians(bearing_upper_bound)), 3) AS y2 FROM directed_s d JOIN ways_s w ON d.u = w.u AND d.v = w.v AND d.key = w.key WHERE bearing_lower_bound IS NOT NULL AND bearing_upper_bound IS NOT NULL"
)
def in_edge_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the clipped and merged network; n_vertices and metres are those of the edge's line."""
    t = StudyArea(spark, sf_dir, tuple(_ring(spark))).triangles.withColumn("line", measured(F.col("line")))
    at = lambda i, k: F.round(F.col("triangle")[i][k], 3).alias(f"{k}{i}")
    way = [F.size("line").cast("long").alias("n_vertices"), F.round(F.element_at("line", -1)["m"], 3).alias("metres")]
    return t.select("u", "v", "key", "direction", *way, *(at(i, k) for i in range(3) for k in "xy"))


@query(
    "SELECT h.TspAssetID, direction, Heading, Route, round(CASE WHEN Heading IS NOT NULL THEN s.x - 182 * sin(radians(Heading)) END, 3) AS x1, round(CASE WHEN Heading IS NOT NULL THEN s.y - 182 * cos(radians(Heading)) END, 3) AS y1 FROM keyed h LEFT JOIN xysignals s ON h.TspAssetID = s.TspAssetID"
)
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Streets(spark, sf_dir)
    lines = validation.request_lines(w.headings, w.signals)
    at = lambda k: F.round(F.col("line")[1][k], 3).alias(f"{k}1")
    return lines.select("TspAssetID", "direction", "Heading", "Route", at("x"), at("y"))


# Checks
query("SELECT trip_id, service_date, count(*) AS n_rows FROM rt GROUP BY trip_id, service_date HAVING count(*) > 1", "check_unique")(lambda s, d: checks.check_unique(Service(s, d).rt, ["trip_id", "service_date"]))
query(
    "SELECT stop_id, count(*) AS n_rows, 'left' AS side FROM timepoints GROUP BY stop_id HAVING count(*) > 1 UNION ALL SELECT stop_id, count(*), 'right' FROM sequences GROUP BY stop_id HAVING count(*) > 1",
    "check_one_to_one",
)(lambda s, d: checks.check_one_to_one(Service(s, d).timepoints, Service(s, d).sequences, ["stop_id"]))
query("SELECT feed_key, count(*) AS n_rows FROM fdates GROUP BY feed_key HAVING count(*) > 1", "check_many_to_one")(lambda s, d: checks.check_many_to_one(Service(s, d).rt, Service(s, d).feed_dates, ["feed_key"]))
query("SELECT stop_id, count(*) AS n_rows FROM sequences GROUP BY stop_id HAVING count(*) > 1", "check_one_to_many")(lambda s, d: checks.check_one_to_many(Service(s, d).sequences, Service(s, d).timepoints, ["stop_id"]))
query("SELECT w.feed_key, count(e.feed_key) AS n_rows FROM (SELECT DISTINCT feed_key FROM feeds) w LEFT JOIN entries e ON w.feed_key = e.feed_key GROUP BY w.feed_key HAVING count(e.feed_key) <> 1", "check_count")(
    lambda s, d: checks.check_count(Service(s, d).entries, ["feed_key"], adapted(s, d, "feeds"))
)

# Workloads
_step(Service, "report", "SELECT * FROM report", "w1_segment_variability")


@query("SELECT TspAssetID, Name, round(x, 3) AS x, round(y, 3) AS y, osmid, " + ", ".join(validation.RANGE_COLUMNS) + " FROM signalranges_s")
def w2_signal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the network as it is: clip, merge junctions, bearings, bounds, directions, ranges at signals."""
    w = StudyArea(spark, sf_dir, tuple(_ring(spark)))
    return w.signal_ranges.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


@query(
    "SELECT TRIP_KEY, count(gap_seconds) AS n_gaps, round(avg(gap_seconds), 6) AS mean_gap, count(*) FILTER (WHERE distance < 200 AND trim(ROUTE_ID) = '104') AS n_near FROM placed GROUP BY TRIP_KEY"
)
def w3_ping_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = (F.col("distance") < 200) & (F.trim("ROUTE_ID") == "104")
    return Pings(spark, sf_dir).placed.groupBy("TRIP_KEY").agg(F.count("gap_seconds").alias("n_gaps"), F.round(F.avg("gap_seconds"), 6).alias("mean_gap"), F.count_if(near).alias("n_near"))



@query(
    "SELECT t.shape_id, t.feed_key, t.stop_sequence, t.stop_id, t.pt_geom, round(distance, 9) AS distance, round(prior_distance, 9) AS prior_distance, travel_time_variability, p80_travel_time_seconds, p20_travel_time_seconds, r.n_rt_trips, r.n_service_dates, first_service_date, last_service_date, v.n_service_dates AS shape_service_dates, service_dates, c.n_rt_trips AS shape_rt_trips, v.n_service_dates = 5 AS covers_all_target_dates FROM onlines t"
    " LEFT JOIN report r ON t.shape_id = r.shape_id AND t.feed_key = r.feed_key AND t.stop_sequence = r.stop_sequence LEFT JOIN validity v ON t.shape_id = v.shape_id AND t.feed_key = v.feed_key LEFT JOIN tripcounts c ON t.shape_id = c.shape_id WHERE t.stop_sequence <> 2"
)
def w1_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From trips and stop times to the rows behind the map, with the audit of each shape."""
    rows = Corridor(spark, sf_dir).rows
    return rows.withColumns({"distance": F.round("distance", 9), "prior_distance": F.round("prior_distance", 9)}).drop("line", "point", "segment")


@query('SELECT TspAssetID, direction, "min", "max", Heading, Route, Intersection, Name, error, success, heading_available FROM vflags_s')
def w2_heading_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the network as it is to the submitted headings, held against the ranges worked out."""
    return StudyArea(spark, sf_dir, tuple(_ring(spark))).flags


@query(
    "SELECT o.TRIP_KEY, n_gaps, round(mean_gap, 6) AS mean_gap, n_within, round(least_distance, 3) AS least_distance, coalesce(n_near, 0) AS n_near, coalesce(n_open, 0) AS n_open, coalesce(n_ahead, 0) AS n_ahead, coalesce(n_passages, 0) AS n_passages, round(mean_delay, 3) AS mean_delay, p50_gap, p75_gap, fullest_bin, fullest_rows FROM"
    " (SELECT TRIP_KEY, count(gap_seconds) AS n_gaps, avg(gap_seconds) AS mean_gap, count(*) FILTER (WHERE gap_seconds < 40000) AS n_within, min(distance) AS least_distance FROM placed GROUP BY TRIP_KEY) o"
    " LEFT JOIN (SELECT TRIP_KEY, count(*) AS n_near, count(*) FILTER (WHERE door_open) AS n_open, count(*) FILTER (WHERE azimuth_to_signal < 120) AS n_ahead FROM nearby GROUP BY TRIP_KEY) n ON o.TRIP_KEY IS NOT DISTINCT FROM n.TRIP_KEY"
    " LEFT JOIN (SELECT TRIP_KEY, count(*) AS n_passages, avg(greatest(0, gone - entered - metres / 11)) AS mean_delay FROM passed GROUP BY TRIP_KEY) d ON o.TRIP_KEY = d.TRIP_KEY,"
    " (SELECT quantile_cont(gap_seconds, 0.5) AS p50_gap, quantile_cont(gap_seconds, 0.75) AS p75_gap FROM gaps) q,"
    f" (SELECT b AS fullest_bin, n AS fullest_rows FROM (SELECT {_BIN.format(n=50)} AS b, count(*) AS n FROM gaps, (SELECT min(gap_seconds) AS lo, max(gap_seconds) AS hi FROM gaps) e WHERE gap_seconds IS NOT NULL GROUP BY 1) z ORDER BY n DESC, b LIMIT 1) h"
)
def w3_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pings to the figures of each trip: frequency, approach to the place, delay at signals."""
    digits = {"mean_gap": 6, "least_distance": 3, "mean_delay": 3}
    return PingReport(spark, sf_dir).rows.withColumns({c: F.round(c, n) for c, n in digits.items()})
