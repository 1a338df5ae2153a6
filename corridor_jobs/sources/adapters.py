"""Transit tables made from the order, event and part tables of a generic test set, as SQL that Spark and DuckDB share.

Only integer and date arithmetic and plain text, so that both engines agree. Where the dialects differ a small function
writes the phrase for either. Tables of the test set are {named} like this.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "lineitem", "events", "part", "supplier", "customer")


class Dialect:
    def __init__(self, duck: bool):
        self.duck = duck

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})" if self.duck else f"(({a}) div {b})"

    def day(self, n: str) -> str:
        return f"(DATE '2024-03-04' + CAST({n} AS INTEGER))" if self.duck else f"date_add(DATE '2024-03-04', CAST({n} AS INT))"

    def at(self, day: str, micros: str) -> str:
        if self.duck:
            return f"(CAST({day} AS TIMESTAMP) + to_microseconds({micros}))"
        return f"(CAST({day} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST(CAST({micros} AS DECIMAL(18, 0)) / 1000000 AS DECIMAL(18, 6))))"

    def moment(self, text: str) -> str:
        return f"CAST('{text}' AS {'TIMESTAMP' if self.duck else 'TIMESTAMP_NTZ'})"

    def merge(self, *names: str) -> str:
        """Spark is told to sort and merge: it takes a compressed column of keys for far smaller than it is as a table of the
        driver, and would broadcast it."""
        return "" if self.duck else f"/*+ MERGE({', '.join(names)}) */ "

    def array(self, *items: str) -> str:
        return f"{'list_value' if self.duck else 'array'}({', '.join(items)})"


def tables(d: Dialect) -> dict[str, str]:
    """SQL of every table by name; each may use those before it."""
    own = "CASE WHEN o_orderkey % 7 < 3 THEN 'f0' ELSE 'f1' END"
    feed = "CASE WHEN (o_orderkey % 7 < 3) <> (o_orderkey % 53 = 0) THEN 'f0' ELSE 'f1' END"
    day = d.day("o_orderkey % 7")
    since = f"CASE WHEN feed_key = 'f0' THEN {d.moment('2024-01-01 00:00:00')} ELSE {d.moment('2024-03-01 00:00:00')} END"
    stop = "(o_custkey % 20 * 3 + l_linenumber) % 40"
    place = "'POINT(-118.' || lpad(CAST(500000 - k * 2500 AS STRING), 6, '0') || ' 34.' || lpad(CAST(k * 1300 + k % 3 * 700 AS STRING), 6, '0') || ')'"
    micros = (
        "(21600 + o_orderkey % 50 * 600 + l_linenumber * 120 + q * 7 % 300) * 1000000"
        " + CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey * 137 + l_linenumber * 7919) % 1000000 ELSE 0 END"
        " + CASE WHEN o_orderkey % 101 = 0 AND l_linenumber > 3 THEN 86400000000 ELSE 0 END"
    )
    vertex = lambda i: f"'POINT(-118.' || lpad(CAST(500000 - {i} * 20000 - n * 10 AS STRING), 6, '0') || ' 34.' || lpad(CAST(n * 500 + {i} * 9000 + {i % 2} * 1500 AS STRING), 6, '0') || ')'"
    door = lambda kind, j: f"CASE WHEN event_type = '{kind}' THEN 1.0 WHEN event_id % {j} = 0 THEN 0.0 END"
    lon = "CAST('-118.45' AS DOUBLE) + CAST(CASE WHEN p_partkey % 50 = 49 THEN 48060 ELSE p_partkey % 50 * 1000 END + p_partkey * 7919 % 201 - 100 AS DOUBLE) / 1000000"
    lat = f"CAST('34.0' AS DOUBLE) + CAST({d.div('p_partkey', 50)} * 1000 + p_partkey * 104729 % 201 - 100 AS DOUBLE) / 1000000"
    across = f"CASE WHEN a.p_partkey % 29 = 0 THEN NULL WHEN {d.div('a.p_partkey', 50)} % 5 = 0 THEN 'Main Blvd' ELSE 'H' || CAST({d.div('a.p_partkey', 50)} % 5 AS STRING) END"
    along = "CASE WHEN a.p_partkey % 31 = 0 THEN NULL WHEN a.p_partkey % 50 % 4 = 1 THEN 'Cross Ave' ELSE 'V' || CAST(a.p_partkey % 50 % 4 AS STRING) END"
    side = lambda j, m: f"CASE WHEN TspAssetID % {m} <> 0 THEN CAST((TspAssetID * 41 + {j} * 67) % 361 AS DOUBLE) END"
    return {
        "trips": f"""SELECT CAST(o_orderkey AS STRING) AS trip_id, {day} AS service_date, {feed} AS feed_key,
            CASE WHEN o_orderkey % 97 <> 0 THEN 's' || CAST(o_custkey % 20 AS STRING) END AS shape_id,
            CASE WHEN o_orderkey % 11 = 0 THEN 'rx' ELSE 'r' || CAST({d.div("o_custkey % 20", 4)} AS STRING) END AS route_id,
            substr(o_orderpriority, 1, 1) AS route_short_name, CAST(o_custkey % 2 AS INT) AS direction_id FROM {{orders}}""",
        "feeds": f"""SELECT DISTINCT {day} AS date, {own} AS feed_key, 'City Schedule' AS gtfs_dataset_name FROM {{orders}}
            UNION ALL SELECT DISTINCT {day}, 'f9', 'Other Schedule' FROM {{orders}}""",
        "dim_feeds": f"SELECT key, base64_url, {since} AS _valid_from FROM (SELECT DISTINCT feed_key AS key, feed_key, 'url_' || feed_key AS base64_url FROM feeds) z",
        "visits": f"""SELECT o_orderkey, o_custkey, l_linenumber, q, {stop} AS k, {feed} AS feed_key, {own} AS own_feed, {day} AS service_date
            FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS BIGINT) AS q FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l
            JOIN {{orders}} ON l_orderkey = o_orderkey""",
        "stop_times": f"""SELECT feed_key, 'p' || CAST(k AS STRING) AS stop_id, CAST(o_orderkey AS STRING) AS trip_id,
            CAST(CASE WHEN k % 13 = 0 AND o_orderkey % 19 = 0 THEN NULL WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 AND o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS timepoint,
            CAST(l_linenumber AS INT) AS stop_sequence, {since} AS _feed_valid_from FROM visits""",
        "stops": f"""SELECT DISTINCT service_date, own_feed AS feed_key, 'p' || CAST(k AS STRING) AS stop_id,
            CASE WHEN k <> 17 THEN {place} END AS pt_geom FROM visits""",
        "metrics": f"""SELECT service_date, CAST(o_orderkey AS STRING) AS trip_id, md5(CAST(o_orderkey AS STRING)) AS trip_key,
            'p' || CAST(k AS STRING) AS stop_id, CAST(l_linenumber AS INT) AS stop_sequence,
            CASE WHEN (o_orderkey + l_linenumber) % 41 <> 0 THEN {d.at("service_date", micros)} END AS actual_arrival_pacific,
            CASE WHEN (o_orderkey + l_linenumber) % 43 <> 0 THEN {d.at("service_date", micros + " + l_linenumber * 13 % 40 * 1000000")} END AS actual_departure_pacific,
            CAST(l_linenumber * 3 AS INT) AS n_predictions,
            CASE WHEN o_orderkey % 67 = 0 THEN 'url_x' ELSE 'url_' || own_feed END AS schedule_base64_url FROM visits""",
        "shapes": f"""SELECT service_date, 's' || CAST(n AS STRING) AS shape_id, feed_key,
            CASE WHEN n = 4 THEN NULL WHEN n = 3 THEN {d.array(vertex(0))} ELSE {d.array(*map(vertex, range(6)))} END AS pt_array
            FROM (SELECT DISTINCT {day} AS service_date, {own} AS feed_key, o_custkey % 20 AS n FROM {{orders}}) z""",
        "pings": f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' 104 ' WHEN 1 THEN '105' ELSE '106 ' END AS ROUTE_ID,
            CAST(CASE WHEN event_id % 307 <> 0 THEN user_id END AS INT) AS TRIP_KEY,
            CASE WHEN event_id % 211 <> 0 THEN CAST(year(ts) % 100 * 10000000000 + month(ts) * 100000000 + day(ts) * 1000000 + hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS DOUBLE) END AS EVENT_TIME,
            CASE WHEN event_id % 97 <> 0 THEN CAST('-118.41' AS DOUBLE) + CAST(event_id * 37 % 4001 - 2000 AS DOUBLE) / 1000000 END AS LONGITUDE,
            CASE WHEN event_id % 89 <> 0 THEN CAST('34.01' AS DOUBLE) + CAST(event_id * 53 % 4001 - 2000 AS DOUBLE) / 1000000 END AS LATITUDE,
            CAST({door("click", 5)} AS DOUBLE) AS STOP_BACK_DOOR_ENTRY, CAST({door("view", 7)} AS DOUBLE) AS STOP_FRONT_DOOR_ENTRY,
            CAST({door("error", 3)} AS DOUBLE) AS STOP_FRONT_DOOR_EXIT, CAST(NULL AS DOUBLE) AS STOP_BACK_DOOR_EXIT FROM {{events}}""",
        "nodes": f"SELECT p_partkey AS osmid, {lon} AS lon, {lat} AS lat FROM {{part}}",
        "edges": f"""SELECT {d.merge("a", "b")}a.p_partkey AS u, b.p_partkey AS v, 0 AS key, {across} AS name FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 50 < 49
            UNION ALL SELECT {d.merge("a", "b")}b.p_partkey, a.p_partkey, 0, {across} FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 50 < 49
            UNION ALL SELECT {d.merge("a", "b")}a.p_partkey, b.p_partkey, 0, {along} FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + 50
            UNION ALL SELECT {d.merge("a", "b")}b.p_partkey, a.p_partkey, 0, {along} FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + 50
            UNION ALL SELECT a.p_partkey, a.p_partkey, 1, 'H1' FROM {{part}} a WHERE a.p_partkey % 83 = 0""",
        "bends": f"""SELECT {d.merge("edges", "a", "b")}u, v, key, (a.lon + b.lon) / 2 + CAST(u % 5 AS DOUBLE) / 50000 AS lon, (a.lat + b.lat) / 2 + CAST(v % 3 AS DOUBLE) / 50000 AS lat
            FROM edges JOIN nodes a ON u = a.osmid JOIN nodes b ON v = b.osmid WHERE u <> v AND (u + v) % 4 <> 0""",
        "streets": "SELECT DISTINCT name, CASE WHEN name IN ('Main Blvd', 'H2') THEN 0 ELSE 1 END AS orientation FROM edges WHERE name IN ('Main Blvd', 'H2', 'Cross Ave')",
        "signals": f"""SELECT {d.merge("nodes")}CAST(s_suppkey AS INT) AS TspAssetID, 'Signal ' || CAST(s_suppkey AS STRING) AS Name,
            lat + CAST(s_suppkey % 5 * 100 + CASE WHEN s_suppkey % 11 = 0 THEN 500 ELSE 0 END AS DOUBLE) / 1000000 AS Lat, lon AS Long, 'none' AS IPHostAddress
            FROM {{supplier}} JOIN nodes ON osmid = s_suppkey * 20 + s_suppkey % 7""",
        "headings": f"""SELECT 'Intersection ' || CAST({d.div("c_custkey", 15)} AS STRING) AS Intersection,
            CASE c_custkey % 4 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' ELSE 'West' END || ' bound' AS Route_Direction,
            CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey * 37 % 360 AS DOUBLE) END AS Heading, 'r' || CAST(c_custkey % 3 AS STRING) AS Route,
            'Signal ' || CAST({d.div("c_custkey", 15)} AS STRING) AS Name FROM {{customer}}""",
        "ranges": f"""SELECT TspAssetID, CAST(TspAssetID * 20 AS BIGINT) AS osmid, Name, Long AS x, Lat AS y,
            {side(0, 5)} AS north_min, {side(1, 5)} AS north_max, {side(2, 7)} AS south_min, {side(3, 8)} AS south_max,
            {side(4, 9)} AS east_min, {side(5, 9)} AS east_max, {side(6, 11)} AS west_min, {side(7, 11)} AS west_max FROM signals""",
    }


SPARK, DUCK = tables(Dialect(duck=False)), tables(Dialect(duck=True))


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as a DataFrame."""
    every = list(SPARK)
    used = _needed(SPARK, name)
    text = "WITH " + ", ".join(f"{n} AS ({SPARK[n]})" for n in every if n in used) + f" SELECT * FROM {name}"
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **views)


def _needed(sql: dict[str, str], *names: str) -> set[str]:
    found: set[str] = set()
    todo = list(names)
    while todo:
        if (n := todo.pop()) in sql and n not in found:
            found.add(n)
            todo += re.findall(r"\b\w+\b", sql[n])
    return found


def oracle(sql: dict[str, str], select: str) -> str:
    """A DuckDB statement: the select, with the common table expressions (these and the adapters) that it needs."""
    every = DUCK | sql

    used = _needed(every, *re.findall(r"\b\w+\b", select))
    ctes = ", ".join(f"{n} AS ({every[n]})" for n in every if n in used)
    for t in BASE:
        ctes = ctes.replace("{" + t + "}", t)
    return f"WITH {'RECURSIVE ' * any(n.startswith('walk') for n in used)}{ctes} {select}"
