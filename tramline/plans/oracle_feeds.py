"""Check SQL of the queries in ``catalog_feeds``; says what the files hold after loading."""

from __future__ import annotations

from tramline.plans import oracle
from tramline.plans.oracle import BANDS, sql

SQL: dict[str, str] = {}

SQL["feed_routes"] = """
    SELECT CAST(s_suppkey AS VARCHAR) AS route_id,
           CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'old ' || s_name END AS route_short_name,
           '' AS route_long_name, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey % 4 AS VARCHAR) ELSE '3' END AS route_type,
           '' AS route_color, CASE WHEN s_suppkey % 3 = 0 THEN 'ag' ELSE '' END AS agency_id
    FROM supplier"""
SQL["feed_stops"] = """
    SELECT n_name AS stop_id, CASE WHEN n_nationkey % 2 = 1 THEN 'Stop ' || n_name ELSE 'old' END AS stop_name,
           CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey + 39.5::DOUBLE ELSE n_nationkey::DOUBLE END AS stop_lat,
           CASE WHEN n_nationkey % 2 = 1 AND n_nationkey % 5 <> 0 THEN n_nationkey / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS stop_lon
    FROM nation"""
SQL["feed_stop_directory"] = """
    SELECT n_name AS stop_id, 'old' AS stop_name, 'd' AS stop_desc, n_nationkey::DOUBLE AS stop_lat, 0.0::DOUBLE AS stop_lon
    FROM nation"""
# A row without a route is no trip, so the first folder's stays.
SQL["feed_trips"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_custkey AS VARCHAR) AS route_id,
           CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority END AS service_id,
           CASE WHEN o_orderkey % 6 = 0 THEN '0' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS direction_id,
           CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus ELSE 'old' END AS trip_headsign
    FROM orders"""
SQL["feed_calendar"] = """
    SELECT n_name AS service_id, n_nationkey % 2 = 0 AS monday, n_nationkey % 3 = 0 AS tuesday,
           n_nationkey % 4 = 0 AS wednesday, n_nationkey % 5 = 0 AS thursday, n_nationkey % 6 = 0 AS friday,
           n_nationkey % 7 = 0 AS saturday, n_nationkey % 8 = 0 AS sunday
    FROM nation"""

_TIMES = """
    SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey AS VARCHAR) AS stop_id,
           CAST(l_linenumber AS INTEGER) AS stop_sequence,
           CAST(CASE WHEN l_linenumber % 3 = 0 THEN due + 30 ELSE due END AS INTEGER) AS arrival_secs,
           CAST(CASE WHEN l_linenumber % 3 = 1 THEN due ELSE due + 30 END AS INTEGER) AS departure_secs,
           '0' AS pickup_type, '0' AS drop_off_type, l_linenumber % 2 = 1 AS is_timepoint
    FROM (SELECT *, l_linenumber * 4000 + l_orderkey % 70000 AS due FROM lineitem) WHERE l_linenumber <> 5"""
SQL["feed_stop_times"] = _TIMES
SQL["feed_origin_departures"] = f"""
    SELECT trip_id, departure_secs FROM ({_TIMES})
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) = 1"""
SQL["feed_timepoints"] = f"""
    SELECT t.trip_id, t.stop_sequence, t.stop_id, t.arrival_secs FROM ({_TIMES}) t
    JOIN part ON CAST(p_partkey AS VARCHAR) = t.stop_id WHERE t.is_timepoint"""
SQL["feed_stop_list"] = f"""
    SELECT t.trip_id, t.stop_sequence, t.stop_id, p_name AS stop_name, t.is_timepoint, t.pickup_type
    FROM ({_TIMES}) t LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = t.stop_id"""
SQL["feed_shape_points"] = """
    SELECT p_brand AS shape_id, CAST(p_partkey AS INTEGER) AS seq, p_size / 8.0::DOUBLE AS lat,
           (p_partkey % 100)::DOUBLE AS lon FROM part WHERE p_partkey % 10 <> 0"""
SQL["nearest_variant"] = """
    SELECT p_brand AS shape_id FROM part
    ORDER BY pow(p_size / 8.0::DOUBLE - 3, 2) + pow((p_partkey % 1000)::DOUBLE - 500, 2), p_brand LIMIT 1"""
SQL["ridership_load"] = sql("SELECT route_id, month, CAST(boardings AS BIGINT) AS boardings FROM rider", "rider")
SQL["rollup_refresh"] = sql(
    f"""SELECT route_id, date_trunc('hour', ts) AS bucket, {BANDS} FROM (
          SELECT route_id, ts, delay FROM evd WHERE ts < TIMESTAMP '2024-01-28'
          UNION ALL SELECT route_id, ts, delay + 60 FROM evd
          WHERE ts >= TIMESTAMP '2024-01-28' AND ts < TIMESTAMP '2024-01-30 23:00:00'
            AND CAST(ts AS DATE) <> DATE '2024-01-29') GROUP BY 1, 2""",
    "evd",
)
SQL["guarded_rebuild_rows"] = sql(
    """SELECT route_id, ts AS "timestamp", CASE WHEN ts <= TIMESTAMP '2024-01-16' THEN delay + 1 ELSE delay END AS delay_seconds
       FROM evd""",
    "evd",
)
SQL["cold_retained"] = sql(
    """SELECT id, route_id, ts AS "timestamp" FROM pos WHERE ts >= TIMESTAMP '2024-01-17'""", "pos")
SQL["export_json_rows"] = sql(
    """SELECT vehicle_id, trip_id, occ AS occupancy_status,
              strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%f') || 'Z' AS "timestamp" FROM pos""", "pos")
SQL["route_scope_rows"] = """
    SELECT event_type AS route_id, count(*) AS n FROM events
    WHERE event_type IN ('view', 'click') OR length(event_type) % 5 = 3 GROUP BY 1"""
SQL["route_list_rows"] = """
    SELECT event_type AS route_id, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1"""
_NEWEST = "SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) = 1"
SQL["vehicles_at_stop"] = sql(
    f"""SELECT vehicle_id, stop_id, ts AS "timestamp" FROM ({_NEWEST}) WHERE stop_id = 'NATION_7'""", "pos")
SQL["still_running"] = sql(
    f"""SELECT g.vehicle_label, g.trip_id, g.end_time FROM (
          SELECT vehicle_label, trip_id, max(ts) AS end_time FROM pos GROUP BY 1, 2) g
        JOIN ({_NEWEST}) n ON n.vehicle_label = g.vehicle_label AND n.trip_id = g.trip_id
        WHERE end_time >= TIMESTAMP '2024-01-29'""",
    "pos",
)
SQL["route_headways"] = """
    SELECT CAST(h AS INTEGER) AS hour, n AS headway_minutes FROM range(24) r(h) LEFT JOIN (
      SELECT extract(hour FROM ts) AS hour, count(*) AS n FROM events
      WHERE event_type = 'view' AND extract(hour FROM ts) % 5 <> 0 GROUP BY 1) x ON x.hour = r.h"""
SQL["route_detail"] = f"SELECT * FROM ({oracle.SQL['route_list']}) WHERE route_id = 'view'"
SQL["ordered_route_stops"] = f"SELECT route_id, stop_sequence, stop_id FROM ({oracle.SQL['route_stops']}) WHERE route_id = '3'"
SQL["schedule_frequency"] = f"""
    SELECT route_id, weekday_trips, span_start, span_end FROM ({oracle.SQL['schedule_summary']}) WHERE weekday_trips > 0"""
