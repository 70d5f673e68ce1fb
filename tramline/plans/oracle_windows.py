"""Check SQL of the queries in ``catalog_windows`` and of ``shape_simplify``."""

from __future__ import annotations

from tramline.plans.catalog import STUCK
from tramline.plans.oracle import BANDS, haversine, sql

SQL: dict[str, str] = {}


def windows(slide_hours: int, n: int) -> str:
    """Each position under the starts of the n windows that hold it."""
    slide = slide_hours * 3_600_000_000
    return f"""SELECT *, make_timestamp((CAST(floor(epoch_us(ts) / {slide}) AS BIGINT) - k) * {slide}) AS w
               FROM pos, range({n}) r(k)"""


SQL["active_in_window"] = sql(
    """SELECT route_id, w AS from_time, w + INTERVAL 24 HOUR AS until, count(*) AS sightings,
              min(ts) AS first_seen, max(ts) AS last_seen FROM held GROUP BY route_id, w""",
    "pos", held=windows(6, 4),
)
SQL["latest_in_window"] = sql(
    """SELECT vehicle_id, w + INTERVAL 48 HOUR AS until, id, trip_id, ts AS "timestamp" FROM held
       QUALIFY row_number() OVER (PARTITION BY w, vehicle_id ORDER BY ts DESC, id DESC) = 1""",
    "pos", held=windows(24, 2),
)
SQL["trip_sessions"] = sql(
    """SELECT trip_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS fixes FROM (
         SELECT trip_id, ts, sum(fresh) OVER (PARTITION BY trip_id ORDER BY ts, id) AS run FROM marked) x
       GROUP BY trip_id, run""",
    "pos",
    marked="""SELECT trip_id, ts, id, CASE WHEN lag(ts) OVER (PARTITION BY trip_id ORDER BY ts, id) >= ts - INTERVAL 48 HOUR
                THEN 0 ELSE 1 END AS fresh FROM pos""",
)
LIVE = "ts >= TIMESTAMP '2024-01-17 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
SQL["latest_position_live"] = sql(
    f"""SELECT id, vehicle_id, trip_id, route_id, ts AS "timestamp" FROM pos WHERE {LIVE}
        QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) = 1""",
    "pos",
)
SQL["export_by_mode"] = sql(
    """SELECT l.id, l.vehicle_id, l.route_id, l.occ AS occupancy_status,
              CASE WHEN r.route_type IN ('0', '1', '2') THEN 'rail' WHEN r.route_type = '3' THEN 'bus' ELSE 'other' END AS mode
       FROM (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) = 1) l
       JOIN ev_routes r USING (route_id)""",
    "pos", "ev_routes",
)
SQL["latest_delay_live"] = sql(
    """SELECT trip_id, arrival_delay AS delay_seconds FROM picked WHERE arrival_delay IS NOT NULL""",
    "upd",
    picked=f"""SELECT * FROM upd WHERE {LIVE} QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC,
                 arrival_delay IS NULL, coalesce(stop_sequence, 2147483647), id) = 1""",
)
_LIVE_STREAK = dict(
    numbered="""SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) AS rn FROM pos
                WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - to_seconds(%d) AND ts <= TIMESTAMP '2024-01-20 12:00:00'""" % STUCK.window_seconds,
    newest="SELECT * FROM numbered WHERE rn = 1",
    marked="""SELECT n.*, abs(f.lat - n.lat) < 0.15 AND abs(f.lon - n.lon) < 0.15 AS same
              FROM numbered n JOIN newest f USING (vehicle_id)""",
    cut="SELECT vehicle_id, coalesce(min(rn) FILTER (WHERE NOT same), 1000000000) AS stop_at, count(*) AS n FROM marked GROUP BY 1",
    streak="""SELECT m.vehicle_id, min(ts) AS stuck_since, count(*) AS streak_rows, bool_and(status = 1) AS only_stopped
              FROM marked m JOIN cut USING (vehicle_id) WHERE rn < stop_at AND n >= 2 GROUP BY 1""",
)
SQL["stationary_streak_live"] = sql(
    """SELECT s.vehicle_id AS vehicle, f.trip_id, stuck_since, streak_rows, only_stopped
       FROM streak s JOIN newest f USING (vehicle_id)""",
    "pos", **_LIVE_STREAK,
)
SQL["terminals_in_reach"] = sql(
    f"""SELECT DISTINCT CAST(p.id AS VARCHAR) AS vehicle FROM pos p JOIN ev_routes r USING (route_id)
        JOIN nstops s ON length(s.stop_id) % 5 = length(r.route_id) % 5
        WHERE s.stop_id = p.stop_id OR (s.stop_lat <> 0 AND s.stop_lon <> 0
          AND {haversine('p.lat', 'p.lon', 's.stop_lat', 's.stop_lon')} < 9000)""",
    "pos", "ev_routes", "nstops",
)
SQL["history_seek"] = sql(
    """SELECT p.id, p.trip_id, r.route_short_name, p.ts AS "timestamp", kd.last_delay_seconds AS delay_seconds
       FROM pg p LEFT JOIN ev_routes r ON r.route_id = p.route_id LEFT JOIN kd ON kd.trip_id = p.trip_id""",
    "pos", "upd", "ev_routes",
    pg="SELECT * FROM pos ORDER BY ts DESC, id DESC LIMIT 150 OFFSET 450",
    kd="""SELECT trip_id, arrival_delay AS last_delay_seconds FROM upd
          WHERE arrival_delay IS NOT NULL AND route_id IN (SELECT route_id FROM pg)
            AND ts >= (SELECT min(ts) FROM pg) - INTERVAL 3 HOUR AND ts <= (SELECT max(ts) FROM pg) + INTERVAL 3 HOUR
          QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC, id DESC) = 1""",
)
SQL["poll_append_rows"] = """
    SELECT fact, event_id % 3 AS poll, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM events, (VALUES ('positions'), ('updates'), ('arrivals')) f(fact)
    WHERE event_id % 3 < 2 GROUP BY 1, 2"""
SQL["rollup_invalidated"] = sql(
    f"""SELECT route_id, bucket, {BANDS}, max(CASE WHEN touched THEN 2 ELSE 1 END)::BIGINT AS version FROM (
          SELECT *, max(late) OVER (PARTITION BY bucket) AS touched FROM (
            SELECT *, id % 10 = 0 AS late, date_trunc('hour', ts) AS bucket FROM evd
            WHERE (id % 10 <> 0 OR ts < TIMESTAMP '2024-01-04') AND ts < TIMESTAMP '2024-01-30 23:00:00'))
        GROUP BY route_id, bucket""",
    "evd",
)
SQL["rollup_backfill"] = sql(
    f"""SELECT route_id, date_trunc('hour', ts) AS bucket, {BANDS} FROM evd
        WHERE ts >= TIMESTAMP '2024-01-16 06:00:00' GROUP BY 1, 2""",
    "evd",
)
SQL["shape_simplify"] = """
WITH RECURSIVE points AS (
  SELECT CAST(user_id AS VARCHAR) AS shape_id, event_id AS seq,
         39.5::DOUBLE + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 200.0::DOUBLE AS lat,
         -105.2::DOUBLE + value / 1000.0::DOUBLE AS lon FROM events
), spans AS (
  SELECT shape_id, min(seq) AS a, max(seq) AS b FROM points GROUP BY shape_id
  UNION ALL
  SELECT shape_id, CASE half WHEN 0 THEN a ELSE cut END AS a, CASE half WHEN 0 THEN cut ELSE b END AS b
  FROM (
    SELECT s.shape_id, s.a, s.b, q.seq AS cut,
           CASE WHEN pow(e.lat - f.lat, 2) + pow(e.lon - f.lon, 2) = 0
             THEN pow(q.lat - f.lat, 2) + pow(q.lon - f.lon, 2)
             ELSE pow((q.lat - f.lat) * (e.lon - f.lon) - (q.lon - f.lon) * (e.lat - f.lat), 2)
               / ((e.lat - f.lat) * (e.lat - f.lat) + (e.lon - f.lon) * (e.lon - f.lon)) END AS far
    FROM spans s JOIN points f ON f.shape_id = s.shape_id AND f.seq = s.a
    JOIN points e ON e.shape_id = s.shape_id AND e.seq = s.b
    JOIN points q ON q.shape_id = s.shape_id AND q.seq > s.a AND q.seq < s.b
    QUALIFY row_number() OVER (PARTITION BY s.shape_id, s.a, s.b ORDER BY far DESC, q.seq) = 1
  ) worst, range(2) h(half) WHERE far > 0.02::DOUBLE * 0.02::DOUBLE
)
SELECT shape_id, seq, lat, lon FROM points
WHERE (shape_id, seq) IN (SELECT shape_id, a FROM spans UNION SELECT shape_id, b FROM spans)
"""
