"""Check SQL for the registered queries, in the dialect of DuckDB.

Written apart from the Spark side: band ends, calendar arithmetic, rounding and
ranking are spelled out again here instead of sharing code.
"""

from __future__ import annotations

DENVER = "America/Denver"


def r1(x: str) -> str:
    """One-decimal text of a double, read back."""
    return f"CAST(printf('%.1f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {r1(f'100 * {part} / CAST({whole} AS DOUBLE)')} ELSE 0.0 END"


def avg(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {r1(f'CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE)')} ELSE 0.0 END"


def big(x: str) -> str:
    return f"CAST(coalesce({x}, 0) AS BIGINT)"


def local(ts: str) -> str:
    return f"(({ts}) AT TIME ZONE 'UTC' AT TIME ZONE '{DENVER}')"


def utc(wall: str) -> str:
    return f"(({wall}) AT TIME ZONE '{DENVER}' AT TIME ZONE 'UTC')"


def midnight(day: str) -> str:
    return utc(f"TIMESTAMP '{day} 00:00:00'")


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
TRIP = "CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d')"

CTE = {
    "arr": """
        SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey AS VARCHAR) AS route_id,
               CAST(l_partkey AS VARCHAR) AS stop_id, CAST(l_linenumber AS INTEGER) AS stop_sequence,
               l_shipdate AS ts, date_diff('day', o_orderdate, l_shipdate) AS delay
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "evd": f"""
        SELECT event_id AS id, {TRIP} AS trip_id, event_type AS route_id,
               CAST(user_id AS VARCHAR) AS stop_id, {K} % 10 + 1 AS stop_sequence, ts,
               ({K} - 50) * 20 AS delay
        FROM events""",
    "pos": f"""
        SELECT event_id AS id, {TRIP} AS trip_id, event_type AS route_id,
               CAST(user_id AS VARCHAR) AS vehicle_id, 'V' || CAST(user_id AS VARCHAR) AS vehicle_label,
               39.5::DOUBLE + {K} / 200.0::DOUBLE AS lat, -105.2::DOUBLE + value / 1000.0::DOUBLE AS lon,
               {K} * 3.6::DOUBLE AS bearing, {K} % 10 AS current_stop_sequence,
               CAST(event_id % 3 AS INTEGER) AS status, 'NATION_' || CAST({K} % 25 AS VARCHAR) AS stop_id,
               CASE {K} % 9 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'MANY_SEATS_AVAILABLE'
                 WHEN 2 THEN 'FEW_SEATS_AVAILABLE' WHEN 3 THEN 'STANDING_ROOM_ONLY'
                 WHEN 4 THEN 'CRUSHED_STANDING_ROOM_ONLY' WHEN 5 THEN 'FULL'
                 WHEN 6 THEN 'NOT_ACCEPTING_PASSENGERS' WHEN 7 THEN 'UNKNOWN' END AS occ,
               ts
        FROM events""",
    "upd": f"""
        SELECT event_id AS id, {TRIP} AS trip_id, event_type AS route_id,
               nullif({K} % 10, 0) AS stop_sequence,
               CASE WHEN {K} % 7 <> 0 THEN ({K} - 50) * 20 END AS arrival_delay,
               date_trunc('hour', ts) AS ts
        FROM events""",
    "ev_routes": """
        SELECT DISTINCT event_type AS route_id, upper(event_type) AS route_short_name,
               'Line ' || event_type AS route_long_name,
               CAST(length(event_type) % 5 AS VARCHAR) AS route_type, '00AA00' AS route_color
        FROM events""",
    "sup_routes": """
        SELECT CAST(s_suppkey AS VARCHAR) AS route_id, s_name AS route_short_name,
               CAST(s_nationkey % 4 AS VARCHAR) AS route_type FROM supplier""",
    "nstops": """
        SELECT n_name AS stop_id, 'Stop ' || n_name AS stop_name,
               39.5::DOUBLE + n_nationkey / 15.0::DOUBLE AS stop_lat,
               -105.2::DOUBLE + n_nationkey / 20.0::DOUBLE AS stop_lon FROM nation""",
    "pstops": """
        SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name,
               39.0::DOUBLE + (p_partkey % 1000) / 1000.0::DOUBLE AS stop_lat,
               -105.0::DOUBLE + p_size / 100.0::DOUBLE AS stop_lon, p_size <= 10 AS is_rail FROM part""",
    "tp": f"""
        SELECT trip_id, CAST(n + 1 AS INTEGER) AS stop_sequence, n_name AS stop_id,
               CAST(n * 10800 AS INTEGER) AS arrival_secs,
               39.5::DOUBLE + n / 15.0::DOUBLE AS stop_lat, -105.2::DOUBLE + n / 100.0::DOUBLE AS stop_lon
        FROM (SELECT DISTINCT {TRIP} AS trip_id FROM events) t, range(8) r(n)
        JOIN nation ON n_nationkey = (n + 5 * (ascii(right(trip_id, 1)) % 5)) % 25""",
    "lines": """
        SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_linenumber AS INTEGER) AS stop_sequence,
               CAST(min(l_partkey) AS VARCHAR) AS stop_id
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "otrips": """
        SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, route_id, o_orderpriority AS service_id,
               CAST(o_custkey % 2 AS VARCHAR) AS direction_id, o_orderstatus AS trip_headsign,
               CAST((o_orderkey * 977) % 100000 AS INTEGER) AS departure_secs
        FROM orders JOIN (SELECT l_orderkey, CAST(min(l_suppkey) AS VARCHAR) AS route_id
                          FROM lineitem GROUP BY l_orderkey) r ON o_orderkey = l_orderkey""",
    "cal": """
        SELECT o_orderpriority AS service_id,
               (CAST(left(o_orderpriority, 1) AS INT) + 0) % 3 <> 0 AS monday,
               (CAST(left(o_orderpriority, 1) AS INT) + 1) % 3 <> 0 AS tuesday,
               (CAST(left(o_orderpriority, 1) AS INT) + 2) % 3 <> 0 AS wednesday,
               (CAST(left(o_orderpriority, 1) AS INT) + 3) % 3 <> 0 AS thursday,
               (CAST(left(o_orderpriority, 1) AS INT) + 4) % 3 <> 0 AS friday,
               (CAST(left(o_orderpriority, 1) AS INT) + 5) % 3 <> 0 AS saturday,
               (CAST(left(o_orderpriority, 1) AS INT) + 6) % 3 <> 0 AS sunday
        FROM (SELECT DISTINCT o_orderpriority FROM orders)""",
    "tdow": """
        SELECT route_id, sum(monday::INT) AS mo, sum(tuesday::INT) AS tu, sum(wednesday::INT) AS we,
               sum(thursday::INT) AS th, sum(friday::INT) AS fr, sum(saturday::INT) AS sa,
               sum(sunday::INT) AS su
        FROM otrips JOIN cal USING (service_id) GROUP BY route_id""",
    "mondays": """
        SELECT route_id, direction_id, departure_secs FROM otrips JOIN cal USING (service_id)
        WHERE monday""",
    "rider": """
        SELECT CAST(c_nationkey AS VARCHAR) AS route_id,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS boardings
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
}

NEEDS = {"tdow": ["otrips", "cal"], "mondays": ["otrips", "cal"]}


def sql(body: str, *names: str, **extra: str) -> str:
    """A query over named stand-ins and further common tables, in order."""
    wanted: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    parts = [f"{name} AS ({CTE[name]})" for name in wanted]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


BANDS = """
    count(*) FILTER (WHERE delay < -600) AS very_early,
    count(*) FILTER (WHERE delay >= -600 AND delay < -300) AS early,
    count(*) FILTER (WHERE delay >= -300 AND delay <= 300) AS on_time,
    count(*) FILTER (WHERE delay > 300 AND delay <= 600) AS slightly_late,
    count(*) FILTER (WHERE delay > 600 AND delay <= 900) AS late,
    count(*) FILTER (WHERE delay > 900) AS very_late,
    count(delay) AS observations, CAST(sum(delay) AS BIGINT) AS delay_sum,
    CAST(sum(CAST(delay AS BIGINT) * delay) AS BIGINT) AS delay_sumsq"""


def hourly(source: str) -> str:
    return (
        f"SELECT route_id, date_trunc('hour', ts) AS bucket, {BANDS} FROM {source} GROUP BY 1, 2"
    )


ARR_RANGE = f"bucket >= {midnight('1995-01-01')} AND bucket < {midnight('2002-01-01')}"
EV_RANGE = f"bucket >= {midnight('2023-12-31')} AND bucket < {midnight('2024-02-01')}"

FOLD = f"""
    {big('sum(on_time)')} AS on_time,
    {big('sum(slightly_late + late + very_late)')} AS late,
    {big('sum(very_early + early)')} AS early,
    {big('sum(observations)')} AS observations, {big('sum(delay_sum)')} AS delay_sum"""

SHARES = f"""
    {pct('on_time', '(on_time + late + early)')} AS on_time_pct,
    {avg('delay_sum', 'observations')} AS avg_delay_seconds"""

OCC_COUNTERS = """
    count(*) FILTER (WHERE occ = 'EMPTY') AS empty,
    count(*) FILTER (WHERE occ = 'MANY_SEATS_AVAILABLE') AS many_seats,
    count(*) FILTER (WHERE occ = 'FEW_SEATS_AVAILABLE') AS few_seats,
    count(*) FILTER (WHERE occ = 'STANDING_ROOM_ONLY') AS standing,
    count(*) FILTER (WHERE occ = 'CRUSHED_STANDING_ROOM_ONLY') AS crushed,
    count(*) FILTER (WHERE occ = 'FULL') AS "full",
    count(*) FILTER (WHERE occ = 'NOT_ACCEPTING_PASSENGERS') AS not_accepting,
    count(*) FILTER (WHERE occ IS NULL OR occ = 'UNKNOWN') AS unknown,
    count(*) AS samples"""
OCC_HOURLY = f"SELECT route_id, trip_id, date_trunc('hour', ts) AS bucket, {OCC_COUNTERS} FROM pos GROUP BY 1, 2, 3"
OCC_SUMS = ", ".join(
    f'{big(f"sum({c})")} AS {c}'
    for c in ("empty", "many_seats", "few_seats", "standing", "crushed", '"full"', "not_accepting", "unknown")
)
KNOWN = 'empty + many_seats + few_seats + standing + crushed + "full" + not_accepting'

STOP_DAILY = """
    SELECT route_id, stop_id, date_trunc('day', ts) AS bucket,
           count(*) FILTER (WHERE delay > 300) AS late,
           count(*) FILTER (WHERE delay >= -300 AND delay <= 300) AS on_time,
           count(delay) AS observations, CAST(sum(delay) AS BIGINT) AS delay_sum
    FROM arr GROUP BY 1, 2, 3"""

ACTIVITY = """SELECT route_id, trip_id, date_trunc('day', ts) AS bucket, count(*) AS observations
              FROM arr GROUP BY 1, 2, 3"""


def weekdays_between(first: str, last: str) -> str:
    """How often each weekday falls in a closed range of days."""
    names = {1: "mo", 2: "tu", 3: "we", 4: "th", 5: "fr", 6: "sa", 0: "su"}
    counts = ", ".join(
        f"count(*) FILTER (WHERE extract(dow FROM d) = {n}) AS n_{name}" for n, name in names.items()
    )
    return f"SELECT {counts} FROM generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) g(d)"


PLANNED = "mo*n_mo + tu*n_tu + we*n_we + th*n_th + fr*n_fr + sa*n_sa + su*n_su"

SQL: dict[str, str] = {}

SQL["ontime_rollup"] = sql(hourly("arr"), "arr")
SQL["ontime_rollup_hourly"] = sql(hourly("evd"), "evd")

SQL["ontime_by_route"] = sql(
    f"""SELECT route_id, on_time, late, early, observations, delay_sum,
               CASE WHEN overall THEN {pct('on_time', 'observations')}
                    ELSE {pct('on_time', '(on_time + late + early)')} END AS on_time_pct,
               {avg('delay_sum', 'observations')} AS avg_delay_seconds, overall,
               coalesce(route_short_name, route_id) AS route_short_name
        FROM (SELECT route_id, FALSE AS overall, {FOLD} FROM h WHERE {ARR_RANGE} GROUP BY route_id
              UNION ALL SELECT NULL, TRUE, {FOLD} FROM h WHERE {ARR_RANGE}) x
        LEFT JOIN sup_routes USING (route_id)""",
    "arr", "sup_routes", h=hourly("arr"),
)

SQL["ontime_top_routes"] = sql(
    f"""SELECT * FROM (SELECT route_id, on_time, late, early, observations, delay_sum, {SHARES}
        FROM (SELECT route_id, {FOLD} FROM h WHERE {ARR_RANGE} GROUP BY route_id))
        ORDER BY on_time_pct DESC, route_id LIMIT 20""",
    "arr", h=hourly("arr"),
)

SQL["ontime_trend_day"] = sql(
    f"""SELECT t, {SHARES}, observations FROM (
          SELECT date_trunc('day', {local('bucket')}) AS t, {FOLD} FROM h WHERE {EV_RANGE} GROUP BY 1)""",
    "evd", h=hourly("evd"),
)
SQL["ontime_trend_hour"] = sql(
    f"""SELECT t, {SHARES}, observations FROM (
          SELECT bucket AS t, {FOLD} FROM h WHERE {EV_RANGE} GROUP BY 1)""",
    "evd", h=hourly("evd"),
)
SQL["heatmap_hour_dow"] = sql(
    f"""SELECT dow, hour, {SHARES}, observations FROM (
          SELECT CAST(extract(dow FROM {local('bucket')}) AS INTEGER) AS dow,
                 CAST(extract(hour FROM {local('bucket')}) AS INTEGER) AS hour, {FOLD}
          FROM h WHERE {EV_RANGE} GROUP BY 1, 2)""",
    "evd", h=hourly("evd"),
)

_LABELS = {
    "very_early": "Very early (>10m)", "early": "Early (5–10m)", "on_time": "On time (±5m)",
    "slightly_late": "Slightly late (5–10m)", "late": "Late (10–15m)", "very_late": "Very late (>15m)",
}
SQL["delay_distribution"] = sql(
    " UNION ALL ".join(
        f"""SELECT {i} AS bin, '{key}' AS key, '{label}' AS label, {key} AS "count",
                   {pct(key, 'total')} AS pct, total, {avg('delay_sum', 'observations')} AS avg_delay_seconds,
                   CASE WHEN v > 0 THEN {r1('sqrt(v)')} ELSE 0.0 END AS stddev_seconds FROM s2"""
        for i, (key, label) in enumerate(_LABELS.items())
    ),
    "arr",
    h=hourly("arr"),
    s=f"""SELECT {', '.join(f'{big(f"sum({k})")} AS {k}' for k in _LABELS)},
            {big('sum(observations)')} AS observations, {big('sum(delay_sum)')} AS delay_sum,
            CAST(coalesce(sum(delay_sumsq), 0) AS DOUBLE) AS delay_sumsq FROM h WHERE {ARR_RANGE}""",
    s2=f"""SELECT *, {' + '.join(_LABELS)} AS total,
             delay_sumsq / observations - (CAST(delay_sum AS DOUBLE) / observations)
               * (CAST(delay_sum AS DOUBLE) / observations) AS v FROM s""",
)

SQL["stop_delay_rollup"] = sql(STOP_DAILY, "arr")
SQL["worst_stops"] = sql(
    f"""SELECT w.stop_id, observations, mean_delay, {pct('on_time', 'observations')} AS on_time_pct,
               {r1('mean_delay')} AS avg_delay_seconds, stop_name
        FROM (SELECT stop_id, {big('sum(on_time)')} AS on_time, {big('sum(observations)')} AS observations,
                     CAST(sum(delay_sum) AS DOUBLE) / CAST(sum(observations) AS DOUBLE) AS mean_delay
              FROM d WHERE {ARR_RANGE} GROUP BY stop_id HAVING sum(observations) >= 20
              ORDER BY mean_delay DESC, stop_id LIMIT 15) w
        LEFT JOIN pstops ON pstops.stop_id = w.stop_id""",
    "arr", "pstops", d=STOP_DAILY,
)

SQL["trip_activity"] = sql(ACTIVITY, "arr")
SQL["scheduled_trips_in_range"] = sql(
    f"SELECT route_id, CAST({PLANNED} AS BIGINT) AS scheduled_trips FROM tdow CROSS JOIN w",
    "tdow", w=weekdays_between("1995-01-01", "2001-12-31"),
)
_DELIVERED = """CASE WHEN scheduled_trips > 0 THEN {} ELSE 0.0 END AS delivered_pct""".format(
    r1("least(100.0, 100 * observed_trips / CAST(scheduled_trips AS DOUBLE))")
)
_DELIVERY = dict(
    a=ACTIVITY,
    w=weekdays_between("1995-01-01", "2001-12-31"),
    r=f"""SELECT o.route_id, observed_trips, CAST(coalesce({PLANNED}, 0) AS BIGINT) AS scheduled_trips
          FROM (SELECT route_id, count(*) AS observed_trips FROM a WHERE {ARR_RANGE} GROUP BY 1) o
          LEFT JOIN tdow ON tdow.route_id = o.route_id CROSS JOIN w""",
)
SQL["service_delivery"] = sql(
    f"""SELECT route_id, observed_trips, scheduled_trips, overall, {_DELIVERED},
               coalesce(route_short_name, route_id) AS route_short_name
        FROM (SELECT route_id, observed_trips, scheduled_trips, FALSE AS overall FROM r
              UNION ALL SELECT NULL, {big('sum(observed_trips)')}, {big('sum(scheduled_trips)')}, TRUE FROM r)
        LEFT JOIN sup_routes USING (route_id)""",
    "arr", "tdow", "sup_routes", **_DELIVERY,
)
SQL["least_delivered"] = sql(
    f"""SELECT route_id, observed_trips, scheduled_trips, {_DELIVERED} FROM r WHERE scheduled_trips > 0
        ORDER BY delivered_pct, route_id LIMIT 20""",
    "arr", "tdow", **_DELIVERY,
)

_SPAN = f"({midnight('2002-01-01')} - {midnight('1998-07-01')})"


def _period(table: str) -> str:
    low, high = midnight("1998-07-01"), midnight("2002-01-01")
    return f"""SELECT *, bucket >= {low} AS cur FROM {table}
               WHERE bucket >= {low} - {_SPAN} AND bucket < {high}"""


def _half(cond: str, suffix: str) -> str:
    return f"""
        {big(f'sum(on_time) FILTER (WHERE {cond})')} AS ot{suffix},
        {big(f'sum(very_early + early + on_time + slightly_late + late + very_late) FILTER (WHERE {cond})')} AS b{suffix},
        {big(f'sum(observations) FILTER (WHERE {cond})')} AS n{suffix},
        {big(f'sum(delay_sum) FILTER (WHERE {cond})')} AS ds{suffix}"""


# 1,280 days from 1998-07-01 to 2001-12-31, so the span before starts 1994-12-29.
SQL["overview_period_delta"] = sql(
    f"""SELECT 1280 AS period_days, {pct('ot', 'b')} AS on_time_pct, {avg('ds', 'n')} AS avg_delay_seconds,
               {pct('ot_p', 'b_p')} AS on_time_pct_prev, {avg('ds_p', 'n_p')} AS avg_delay_seconds_prev,
               CASE WHEN planned > 0 THEN {r1('least(100.0, 100 * seen / CAST(planned AS DOUBLE))')} ELSE 0.0 END
                 AS service_delivered_pct,
               CASE WHEN planned_p > 0 THEN {r1('least(100.0, 100 * seen_p / CAST(planned_p AS DOUBLE))')} ELSE 0.0 END
                 AS service_delivered_pct_prev,
               CASE WHEN n > 0 AND sq / n - (CAST(ds AS DOUBLE) / n) * (CAST(ds AS DOUBLE) / n) > 0
                    THEN {r1('sqrt(sq / n - (CAST(ds AS DOUBLE) / n) * (CAST(ds AS DOUBLE) / n))')} ELSE 0.0 END
                 AS delay_stddev_seconds,
               seen AS observed_trips, planned AS scheduled_trips, routes AS routes_tracked,
               n AS total_observations, m1 AS latest_ridership_month, t1 AS latest_ridership_total,
               t2 AS prev_ridership_total
        FROM o CROSS JOIN t CROSS JOIN p CROSS JOIN q CROSS JOIN m""",
    "arr", "tdow", "rider",
    h=hourly("arr"), a=ACTIVITY, hp=_period("h"), ap=_period("a"),
    o=f"""SELECT {_half('cur', '')}, {_half('NOT cur', '_p')},
            CAST(coalesce(sum(delay_sumsq) FILTER (WHERE cur), 0) AS DOUBLE) AS sq,
            count(DISTINCT route_id) FILTER (WHERE cur) AS routes FROM hp""",
    t="SELECT count(*) FILTER (WHERE cur) AS seen, count(*) FILTER (WHERE NOT cur) AS seen_p FROM ap",
    w=weekdays_between("1998-07-01", "2001-12-31"), wp=weekdays_between("1994-12-29", "1998-06-30"),
    p=f"SELECT {big(f'sum({PLANNED})')} AS planned FROM tdow CROSS JOIN w",
    q=f"SELECT {big(f'sum({PLANNED})')} AS planned_p FROM tdow CROSS JOIN wp",
    mm="SELECT month, CAST(sum(boardings) AS BIGINT) AS t, row_number() OVER (ORDER BY month DESC) AS rn FROM rider GROUP BY month",
    m="""SELECT max(month) FILTER (WHERE rn = 1) AS m1, max(t) FILTER (WHERE rn = 1) AS t1,
                max(t) FILTER (WHERE rn = 2) AS t2 FROM mm""",
)

SQL["occupancy_rollup"] = sql(OCC_HOURLY, "pos")
SQL["occupancy_totals"] = sql(
    f"""SELECT *, empty + many_seats AS low, few_seats AS medium,
               standing + crushed + "full" + not_accepting AS high, {KNOWN} > 0 AS reported,
               CASE WHEN {KNOWN} > 0 THEN
                 {r1(f'100 * (standing + crushed + "full" + not_accepting) / CAST({KNOWN} AS DOUBLE)')} END AS standing_pct
        FROM (SELECT {OCC_SUMS}, {big('sum(samples)')} AS samples FROM o WHERE {EV_RANGE})""",
    "pos", o=OCC_HOURLY,
)
_BY_HOUR = f"""SELECT CAST(extract(hour FROM {local('bucket')}) AS INTEGER) AS hour, {OCC_SUMS},
                 {big('sum(samples)')} AS total FROM o WHERE {EV_RANGE} GROUP BY 1"""
SQL["occupancy_by_hour"] = sql(f"SELECT * FROM ({_BY_HOUR}) WHERE {KNOWN} > 0", "pos", o=OCC_HOURLY)
SQL["occupancy_shares_by_hour"] = sql(
    "SELECT hour, "
    + ", ".join(
        f"{pct(c, f'({KNOWN})')} AS {c}"
        for c in ("empty", "many_seats", "few_seats", "standing", "crushed", '"full"', "not_accepting")
    )
    + f" FROM ({_BY_HOUR}) WHERE {KNOWN} > 0",
    "pos", o=OCC_HOURLY,
)
SQL["occupancy_levels"] = sql(
    """SELECT route_id, date_trunc('hour', ts) AS bucket,
         count(*) FILTER (WHERE occ IN ('EMPTY', 'MANY_SEATS_AVAILABLE')) AS low,
         count(*) FILTER (WHERE occ = 'FEW_SEATS_AVAILABLE') AS medium,
         count(*) FILTER (WHERE occ IN ('STANDING_ROOM_ONLY', 'CRUSHED_STANDING_ROOM_ONLY', 'FULL',
                                        'NOT_ACCEPTING_PASSENGERS')) AS high,
         count(*) FILTER (WHERE occ IS NULL OR occ = 'UNKNOWN') AS unknown, count(*) AS samples
       FROM pos GROUP BY 1, 2""",
    "pos",
)
SQL["ontime_rollup_two_minutes"] = sql(
    """SELECT route_id, date_trunc('hour', ts) AS bucket,
         count(*) FILTER (WHERE delay < -300) AS very_early,
         count(*) FILTER (WHERE delay >= -300 AND delay < -120) AS early,
         count(*) FILTER (WHERE delay >= -120 AND delay <= 120) AS on_time,
         count(*) FILTER (WHERE delay > 120 AND delay <= 300) AS slightly_late,
         count(*) FILTER (WHERE delay > 300 AND delay <= 600) AS late,
         count(*) FILTER (WHERE delay > 600) AS very_late,
         count(delay) AS observations, CAST(sum(delay) AS BIGINT) AS delay_sum,
         CAST(sum(CAST(delay AS BIGINT) * delay) AS BIGINT) AS delay_sumsq
       FROM arr GROUP BY 1, 2""",
    "arr",
)
SQL["feed_delay_rollup"] = sql(
    """SELECT route_id, ts AS bucket,
         count(*) FILTER (WHERE arrival_delay < -300) AS very_early,
         count(*) FILTER (WHERE arrival_delay >= -300 AND arrival_delay < -60) AS early,
         count(*) FILTER (WHERE arrival_delay >= -60 AND arrival_delay <= 300) AS on_time,
         count(*) FILTER (WHERE arrival_delay > 300 AND arrival_delay <= 600) AS slightly_late,
         count(*) FILTER (WHERE arrival_delay > 600 AND arrival_delay <= 1200) AS late,
         count(*) FILTER (WHERE arrival_delay > 1200) AS very_late,
         count(arrival_delay) AS observations, CAST(sum(arrival_delay) AS BIGINT) AS delay_sum,
         CAST(sum(CAST(arrival_delay AS BIGINT) * arrival_delay) AS BIGINT) AS delay_sumsq
       FROM upd GROUP BY 1, 2""",
    "upd",
)

FIVE = "date_trunc('hour', ts) + to_minutes(CAST(floor(extract(minute FROM ts) / 5) * 5 AS INTEGER))"
PER_FIVE = f"""SELECT route_id, {FIVE} AS bucket, count(DISTINCT coalesce(vehicle_id, trip_id)) AS vehicles
               FROM pos GROUP BY 1, 2"""
SQL["active_per_5min"] = sql(PER_FIVE, "pos")
SQL["headway_now"] = sql(
    f"""SELECT route_id, vehicle_count, coalesce(route_short_name, route_id) AS route_short_name,
          CASE WHEN vehicle_count >= 2 THEN {r1('cycle / (s / CAST(n AS DOUBLE))')} ELSE 0.0 END AS avg_headway_minutes,
          CASE WHEN vehicle_count >= 2 THEN {r1('cycle / vehicle_count')} ELSE 0.0 END AS min_headway_minutes,
          CASE WHEN vehicle_count >= 2 THEN {r1('cycle / greatest(1, lo)')} ELSE 0.0 END AS max_headway_minutes
        FROM (SELECT route_id, max(vehicles) AS vehicle_count, min(vehicles) AS lo, sum(vehicles) AS s,
                     count(*) AS n FROM f GROUP BY 1) x
        LEFT JOIN (SELECT *, CASE route_type WHEN '0' THEN 45.0::DOUBLE WHEN '1' THEN 30.0::DOUBLE
                     WHEN '2' THEN 120.0::DOUBLE ELSE 90.0::DOUBLE END AS cycle FROM ev_routes) USING (route_id)""",
    "pos", "ev_routes", f=PER_FIVE,
)
SQL["headway_scheduled"] = sql(
    f"""SELECT route_id, hour, {r1('sum(gap) / count(*)')} AS headway_minutes FROM (
          SELECT route_id, direction_id, CAST((departure_secs // 3600) % 24 AS INTEGER) AS hour,
                 60.0::DOUBLE / count(*) AS gap FROM mondays GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "mondays",
)
SQL["schedule_summary"] = sql(
    """SELECT t.route_id, CAST(mo AS BIGINT) AS monday, CAST(tu AS BIGINT) AS tuesday,
              CAST(we AS BIGINT) AS wednesday, CAST(th AS BIGINT) AS thursday, CAST(fr AS BIGINT) AS friday,
              CAST(sa AS BIGINT) AS saturday, CAST(su AS BIGINT) AS sunday, CAST(mo AS BIGINT) AS weekday_trips,
              CAST(sa AS BIGINT) AS saturday_trips, CAST(su AS BIGINT) AS sunday_trips,
              printf('%02d:%02d', (a // 3600) % 24, (a % 3600) // 60) AS span_start,
              printf('%02d:%02d', (b // 3600) % 24, (b % 3600) // 60) AS span_end
       FROM tdow t LEFT JOIN (SELECT route_id, min(departure_secs) AS a, max(departure_secs) AS b
                              FROM mondays GROUP BY 1) s ON s.route_id = t.route_id
       WHERE greatest(mo, tu, we, th, fr, sa, su) > 0""",
    "tdow", "mondays",
)
SQL["monthly_series"] = sql(
    """SELECT month, CAST(sum(boardings) AS BIGINT) AS boardings FROM rider GROUP BY month
       ORDER BY month DESC LIMIT 24""",
    "rider",
)
SQL["ridership_latest_routes"] = sql(
    """SELECT route_id, month, CAST(boardings AS BIGINT) AS boardings FROM rider
       WHERE month = (SELECT max(month) FROM rider)""",
    "rider",
)
SQL["rollup_with_live_tail"] = sql(hourly("evd"), "evd")
SQL["upsert_monthly"] = sql(
    """SELECT coalesce(n.route_id, o.route_id) AS route_id, coalesce(n.month, o.month) AS month,
              coalesce(n.boardings, o.boardings) AS boardings,
              CASE WHEN n.route_id IS NULL THEN 'kept' WHEN o.route_id IS NULL THEN 'inserted'
                   ELSE 'updated' END AS outcome
       FROM old o FULL OUTER JOIN new n ON o.route_id = n.route_id AND o.month = n.month""",
    "rider",
    old="SELECT route_id, month, boardings FROM rider WHERE month < DATE '1999-01-01'",
    new="""SELECT route_id, month, boardings + 1000 AS boardings FROM rider
           WHERE month >= DATE '1997-01-01'""",
)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
    )


POS_COLUMNS = """id, trip_id, route_id, vehicle_id, vehicle_label, lat AS latitude, lon AS longitude, bearing,
    current_stop_sequence, status AS current_status, stop_id, occ AS occupancy_status, ts AS "timestamp" """
LATEST = """SELECT * FROM pos QUALIFY row_number() OVER (
              PARTITION BY coalesce(vehicle_id, trip_id) ORDER BY ts DESC, id DESC) = 1"""
FEED_DELAY = """SELECT trip_id, arrival_delay AS delay_seconds FROM (
      SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC, (arrival_delay IS NULL)::INT,
                                   stop_sequence NULLS LAST, id) AS rn FROM upd)
    WHERE rn = 1 AND arrival_delay IS NOT NULL"""
KNOWN_DELAY = """SELECT trip_id, arrival_delay AS last_delay_seconds FROM upd
    WHERE arrival_delay IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC, id DESC) = 1"""

SQL["latest_position"] = sql(f"SELECT {POS_COLUMNS} FROM l", "pos", l=LATEST)
SQL["latest_delay"] = sql(FEED_DELAY, "upd")
SQL["latest_known_delay"] = sql(KNOWN_DELAY, "upd")
SQL["dedupe_batch"] = sql(
    """SELECT id, trip_id, route_id, route_id AS vehicle_id, vehicle_label, la AS latitude, lo AS longitude,
              bearing, current_stop_sequence, status AS current_status, stop_id, occ AS occupancy_status,
              ts AS "timestamp", poll
       FROM (SELECT *, date_trunc('hour', ts) AS poll, round(lat, 1) AS la, round(lon, 1) AS lo FROM pos)
       QUALIFY row_number() OVER (PARTITION BY poll, route_id, la, lo ORDER BY id) = 1""",
    "pos",
)

_BOARD = dict(
    l=LATEST,
    hw=f"""SELECT route_id, CASE WHEN count(*) >= 2 THEN {r1('120.0 / count(*)')} ELSE 0.0 END
             AS headway_minutes FROM l GROUP BY 1""",
    fd=FEED_DELAY,
    b="""SELECT l.*, hw.headway_minutes, fd.delay_seconds, s.stop_name,
           coalesce(r.route_short_name, l.route_id) AS route_short_name,
           coalesce(r.route_long_name, '') AS route_long_name,
           coalesce(r.route_color, '888888') AS route_color, coalesce(r.route_type, '') AS route_type
         FROM l LEFT JOIN hw USING (route_id) LEFT JOIN fd ON fd.trip_id = l.trip_id
         LEFT JOIN nstops s ON s.stop_id = l.stop_id LEFT JOIN ev_routes r ON r.route_id = l.route_id
         WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    bb="""SELECT *, CASE WHEN route_type IN ('0', '1', '2') THEN 'rail' WHEN route_type = '3' THEN 'bus' ELSE 'other' END AS mode,
            CASE WHEN coalesce(headway_minutes, 0) = 0 THEN 'unknown' WHEN headway_minutes < 15 THEN 'under15'
              WHEN headway_minutes < 30 THEN 'to30' WHEN headway_minutes < 60 THEN 'to60' ELSE 'over60' END AS headway_band,
            coalesce(occ, 'UNKNOWN') AS occupancy_key, vehicle_label AS vehicle_key,
            CASE WHEN delay_seconds IS NULL THEN 'unknown' WHEN delay_seconds < -300 THEN 'early'
              WHEN delay_seconds <= 300 THEN 'on_time' WHEN delay_seconds <= 900 THEN 'late'
              ELSE 'very_late' END AS punctuality_band,
            CASE status WHEN 0 THEN 'incoming' WHEN 1 THEN 'stopped' WHEN 2 THEN 'in_transit'
              ELSE 'unknown' END AS movement_band FROM b""",
)
_BOARD_TABLES = ("pos", "upd", "nstops", "ev_routes")
SQL["live_board"] = sql(
    f"""SELECT {POS_COLUMNS}, headway_minutes, delay_seconds, stop_name, route_short_name, route_long_name,
               route_color, route_type, delay_seconds > 300 AS is_late,
               CASE status WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' END AS current_status_label
        FROM b""",
    *_BOARD_TABLES, **_BOARD,
)
SQL["snapshot_headways"] = sql("SELECT * FROM hw", "pos", l=_BOARD["l"], hw=_BOARD["hw"])
SQL["board_bands"] = sql(
    "SELECT vehicle_id, mode, vehicle_key, headway_band, occupancy_key, punctuality_band, movement_band FROM bb",
    *_BOARD_TABLES, **_BOARD,
)
_OPTIONS = """SELECT * FROM (VALUES ('mode', 'rail'), ('mode', 'bus'), ('mode', 'other'),
  ('headway', 'under15'), ('headway', 'to30'), ('headway', 'to60'), ('headway', 'over60'), ('headway', 'unknown'),
  ('punctuality', 'early'), ('punctuality', 'on_time'), ('punctuality', 'late'), ('punctuality', 'very_late'),
  ('punctuality', 'unknown'), ('movement', 'stopped'), ('movement', 'in_transit'), ('movement', 'incoming'),
  ('movement', 'unknown')) v(facet, value)"""
SQL["board_facets"] = sql(
    """SELECT facet, value, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT 'mode' AS facet, mode AS value, 1 AS n FROM bb
         UNION ALL SELECT 'route', route_id, 1 FROM bb UNION ALL SELECT 'headway', headway_band, 1 FROM bb
         UNION ALL SELECT 'occupancy', occupancy_key, 1 FROM bb
         UNION ALL SELECT 'punctuality', punctuality_band, 1 FROM bb
         UNION ALL SELECT 'movement', movement_band, 1 FROM bb UNION ALL SELECT 'vehicle', vehicle_key, 1 FROM bb
         UNION ALL SELECT facet, value, 0 FROM opt) GROUP BY 1, 2""",
    *_BOARD_TABLES, **_BOARD, opt=_OPTIONS,
)
SQL["board_filtered"] = sql(
    """SELECT vehicle_id, route_id, punctuality_band, occupancy_key, movement_band FROM bb
       WHERE punctuality_band IN ('late', 'very_late', 'early') AND occupancy_key IN ('FULL', 'EMPTY', 'UNKNOWN')
         AND movement_band IN ('stopped', 'in_transit')""",
    *_BOARD_TABLES, **_BOARD,
)
SQL["active_routes"] = sql(
    """SELECT DISTINCT route_id, route_short_name, route_long_name, mode, vehicle_key, vehicle_label AS label
       FROM bb WHERE route_id IN (
         SELECT route_id FROM bb WHERE contains(lower(route_short_name), 'line')
           OR contains(lower(route_long_name), 'line') OR contains(lower(vehicle_label), 'line'))""",
    *_BOARD_TABLES, **_BOARD,
)
SQL["outside_downtown"] = sql(
    """SELECT id, lat AS latitude, lon AS longitude FROM pos
       WHERE NOT ((lat - 39.75::DOUBLE) * (lat - 39.75::DOUBLE)
         + (lon - (-105.15::DOUBLE)) * (lon - (-105.15::DOUBLE)) < 0.1::DOUBLE * 0.1::DOUBLE)""",
    "pos",
)

_STREAK = dict(
    numbered="SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) AS rn FROM pos",
    newest="SELECT * FROM numbered WHERE rn = 1",
    marked="""SELECT n.*, abs(f.lat - n.lat) < 0.15 AND abs(f.lon - n.lon) < 0.15 AS same
              FROM numbered n JOIN newest f USING (vehicle_id)""",
    cut="SELECT vehicle_id, coalesce(min(rn) FILTER (WHERE NOT same), 1000000000) AS stop_at, count(*) AS n FROM marked GROUP BY 1",
    streak="""SELECT m.vehicle_id, min(ts) AS stuck_since, count(*) AS streak_rows,
                bool_and(status = 1) AS only_stopped
              FROM marked m JOIN cut USING (vehicle_id) WHERE rn < stop_at AND n >= 2 GROUP BY 1""",
)
SQL["stationary_streak"] = sql(
    """SELECT s.vehicle_id AS vehicle, f.trip_id, stuck_since, streak_rows, only_stopped
       FROM streak s JOIN newest f USING (vehicle_id)""",
    "pos", **_STREAK,
)
SQL["stuck_vehicles"] = sql(
    f"""SELECT f.vehicle_id, f.vehicle_label, f.route_id, coalesce(r.route_short_name, f.route_id) AS route_short_name,
               f.stop_id, st.stop_name, stuck_since,
               {r1("date_diff('microsecond', stuck_since, TIMESTAMP '2024-01-31') / 1000000.0::DOUBLE / 60")} AS minutes_stuck
        FROM streak s JOIN newest f USING (vehicle_id) LEFT JOIN ev_routes r ON r.route_id = f.route_id
        LEFT JOIN nstops st ON st.stop_id = f.stop_id
        WHERE date_diff('microsecond', stuck_since, TIMESTAMP '2024-01-31') >= 86400000000 AND NOT only_stopped
          AND NOT EXISTS (SELECT 1 FROM tp t JOIN (SELECT trip_id, min(stop_sequence) AS a, max(stop_sequence) AS b
                                                   FROM tp GROUP BY 1) e ON e.trip_id = t.trip_id
                          JOIN nstops ts ON ts.stop_id = t.stop_id
                          WHERE t.trip_id = f.trip_id AND t.stop_sequence IN (e.a, e.b)
                            AND (t.stop_id = f.stop_id
                              OR {haversine('f.lat', 'f.lon', 'ts.stop_lat', 'ts.stop_lon')} < 5000))""",
    "pos", "tp", "ev_routes", "nstops", **_STREAK,
)

LEGS = """SELECT vehicle_label, trip_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS observation_count
          FROM pos GROUP BY 1, 2 HAVING count(*) >= 10"""


def mean_half_even(total: str, n: str) -> str:
    """The decimal mean to one place, ties to the even tenth."""
    rest = f"(((10 * {total}) % {n} + {n}) % {n})"
    low = f"((10 * {total} - {rest}) // {n})"
    return f"""CASE WHEN {n} > 0 THEN CAST({low} + CASE WHEN 2 * {rest} > {n} OR (2 * {rest} = {n} AND {low} % 2 <> 0)
               THEN 1 ELSE 0 END AS DOUBLE) / 10 END"""


def arrivals(source: str) -> str:
    return f"""SELECT trip_id, count(*) AS stop_arrival_count, max(stop_sequence) AS max_stop_sequence,
        {mean_half_even('sum(delay)', 'count(delay)')} AS avg_delay_seconds,
        {r1('sum(CASE WHEN abs(delay) <= 300 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100')} AS on_time_pct
        FROM {source} GROUP BY 1"""


_TRIPS = dict(
    legs=LEGS,
    lastrow="SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_label, trip_id ORDER BY ts DESC, id DESC) = 1",
    ar=arrivals("evd"),
    w="""SELECT legs.*, x.route_id, x.vehicle_id, x.lat AS latitude, x.lon AS longitude, x.occ AS occupancy_status,
           ar.stop_arrival_count, ar.max_stop_sequence, ar.avg_delay_seconds, ar.on_time_pct
         FROM legs JOIN lastrow x ON x.vehicle_label = legs.vehicle_label AND x.trip_id = legs.trip_id
         JOIN ar ON ar.trip_id = legs.trip_id WHERE stop_arrival_count > 1""",
    ends="""SELECT trip_id, max(stop_sequence) AS max_sequence, arg_min(stop_id, stop_sequence) AS a,
              arg_max(stop_id, stop_sequence) AS b FROM tp GROUP BY 1""",
    d=f"""SELECT w.vehicle_label, w.vehicle_id, w.trip_id, w.route_id, r.route_short_name, r.route_color, r.route_type,
            CASE WHEN r.route_type IN ('0', '1', '2') THEN 'rail' WHEN r.route_type = '3' THEN 'bus' ELSE 'other' END AS mode,
            start_time, end_time,
            {r1("date_diff('microsecond', start_time, end_time) / 1000000.0::DOUBLE / 60")} AS duration_minutes,
            s1.stop_name AS start_stop_name, s2.stop_name AS end_stop_name,
            e.max_sequence IS NULL OR coalesce(max_stop_sequence >= e.max_sequence, FALSE) AS reached_terminus,
            end_time >= TIMESTAMP '2024-01-30 19:58:30' AS in_progress,
            CASE WHEN end_time >= TIMESTAMP '2024-01-30 19:58:30' THEN 'in_progress'
                 WHEN e.max_sequence IS NULL OR coalesce(max_stop_sequence >= e.max_sequence, FALSE) THEN 'complete'
                 ELSE 'incomplete' END AS trip_status,
            latitude AS last_latitude, longitude AS last_longitude, occupancy_status AS last_occupancy_status,
            avg_delay_seconds, on_time_pct, observation_count, stop_arrival_count
          FROM w LEFT JOIN ev_routes r ON r.route_id = w.route_id LEFT JOIN ends e ON e.trip_id = w.trip_id
          LEFT JOIN nstops s1 ON s1.stop_id = e.a LEFT JOIN nstops s2 ON s2.stop_id = e.b""",
)
_TRIP_TABLES = ("pos", "evd", "tp", "ev_routes", "nstops")
SQL["trip_window_agg"] = sql("SELECT * FROM w", *_TRIP_TABLES, **{k: _TRIPS[k] for k in ("legs", "lastrow", "ar", "w")})
SQL["trip_delay_stats"] = sql(arrivals("arr"), "arr")
SQL["trip_explorer"] = sql("SELECT * FROM d", *_TRIP_TABLES, **_TRIPS)
SQL["trip_explorer_page"] = sql(
    """SELECT p.trip_id, vehicle_label, start_time, trip_status, last_delay_seconds
       FROM (SELECT * FROM d ORDER BY start_time, route_id NULLS LAST, vehicle_label, trip_id LIMIT 15 OFFSET 15) p
       LEFT JOIN kd ON kd.trip_id = p.trip_id""",
    *_TRIP_TABLES, "upd", **_TRIPS,
    pg="SELECT * FROM d ORDER BY start_time, route_id NULLS LAST, vehicle_label, trip_id LIMIT 15 OFFSET 15",
    kd="""SELECT trip_id, arrival_delay AS last_delay_seconds FROM upd
          WHERE arrival_delay IS NOT NULL AND route_id IN (SELECT route_id FROM pg)
            AND ts >= (SELECT min(start_time) FROM pg) - INTERVAL 5 MINUTE
            AND ts <= (SELECT max(end_time) FROM pg) + INTERVAL 5 MINUTE
          QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC, id DESC) = 1""",
)
SQL["trip_explorer_filtered"] = sql(
    """SELECT trip_id, trip_status, avg_delay_seconds, on_time_pct, duration_minutes FROM d
       WHERE trip_status IN ('complete', 'incomplete')
         AND coalesce(last_occupancy_status, 'UNKNOWN') IN ('UNKNOWN', 'FULL', 'EMPTY')
         AND avg_delay_seconds BETWEEN -200 AND 300 AND on_time_pct >= 20 AND duration_minutes >= 600""",
    *_TRIP_TABLES, **_TRIPS,
)
SQL["trip_facets"] = sql(
    """SELECT facet, value, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT 'status' AS facet, trip_status AS value, 1 AS n FROM d UNION ALL SELECT 'mode', mode, 1 FROM d
         UNION ALL SELECT 'occupancy', coalesce(last_occupancy_status, 'UNKNOWN'), 1 FROM d
         UNION ALL SELECT 'route', route_id, 1 FROM d UNION ALL SELECT 'vehicle', vehicle_label, 1 FROM d
         UNION ALL SELECT * FROM (VALUES ('status', 'in_progress', 0), ('status', 'complete', 0),
           ('status', 'incomplete', 0), ('mode', 'rail', 0), ('mode', 'bus', 0), ('mode', 'other', 0)))
       GROUP BY 1, 2""",
    *_TRIP_TABLES, **_TRIPS,
)
SQL["trip_facet_totals"] = sql(
    "SELECT count(*) AS trip_count, coalesce(max(duration_minutes), 0.0) AS max_duration_minutes FROM d",
    *_TRIP_TABLES, **_TRIPS,
)
SQL["vehicle_routes"] = sql(
    """SELECT vehicle_label, route_short_name, min(start_time) AS first_seen, count(*) AS trip_count
       FROM d GROUP BY 1, 2""",
    *_TRIP_TABLES, **_TRIPS,
)
SQL["history_page"] = sql(
    """SELECT p.id, p.trip_id, r.route_short_name, p.ts AS "timestamp", kd.last_delay_seconds AS delay_seconds
       FROM pg p LEFT JOIN ev_routes r ON r.route_id = p.route_id LEFT JOIN kd ON kd.trip_id = p.trip_id""",
    "pos", "upd", "ev_routes",
    pg="SELECT * FROM pos ORDER BY ts DESC, id DESC LIMIT 200",
    kd="""SELECT trip_id, arrival_delay AS last_delay_seconds FROM upd
          WHERE arrival_delay IS NOT NULL AND route_id IN (SELECT route_id FROM pg)
            AND ts >= (SELECT min(ts) FROM pg) - INTERVAL 3 HOUR AND ts <= (SELECT max(ts) FROM pg) + INTERVAL 3 HOUR
          QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY ts DESC, id DESC) = 1""",
)
SQL["bounded_count"] = "SELECT count(*) AS total FROM (SELECT 1 FROM events LIMIT 50000)"

_TARGETS = 'SELECT id, stop_id AS vehicle_id, ts + INTERVAL 3 HOUR AS "at" FROM evd'
SQL["nearest_status_at_event"] = sql(
    """SELECT t.id, t.vehicle_id, t."at", p.occ AS occupancy_status FROM t JOIN pos p ON p.vehicle_id = t.vehicle_id
       WHERE p.occ IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY abs(date_diff('microsecond', p.ts, t."at")), p.ts, p.id) = 1""",
    "pos", "evd", t=_TARGETS,
)
_DLON = "radians(b.lon - a.lon)"
_BEARING = f"""CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN a.bearing ELSE
    fmod(degrees(atan2(sin({_DLON}) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat))
      - sin(radians(a.lat)) * cos(radians(b.lat)) * cos({_DLON}))) + 360.0, 360.0) END"""
_SHARE = """(date_diff('microsecond', a.ts, "at") / CAST(date_diff('microsecond', a.ts, b.ts) AS DOUBLE))"""
SQL["interpolated_position"] = sql(
    f"""SELECT m.id, m.vehicle_id, "at",
          round(CASE WHEN a.id IS NULL THEN b.lat WHEN b.id IS NULL THEN a.lat
                ELSE a.lat + (b.lat - a.lat) * {_SHARE} END, 6) AS at_lat,
          round(CASE WHEN a.id IS NULL THEN b.lon WHEN b.id IS NULL THEN a.lon
                ELSE a.lon + (b.lon - a.lon) * {_SHARE} END, 6) AS at_lon,
          round(CASE WHEN a.id IS NULL THEN b.bearing WHEN b.id IS NULL THEN a.bearing ELSE {_BEARING} END, 6) AS at_bearing
        FROM m LEFT JOIN pos a ON a.id = m.before_id LEFT JOIN pos b ON b.id = m.after_id""",
    "pos", "evd", t=_TARGETS,
    m="""SELECT t.id, t.vehicle_id, t."at", arg_max(p.id, (p.ts, p.id)) FILTER (WHERE p.ts < t."at") AS before_id,
           arg_min(p.id, (p.ts, p.id)) FILTER (WHERE p.ts >= t."at") AS after_id
         FROM t JOIN pos p ON p.vehicle_id = t.vehicle_id GROUP BY 1, 2, 3""",
)

_LINE = dict(
    seen="""SELECT trip_id, stop_sequence, arg_max(ts, (ts, id)) AS actual_time, arg_max(delay, (ts, id)) AS delay_seconds
            FROM evd GROUP BY 1, 2""",
    ob="""SELECT *, actual_time - to_seconds(delay_seconds) AS scheduled_time,
            'NATION_' || CAST(stop_sequence AS VARCHAR) AS stop_id FROM seen""",
    anchor0="""SELECT tp.trip_id, arg_min(scheduled_time - to_seconds(arrival_secs), tp.stop_sequence) AS exact
               FROM tp JOIN ob ON ob.trip_id = tp.trip_id AND ob.stop_sequence = tp.stop_sequence GROUP BY 1""",
    track="SELECT trip_id, min(ts) AS t0 FROM pos GROUP BY 1",
    guess=f"""SELECT trip_id, mid AS guess FROM (
                SELECT trip_id, t0, o, {utc(f"CAST(CAST({local('t0')} AS DATE) + o AS TIMESTAMP)")} AS mid
                FROM track, (VALUES (0), (-1), (1)) v(o))
              QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY abs(date_diff('microsecond', mid, t0)),
                                         CASE o WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) = 1""",
    occ1="""SELECT ob.trip_id, ob.stop_sequence, p.occ FROM ob JOIN pos p ON p.trip_id = ob.trip_id WHERE p.occ IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY ob.trip_id, ob.stop_sequence
              ORDER BY abs(date_diff('microsecond', p.ts, ob.actual_time)), p.ts, p.id) = 1""",
    line="""SELECT coalesce(tp.trip_id, ob.trip_id) AS trip_id, coalesce(tp.stop_sequence, ob.stop_sequence) AS stop_sequence,
              CASE WHEN tp.trip_id IS NULL THEN ob.stop_id ELSE tp.stop_id END AS stop_id,
              CASE WHEN tp.trip_id IS NULL THEN ns.stop_name ELSE 'Stop ' || tp.stop_id END AS stop_name,
              coalesce(ob.scheduled_time, coalesce(exact, guess) + to_seconds(tp.arrival_secs)) AS scheduled_time,
              ob.trip_id IS NOT NULL AS observed,
              CASE WHEN ob.trip_id IS NOT NULL THEN CASE WHEN ob.stop_sequence = 1 THEN 'departure' ELSE 'arrival' END END AS event_type,
              ob.actual_time, ob.delay_seconds, occ1.occ AS occupancy_status
            FROM tp FULL OUTER JOIN ob ON ob.trip_id = tp.trip_id AND ob.stop_sequence = tp.stop_sequence
            LEFT JOIN anchor0 ON anchor0.trip_id = coalesce(tp.trip_id, ob.trip_id)
            LEFT JOIN guess ON guess.trip_id = coalesce(tp.trip_id, ob.trip_id)
            LEFT JOIN nstops ns ON ns.stop_id = ob.stop_id
            LEFT JOIN occ1 ON occ1.trip_id = ob.trip_id AND occ1.stop_sequence = ob.stop_sequence""",
)
SQL["trip_timeline"] = sql("SELECT * FROM line", "pos", "evd", "tp", "nstops", **_LINE)
SQL["trip_timeline_totals"] = sql(
    f"""SELECT trip_id, count(*) AS scheduled_stop_count, count(*) FILTER (WHERE observed) AS observed_stop_count,
          avg(delay_seconds) AS avg_delay_seconds,
          CASE WHEN count(delay_seconds) > 0 THEN
            {r1('count(*) FILTER (WHERE abs(delay_seconds) <= 300) / CAST(count(delay_seconds) AS DOUBLE) * 100')} END AS on_time_pct
        FROM line GROUP BY 1""",
    "pos", "evd", "tp", "nstops", **_LINE,
)


def schedule_at(day: str, secs: str) -> str:
    """Of the two readings of an hour that occurs twice the earlier one is meant."""
    wall = f"(CAST({day} AS TIMESTAMP) + to_seconds({secs}))"
    late, early = utc(wall), f"({utc(wall)} - INTERVAL 1 HOUR)"
    return f"CASE WHEN {local(early)} = {wall} THEN {early} ELSE {late} END"


SQL["service_date_pick"] = sql(
    """SELECT id, CASE WHEN abs(d0) <= abs(d1) THEN day ELSE day - 1 END AS service_date,
              CASE WHEN abs(d0) <= abs(d1) THEN s0 ELSE s1 END AS scheduled_time,
              CAST(round_even(CASE WHEN abs(d0) <= abs(d1) THEN d0 ELSE d1 END / 1000000.0::DOUBLE, 0) AS BIGINT) AS delay_seconds
       FROM (SELECT *, date_diff('microsecond', s0, ts) AS d0, date_diff('microsecond', s1, ts) AS d1 FROM x)""",
    "evd",
    x0=f"SELECT id, ts, CAST({local('ts')} AS DATE) AS day, (id * 7919) % 108000 AS secs FROM evd",
    x=f"SELECT *, {schedule_at('day', 'secs')} AS s0, {schedule_at('(day - 1)', 'secs')} AS s1 FROM x0",
)
SQL["scheduled_instant"] = f"""SELECT o_orderkey, {schedule_at('CAST(o_orderdate AS DATE)', '((o_orderkey * 977) % 108000)')} AS scheduled
    FROM orders"""

_LOCATED = "SELECT lines.*, stop_lat, stop_lon FROM lines JOIN pstops USING (stop_id)"
_HOPS = f"""SELECT *, coalesce({haversine('plat', 'plon', 'stop_lat', 'stop_lon')}, 0) AS hop,
              {haversine('stop_lat', 'stop_lon', 'nlat', 'nlon')} AS hop_next, plat IS NULL OR nlat IS NULL AS is_end
            FROM (SELECT *, lag(stop_lat) OVER w AS plat, lag(stop_lon) OVER w AS plon,
                         lead(stop_lat) OVER w AS nlat, lead(stop_lon) OVER w AS nlon
                  FROM located WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))"""
SQL["cumulative_distance"] = sql(
    """SELECT trip_id, stop_sequence, stop_id,
              round(sum(hop) OVER (PARTITION BY trip_id ORDER BY stop_sequence), 3) AS dist_m FROM hops""",
    "lines", "pstops", located=_LOCATED, hops=_HOPS,
)
SQL["neighbour_gap_filter"] = sql(
    "SELECT trip_id, stop_sequence, stop_id FROM hops WHERE is_end OR least(hop, hop_next) >= 20000",
    "lines", "pstops", located=_LOCATED, hops=_HOPS,
)
_ENDS = """SELECT trip_id, min(stop_sequence) AS min_sequence, max(stop_sequence) AS max_sequence,
             arg_min(stop_id, stop_sequence) AS first_stop_id, arg_max(stop_id, stop_sequence) AS last_stop_id
           FROM lines GROUP BY 1"""
SQL["trip_endpoints"] = sql(_ENDS, "lines")
SQL["trip_ends_timepoints"] = sql(
    """SELECT trip_id, arg_min(stop_id, stop_sequence) AS origin_stop, arg_min(arrival_secs, stop_sequence) AS origin_secs,
              arg_max(stop_id, stop_sequence) AS terminus_stop, arg_max(arrival_secs, stop_sequence) AS terminus_secs
       FROM tp GROUP BY 1""",
    "tp",
)
SQL["route_terminals"] = sql(
    """SELECT route_id, first_stop_id AS stop_id FROM e JOIN otrips USING (trip_id)
       UNION SELECT route_id, last_stop_id FROM e JOIN otrips USING (trip_id)""",
    "lines", "otrips", e=_ENDS,
)
_ROUTE_STOPS = """SELECT route_id, stop_id, min(stop_sequence) AS stop_sequence FROM lines JOIN otrips USING (trip_id) GROUP BY 1, 2"""
SQL["route_stops"] = sql(
    "SELECT stop_id, route_id, stop_sequence, stop_name FROM rs JOIN pstops USING (stop_id)",
    "lines", "otrips", "pstops", rs=_ROUTE_STOPS,
)
SQL["stop_routes"] = sql(
    """SELECT route_id, stop_id, coalesce(route_short_name, '') AS short_name, '' AS long_name, '888888' AS color,
              coalesce(route_type, '3') AS route_type
       FROM rs JOIN pstops USING (stop_id) LEFT JOIN sup_routes USING (route_id)""",
    "lines", "otrips", "pstops", "sup_routes", rs=_ROUTE_STOPS,
)
SQL["stop_slots"] = sql(
    """SELECT DISTINCT route_id, stop_id, CAST(stop_sequence * 600 AS INTEGER) AS arrival_secs, trip_id
       FROM lines JOIN otrips USING (trip_id)""",
    "lines", "otrips",
)
SQL["direction_headsign"] = sql(
    """SELECT route_id, direction_id, trips, headsign FROM (
         SELECT route_id, direction_id, trip_headsign AS headsign, count(*) AS n, min(trip_id) AS first_seen,
                CAST(sum(count(*)) OVER (PARTITION BY route_id, direction_id) AS BIGINT) AS trips
         FROM otrips GROUP BY 1, 2, 3)
       QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n DESC, first_seen) = 1""",
    "otrips",
)
SQL["stop_search"] = sql(
    """SELECT stop_id, stop_name, is_rail FROM pstops WHERE contains(lower(stop_name), 'ol')
       ORDER BY CASE WHEN starts_with(lower(stop_name), 'ol') THEN 0 ELSE 1 END, CASE WHEN is_rail THEN 0 ELSE 1 END,
                lower(stop_name), stop_id LIMIT 40""",
    "pstops",
)
SQL["route_list"] = sql(
    """SELECT route_id, route_short_name AS short_name, route_long_name AS long_name, route_type,
              CASE route_type WHEN '0' THEN 'light_rail' WHEN '1' THEN 'heavy_rail' WHEN '2' THEN 'commuter_rail'
                WHEN '3' THEN 'bus' ELSE 'other' END AS type_name, route_color AS color, 'A' AS agency_id
       FROM ev_routes""",
    "ev_routes",
)
SQL["delay_bands"] = sql(
    """SELECT CASE WHEN delay < -300 THEN 'early' WHEN delay <= 300 THEN 'on_time' WHEN delay <= 900 THEN 'late'
                   ELSE 'very_late' END AS band, count(*) AS n FROM evd GROUP BY 1""",
    "evd",
)


# Detection, told once more as plain windows and joins over whole trips. The limits
# are those of ``catalog.DETECTION``.


def nearest_day(ts: str, secs: str, prefix: str) -> str:
    """Columns <prefix>_date, <prefix>_at: today's or yesterday's schedule, the nearer one."""
    day = f"CAST({local(ts)} AS DATE)"
    s0, s1 = schedule_at(day, secs), schedule_at(f"({day} - 1)", secs)
    today = f"abs(date_diff('microsecond', {s0}, {ts})) <= abs(date_diff('microsecond', {s1}, {ts}))"
    return (
        f"CASE WHEN {today} THEN {day} ELSE {day} - 1 END AS {prefix}_date,"
        f" CASE WHEN {today} THEN {s0} ELSE {s1} END AS {prefix}_at"
    )


def second(x: str) -> str:
    return f"date_trunc('second', {x} + INTERVAL 500 MILLISECOND)"


TWO_DAYS = "172800000000"
_RAIL = "(r.route_type IN ('0', '1', '2'))"
_DETECT = dict(
    tpd=f"""SELECT *, sum(hop) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS dist FROM (
              SELECT *, coalesce({haversine('lag(stop_lat) OVER w', 'lag(stop_lon) OVER w', 'stop_lat', 'stop_lon')}, 0) AS hop
              FROM tp WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))""",
    legs="""SELECT trip_id, stop_sequence AS a_no, stop_lat AS alat, stop_lon AS alon, dist AS adist,
              lead(stop_lat) OVER w AS blat, lead(stop_lon) OVER w AS blon, lead(dist) OVER w AS bdist
            FROM tpd WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence) QUALIFY blat IS NOT NULL""",
    shares="""SELECT p.id, l.*, lat, lon, greatest(0, least(1, ((lon - alon) * (blon - alon) + (lat - alat) * (blat - alat))
                / ((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)))) AS t
              FROM pos p JOIN legs l ON l.trip_id = p.trip_id""",
    pr=f"""SELECT id, adist + t * (bdist - adist) AS proj,
             {haversine('lat', 'lon', '(alat + t * (blat - alat))', '(alon + t * (blon - alon))')} AS off_route
           FROM shares QUALIFY row_number() OVER (PARTITION BY id ORDER BY
             {haversine('lat', 'lon', '(alat + t * (blat - alat))', '(alon + t * (blon - alon))')}, a_no) = 1""",
    fx=f"""SELECT p.*, proj, off_route, coalesce({_RAIL}, FALSE) AS rail,
             CASE WHEN {_RAIL} THEN 3000 ELSE 2000 END AS radius, o.stop_lat AS olat, o.stop_lon AS olon,
             o.arrival_secs AS osecs, z.stop_lat AS zlat, z.stop_lon AS zlon, z.arrival_secs AS zsecs,
             z.dist AS zdist, y.dist AS ydist
           FROM pos p JOIN pr USING (id) LEFT JOIN ev_routes r ON r.route_id = p.route_id
           JOIN tpd o ON o.trip_id = p.trip_id AND o.stop_sequence = 1
           JOIN tpd z ON z.trip_id = p.trip_id AND z.stop_sequence = 8
           JOIN tpd y ON y.trip_id = p.trip_id AND y.stop_sequence = 7""",
    fixes=f"""SELECT *, {haversine('lat', 'lon', 'olat', 'olon')} AS od, {haversine('lat', 'lon', 'zlat', 'zlon')} AS zd,
                {nearest_day('ts', 'osecs', 'o')}, {nearest_day('ts', 'zsecs', 'z')} FROM fx""",
    near="""SELECT f.id, t.stop_sequence AS no, abs(f.proj - t.dist) AS gap FROM fixes f
            JOIN tpd t ON t.trip_id = f.trip_id AND t.stop_sequence <> 1
            QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY abs(f.proj - t.dist), t.stop_sequence) = 1""",
    geo="""SELECT trip_id, route_id, no AS seq, ts AS actual, lat, lon, ts AS emit, 0 AS phase, f.id AS row_id,
             2 AS rank, 'geofence' AS method
           FROM fixes f JOIN near USING (id) WHERE off_route <= radius AND gap <= radius""",
    hist="""SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
              lag(proj) OVER w AS pproj, lag(off_route) OVER w AS poff_route
            FROM fixes WINDOW w AS (PARTITION BY trip_id ORDER BY ts, id)""",
    seg="""SELECT h.trip_id, h.route_id, t.stop_sequence AS seq,
             pts + to_microseconds(CAST(round(date_diff('microsecond', pts, ts) * ((t.dist - pproj) / (proj - pproj))) AS BIGINT)) AS actual,
             plat + (lat - plat) * ((t.dist - pproj) / (proj - pproj)) AS lat,
             plon + (lon - plon) * ((t.dist - pproj) / (proj - pproj)) AS lon,
             ts AS emit, 0 AS phase, h.id AS row_id, 1 AS rank, 'segment' AS method
           FROM hist h JOIN tpd t ON t.trip_id = h.trip_id AND t.stop_sequence <> 1 AND t.dist > pproj AND t.dist <= proj
           WHERE ts > pts AND date_diff('microsecond', pts, ts) <= 86400000000
             AND poff_route <= radius * 3 AND off_route <= radius * 3""",
    o1="""SELECT *, od <= 4000 AS inside,
            sum(CASE WHEN od <= 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id, o_date ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS epoch
          FROM fixes""",
    o2="SELECT * FROM o1 WHERE inside",
    o3=f"""SELECT i.trip_id, i.o_date, i.epoch, any_value(i.ts) AS t_in, any_value(i.od) AS d_in,
             any_value(i.lat) AS lat, any_value(i.lon) AS lon, any_value(i.route_id) AS route_id,
             arg_min(x.ts, (x.ts, x.id)) AS t_out, arg_min(x.od, (x.ts, x.id)) AS d_out,
             arg_min(x.ts, (x.ts, x.id)) FILTER (WHERE x.proj >= 2000) AS t_ok,
             arg_min(x.id, (x.ts, x.id)) FILTER (WHERE x.proj >= 2000) AS id_ok,
             count(x.id) FILTER (WHERE x.proj < 2000) AS fails
           FROM o2 i LEFT JOIN o1 x ON x.trip_id = i.trip_id AND x.o_date = i.o_date AND x.epoch = i.epoch AND NOT x.inside
             AND x.current_stop_sequence > 1 AND date_diff('microsecond', i.ts, x.ts) <= {TWO_DAYS}
           GROUP BY 1, 2, 3""",
    o4="SELECT *, lead(t_in) OVER (PARTITION BY trip_id, o_date ORDER BY epoch) AS back FROM o3",
    org=f"""SELECT trip_id, route_id, 1 AS seq,
              CASE WHEN t_ok IS NULL THEN t_in WHEN d_out <= d_in THEN t_out ELSE t_in + to_microseconds(CAST(round(
                date_diff('microsecond', t_in, t_out) * greatest(0, least(1, (4000 - d_in) / (d_out - d_in)))) AS BIGINT)) END AS actual,
              lat, lon, CASE WHEN t_ok IS NULL THEN t_in + INTERVAL 2 DAY ELSE t_ok END AS emit,
              CASE WHEN t_ok IS NULL THEN 1 ELSE 0 END AS phase, coalesce(id_ok, 0) AS row_id, 0 AS rank,
              'origin_departure' AS method
            FROM o4 WHERE t_ok IS NOT NULL
              OR (fails = 0 AND coalesce(date_diff('microsecond', t_in, back) > {TWO_DAYS}, TRUE))
            QUALIFY row_number() OVER (PARTITION BY trip_id, o_date ORDER BY epoch) = 1""",
    z1=f"""SELECT *, zd <= radius AS arrived,
             zd > radius AND zd <= least(CASE WHEN rail THEN 6000 ELSE 5000 END, (zdist - ydist) / 2) AND proj >= ydist AS cand,
             coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > {TWO_DAYS}, FALSE) AS broken
           FROM fixes WINDOW w AS (PARTITION BY trip_id, z_date ORDER BY ts, id)""",
    z2="""SELECT *, sum(broken::INT) OVER (PARTITION BY trip_id, z_date ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS spell FROM z1""",
    z3="SELECT trip_id, z_date, min(spell) AS hit FROM z2 WHERE cand GROUP BY 1, 2",
    z4="""SELECT z2.*, max(ts) OVER (PARTITION BY z2.trip_id, z2.z_date) AS quiet FROM z2
          JOIN z3 ON z3.trip_id = z2.trip_id AND z3.z_date = z2.z_date AND spell = hit
          WHERE NOT EXISTS (SELECT 1 FROM z2 a WHERE a.trip_id = z2.trip_id AND a.z_date = z2.z_date AND a.spell <= hit AND a.arrived)""",
    trm="""SELECT trip_id, route_id, 8 AS seq, ts AS actual, lat, lon, quiet + INTERVAL 2 DAY AS emit, 1 AS phase, 0 AS row_id,
             3 AS rank, 'terminus_fallback' AS method
           FROM z4 WHERE cand QUALIFY row_number() OVER (PARTITION BY trip_id, z_date ORDER BY zd, ts, id) = 1""",
    allc="SELECT * FROM geo UNION ALL SELECT * FROM seg UNION ALL SELECT * FROM org UNION ALL SELECT * FROM trm",
    ev0=f"""SELECT c.*, t.stop_id, {nearest_day('actual', 't.arrival_secs', 's')} FROM allc c
            JOIN tpd t ON t.trip_id = c.trip_id AND t.stop_sequence = c.seq""",
    ev="""SELECT *, date_diff('microsecond', s_at, actual) / 1000000.0::DOUBLE AS delay FROM ev0
          WHERE abs(date_diff('microsecond', s_at, actual)) <= 21600000000""",
    slots="""SELECT DISTINCT t.route_id, tp.stop_id, tp.arrival_secs, tp.trip_id FROM tp
             JOIN (SELECT trip_id, min(route_id) AS route_id FROM pos GROUP BY 1) t ON t.trip_id = tp.trip_id""",
    es=f"""SELECT *, row_number() OVER () AS n,
             date_diff('microsecond', CAST(s_date AS TIMESTAMP), {local('actual')}) / 1000000.0::DOUBLE AS wall FROM ev""",
    alias="""SELECT es.n, s.trip_id AS other, es.actual, es.emit FROM es JOIN slots s ON s.route_id = es.route_id AND s.stop_id = es.stop_id
             AND s.trip_id <> es.trip_id AND abs(s.arrival_secs - es.wall) <= 3600 WHERE abs(es.delay) >= 600""",
    bad="""SELECT n FROM alias GROUP BY 1 EXCEPT
           SELECT a.n FROM alias a JOIN pos p ON p.trip_id = a.other AND p.ts >= a.actual - INTERVAL 1 DAY
             AND p.ts <= least(a.emit, a.actual + INTERVAL 1 DAY)""",
    good="SELECT * FROM es WHERE n NOT IN (SELECT n FROM bad)",
    firsts="""SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY trip_id, seq, s_date
                ORDER BY emit, phase, row_id, rank, seq) = 1""",
    kept="""SELECT *, row_number() OVER (PARTITION BY trip_id, s_date ORDER BY emit, phase, row_id, rank, seq) AS o FROM firsts""",
    fin="""SELECT * FROM (SELECT *, min(o) FILTER (WHERE seq = 8) OVER (PARTITION BY trip_id, s_date) AS last_o FROM kept)
           WHERE last_o IS NULL OR o <= last_o""",
)
_DETECT_TABLES = ("pos", "tp", "ev_routes")


def detect_sql(body: str, last: str) -> str:
    names = list(_DETECT)
    return sql(body, *_DETECT_TABLES, **{k: _DETECT[k] for k in names[: names.index(last) + 1]})


def _rule(rule: str) -> str:
    return detect_sql(
        f"""SELECT trip_id, route_id, stop_id, CAST(seq AS INTEGER) AS stop_sequence, s_date AS service_date,
              s_at AS scheduled_time, {second('actual')} AS actual_time, {second('emit')} AS emit_time,
              round(lat, 6) AS actual_lat, round(lon, 6) AS actual_lon FROM ev WHERE method = '{rule}'""",
        "ev",
    )


def _keys(table: str) -> str:
    return detect_sql(
        f"""SELECT trip_id, CAST(seq AS INTEGER) AS stop_sequence, s_date AS service_date,
              method AS detection_method, {second('actual')} AS actual_time FROM {table}""",
        table,
    )


SQL["route_projection"] = detect_sql(
    """SELECT f.id, round(off_route, 2) AS off_route, round(proj, 2) AS proj,
         (SELECT CAST(count(*) AS INTEGER) FROM tpd t WHERE t.trip_id = f.trip_id AND t.dist <= f.proj) AS passed,
         CASE WHEN off_route <= radius AND gap <= radius THEN no END AS geofence_no
       FROM fixes f JOIN near USING (id)""",
    "near",
)
SQL["geofence_arrivals"] = _rule("geofence")
SQL["segment_arrivals"] = _rule("segment")
SQL["origin_departure"] = _rule("origin_departure")
SQL["terminus_fallback"] = _rule("terminus_fallback")
SQL["alias_guard"] = _keys("good")
SQL["first_event_per_key"] = _keys("firsts")
SQL["closed_runs"] = _keys("fin")
SQL["trip_activity_bins"] = sql(
    """SELECT trip_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS bin, min(ts) AS first_seen,
              max(ts) AS last_seen FROM pos GROUP BY 1, 2""",
    "pos",
)
SQL["detect_arrivals"] = detect_sql(
    f"""SELECT trip_id, route_id, stop_id, CAST(seq AS INTEGER) AS stop_sequence, s_at AS scheduled_time,
          {second('actual')} AS actual_time, CAST(round_even(delay, 0) AS INTEGER) AS delay_seconds,
          s_date AS service_date, method AS detection_method, round(lat, 6) AS actual_lat, round(lon, 6) AS actual_lon
        FROM fin""",
    "fin",
)
SQL["detected_punctuality"] = sql(
    f"""SELECT route_id, on_time, late, early, observations, delay_sum,
               CASE WHEN overall THEN {pct('on_time', 'observations')}
                    ELSE {pct('on_time', '(on_time + late + early)')} END AS on_time_pct,
               {avg('delay_sum', 'observations')} AS avg_delay_seconds, overall
        FROM (SELECT route_id, FALSE AS overall, {FOLD} FROM h WHERE {EV_RANGE} GROUP BY route_id
              UNION ALL SELECT NULL, TRUE, {FOLD} FROM h WHERE {EV_RANGE}) x""",
    *_DETECT_TABLES, **_DETECT,
    det="SELECT route_id, actual AS ts, CAST(round_even(delay, 0) AS INTEGER) AS delay FROM fin",
    h=hourly("det"),
)


SQL["nested_feed_flatten"] = sql(
    f"""SELECT trip_id, route_id, CASE WHEN k % 7 <> 0 THEN vehicle_id END AS vehicle_id,
               CASE WHEN k % 7 <> 0 THEN vehicle_label END AS vehicle_label,
               CASE WHEN k % 13 <> 0 THEN lat END AS latitude, CASE WHEN k % 13 <> 0 THEN lon END AS longitude,
               CASE WHEN k % 13 <> 0 THEN bearing END AS bearing, current_stop_sequence, status AS current_status,
               stop_id, coalesce(occ, 'UNKNOWN') AS occupancy_status, date_trunc('hour', ts) AS "timestamp"
        FROM pos JOIN (SELECT event_id, {K} AS k FROM events) e ON e.event_id = pos.id
        WHERE k % 10 <> 3 AND k % 11 <> 0""",
    "pos",
)
SQL["trip_update_flatten"] = sql(
    """SELECT trip_id, route_id, CASE WHEN n % 2 = 1 THEN 'S' END AS stop_id, nullif(n, 0) AS stop_sequence,
              arrival_delay + 30 * i AS arrival_delay, CASE WHEN n > 3 THEN 0 END AS departure_delay,
              CAST(NULL AS BIGINT) AS arrival_time, CASE WHEN n > 3 THEN CAST(n AS BIGINT) END AS departure_time,
              CASE WHEN s > 5 THEN ts - INTERVAL 60 SECOND ELSE ts END AS "timestamp"
       FROM (SELECT *, coalesce(stop_sequence, 0) AS s, coalesce(stop_sequence, 0) + i AS n
             FROM upd, (VALUES (0), (1)) v(i))""",
    "upd",
)
SQL["route_occupancy_summary"] = sql(
    """SELECT CASE route_type WHEN '0' THEN 'light_rail' WHEN '1' THEN 'heavy_rail' WHEN '2' THEN 'commuter_rail'
                WHEN '3' THEN 'bus' ELSE 'other' END AS mode, route_id, route_short_name,
              CAST(sum(count(*)) OVER (PARTITION BY route_id) AS BIGINT) AS total_vehicles,
              coalesce(occ, 'UNKNOWN') AS status, count(*) AS n
       FROM pos LEFT JOIN ev_routes USING (route_id) GROUP BY 1, 2, 3, coalesce(occ, 'UNKNOWN')""",
    "pos", "ev_routes",
)
SQL["export_page"] = sql(
    'SELECT vehicle_id, trip_id, route_id, stop_id, ts AS "timestamp" FROM pos ORDER BY ts, id LIMIT 5000', "pos"
)
SQL["gtfs_time_parse"] = """
    SELECT o_orderkey, s AS seconds, printf('%02d:%02d', (s // 3600) % 24, (s % 3600) // 60) AS clock
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0 THEN
            CAST((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 7 AS INTEGER) END AS s FROM orders)"""
SQL["month_parse"] = """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 3000000000
                ELSE o_orderkey * 37 END::BIGINT AS boardings FROM orders"""
SQL["games_board"] = sql(
    """SELECT event_id, team_key, state, start, "end", team_score, opponent_score,
              CASE WHEN state = 'post' THEN CASE WHEN team_score > opponent_score THEN 'win'
                WHEN team_score < opponent_score THEN 'loss' ELSE 'draw' END END AS result
       FROM (SELECT g.*, CASE WHEN state = 'post' THEN CASE WHEN seen <= poll THEN seen
                           ELSE start + to_minutes(typical) END END AS "end"
             FROM g LEFT JOIN fin ON fin.event_id = g.event_id)
       QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY poll DESC) = 1""",
    g0=f"""SELECT event_id AS n, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS event_id,
             date_trunc('hour', ts) AS poll, user_id % 6 AS club, CAST({K} // 10 AS INTEGER) AS team_score,
             CAST({K} % 10 AS INTEGER) AS opponent_score,
             CASE WHEN extract(hour FROM ts) < 8 THEN 'pre' WHEN extract(hour FROM ts) < 16 THEN 'in' ELSE 'post' END AS state,
             date_trunc('day', ts) + INTERVAL 10 HOUR AS start
           FROM events WHERE user_id % 5 <> 0
           QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) = 1""",
    g="""SELECT g0.*, team_key, typical FROM g0 JOIN (VALUES (0, 'avalanche', 150), (1, 'nuggets', 145), (2, 'rockies', 180),
           (3, 'broncos', 195), (4, 'rapids', 115), (5, 'summit', 115)) c(club, team_key, typical) USING (club)""",
    fin="""SELECT p.event_id, min(p.poll) AS seen FROM g p JOIN g l ON l.event_id = p.event_id
           WHERE p.state = 'post' AND l.state = 'in' AND l.poll < p.poll GROUP BY 1""",
)
