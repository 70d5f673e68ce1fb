"""Registered queries: each operator and report over the supplied tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.config import DetectionConfig, StuckConfig
from tramline.functions import bands, geo, times
from tramline.functions.numbers import round_int
from tramline.operators import detect, filters, latest, nearest, rollups, shapes, sinks, timetable
from tramline.operators.upsert import upsert_ridership
from tramline.plans import alerts, board, explorer, games, network, reports, timeline
from tramline.plans import standins as data
from tramline.session import stored
from tramline.sources import realtime_feed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The whole span of the order tables and of the event table, as local days.
ORDER_DAYS = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
EVENT_DAYS = (dt.date(2023, 12, 31), dt.date(2024, 1, 31))


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return data.naive(build(spark, folder))

        QUERIES[name] = run
        return build

    return register


# Rollups and the reports on them.


@query("ontime_rollup")
def _(spark, folder):
    return rollups.ontime_hourly(data.stop_events(spark, folder))


@query("ontime_rollup_hourly")
def _(spark, folder):
    return rollups.ontime_hourly(data.timed_events(spark, folder))


@query("ontime_rollup_two_minutes")
def _(spark, folder):
    return rollups.ontime_hourly(data.stop_events(spark, folder), profile="two_minutes")


@query("feed_delay_rollup")
def _(spark, folder):
    feed = data.updates(spark, folder)
    return rollups.ontime_hourly(feed, delay="arrival_delay", profile="feed_delay")


@query("ontime_by_route")
def ontime_by_route(spark, folder):
    rollup = rollups.ontime_hourly(data.stop_events(spark, folder))
    return reports.ontime_by_route(rollup, *ORDER_DAYS, names=data.supplier_routes(spark, folder))


@query("ontime_top_routes")
def _(spark, folder):
    rollup = rollups.ontime_hourly(data.stop_events(spark, folder))
    return reports.best_on_time(reports.ontime_by_route(rollup, *ORDER_DAYS)).drop("overall")


@query("ontime_trend_day")
def _(spark, folder):
    rollup = rollups.ontime_hourly(data.timed_events(spark, folder))
    return reports.ontime_trend(rollup, *EVENT_DAYS)


@query("ontime_trend_hour")
def _(spark, folder):
    rollup = rollups.ontime_hourly(data.timed_events(spark, folder))
    return reports.ontime_trend(rollup, *EVENT_DAYS, granularity="hour")


@query("heatmap_hour_dow")
def _(spark, folder):
    rollup = rollups.ontime_hourly(data.timed_events(spark, folder))
    return reports.ontime_heatmap(rollup, *EVENT_DAYS)


@query("delay_distribution")
def _(spark, folder):
    rollup = rollups.ontime_hourly(data.stop_events(spark, folder))
    return reports.delay_distribution(rollup, *ORDER_DAYS)


@query("stop_delay_rollup")
def _(spark, folder):
    return rollups.stop_delay_daily(data.stop_events(spark, folder))


@query("worst_stops")
def _(spark, folder):
    rollup = rollups.stop_delay_daily(data.stop_events(spark, folder))
    return reports.worst_stops(rollup, *ORDER_DAYS, stops=data.part_stops(spark, folder))


@query("trip_activity")
def _(spark, folder):
    return rollups.trip_activity_daily(data.stop_events(spark, folder))


def _trips_per_dow(spark, folder):
    return timetable.trips_per_dow(
        data.order_trips(spark, folder), data.priority_calendar(spark, folder)
    )


@query("scheduled_trips_in_range")
def _(spark, folder):
    return reports.scheduled_trips(_trips_per_dow(spark, folder), *ORDER_DAYS)


@query("service_delivery")
def _(spark, folder):
    activity = rollups.trip_activity_daily(data.stop_events(spark, folder))
    names = data.supplier_routes(spark, folder)
    return reports.service_delivery(
        activity, _trips_per_dow(spark, folder), *ORDER_DAYS, names=names
    ).drop("route_type")


@query("least_delivered")
def _(spark, folder):
    activity = rollups.trip_activity_daily(data.stop_events(spark, folder))
    delivery = reports.service_delivery(activity, _trips_per_dow(spark, folder), *ORDER_DAYS)
    return reports.least_delivered(delivery).drop("overall")


@query("overview_period_delta")
def _(spark, folder):
    events = data.stop_events(spark, folder)
    return reports.overview(
        rollups.ontime_hourly(events),
        rollups.trip_activity_daily(events),
        _trips_per_dow(spark, folder),
        data.ridership(spark, folder),
        dt.date(1998, 7, 1),
        ORDER_DAYS[1],
    )


@query("occupancy_rollup")
def _(spark, folder):
    return rollups.occupancy_hourly(data.positions(spark, folder))


@query("occupancy_levels")
def _(spark, folder):
    return rollups.occupancy_levels_hourly(data.positions(spark, folder))


@query("occupancy_totals")
def _(spark, folder):
    return reports.occupancy_totals(
        rollups.occupancy_hourly(data.positions(spark, folder)), *EVENT_DAYS
    )


@query("occupancy_by_hour")
def _(spark, folder):
    return reports.occupancy_by_hour(
        rollups.occupancy_hourly(data.positions(spark, folder)), *EVENT_DAYS
    )


@query("occupancy_shares_by_hour")
def _(spark, folder):
    return reports.occupancy_shares(
        reports.occupancy_by_hour(
            rollups.occupancy_hourly(data.positions(spark, folder)), *EVENT_DAYS
        )
    )


@query("active_per_5min")
def _(spark, folder):
    return reports.active_per_bucket(data.positions(spark, folder))


@query("headway_now")
def _(spark, folder):
    return reports.headway_now(
        reports.active_per_bucket(data.positions(spark, folder)), data.event_routes(spark, folder)
    )


def _mondays(spark, folder):
    trips = data.order_trips(spark, folder)
    return timetable.monday_departures(
        trips.drop("departure_secs"),
        data.priority_calendar(spark, folder),
        trips.select("trip_id", "departure_secs"),
    )


@query("headway_scheduled")
def _(spark, folder):
    return timetable.scheduled_headways(_mondays(spark, folder))


@query("schedule_summary")
def _(spark, folder):
    trips = data.order_trips(spark, folder)
    return timetable.schedule_summary(
        trips.drop("departure_secs"),
        data.priority_calendar(spark, folder),
        trips.select("trip_id", "departure_secs"),
    )


@query("monthly_series")
def _(spark, folder):
    return reports.ridership_series(data.ridership(spark, folder))


@query("ridership_latest_routes")
def _(spark, folder):
    return reports.ridership_by_route(data.ridership(spark, folder))


@query("rollup_with_live_tail")
def _(spark, folder):
    """The stored half and the live half together equal the rollup of everything."""
    raw = data.timed_events(spark, folder)
    spec = rollups.ROLLUPS["trip_ontime_hourly"]
    edge = dt.datetime(2024, 1, 16, 13, 37, tzinfo=dt.timezone.utc)
    return rollups.with_live_tail(spec.build(raw), raw, spec, edge)


@query("upsert_monthly")
def _(spark, folder):
    """Stored months up to 1998 meet a load that starts in 1997."""
    months = data.ridership(spark, folder)
    old = months.filter(F.col("month") < dt.date(1999, 1, 1))
    new = months.filter(F.col("month") >= dt.date(1997, 1, 1)).withColumn(
        "boardings", F.col("boardings") + 1000
    )
    return upsert_ridership(old, new)


# Positions, the live board, alerts.

WINDOW = (
    dt.datetime(2023, 12, 31, tzinfo=dt.timezone.utc),
    dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc),
)
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
DAY = 86_400
# Event positions are hours apart and scattered, so the stuck rule gets wide limits.
STUCK = StuckConfig(threshold_seconds=DAY, tolerance_deg=0.15, terminal_radius_m=5000.0)


@query("latest_position")
def _(spark, folder):
    return latest.latest_positions(data.positions(spark, folder))


@query("latest_delay")
def _(spark, folder):
    return latest.latest_feed_delays(data.updates(spark, folder))


@query("latest_known_delay")
def _(spark, folder):
    return latest.latest_known_delays(
        data.updates(spark, folder), *WINDOW, data.positions(spark, folder).select("trip_id")
    )


@query("dedupe_batch")
def _(spark, folder):
    """Positions of one hour count as one poll."""
    rows = data.positions(spark, folder).withColumn("poll", F.date_trunc("hour", "timestamp"))
    rows = rows.withColumn("latitude", F.round("latitude", 1)).withColumn("longitude", F.round("longitude", 1))
    return latest.dedupe_poll(rows.withColumn("vehicle_id", F.col("route_id")), "poll")


def _live(spark, folder):
    return board.live_board(
        data.positions(spark, folder),
        data.updates(spark, folder),
        data.event_routes(spark, folder),
        data.nation_stops(spark, folder),
    )


@query("live_board")
def live_board(spark, folder):
    return _live(spark, folder)


@query("snapshot_headways")
def _(spark, folder):
    return board.snapshot_headways(latest.latest_positions(data.positions(spark, folder)))


@query("board_bands")
def _(spark, folder):
    return board.with_bands(_live(spark, folder)).select(
        "vehicle_id", "mode", "vehicle_key", "headway_band", "occupancy_key", "punctuality_band",
        "movement_band",
    )


@query("board_facets")
def _(spark, folder):
    return board.board_facets(board.with_bands(_live(spark, folder)))


@query("board_filtered")
def _(spark, folder):
    wanted = filters.LiveFilter(
        punctuality=["late", "very_late", "early"], occupancy=["FULL", "EMPTY", "UNKNOWN"],
        movement=["stopped", "in_transit"],
    )
    return wanted.apply(board.with_bands(_live(spark, folder))).select(
        "vehicle_id", "route_id", "punctuality_band", "occupancy_key", "movement_band"
    )


@query("active_routes")
def _(spark, folder):
    return board.active_routes(board.with_bands(_live(spark, folder)), "line")


@query("outside_downtown")
def _(spark, folder):
    rows = data.positions(spark, folder)
    away = geo.outside_disc(F.col("latitude"), F.col("longitude"), (39.75, -105.15), 0.1)
    return rows.filter(away).select("id", "latitude", "longitude")


@query("stationary_streak")
def _(spark, folder):
    return alerts.stationary_streaks(data.positions(spark, folder), cfg=STUCK).select(
        "vehicle", "trip_id", "stuck_since", "streak_rows", "only_stopped"
    )


def _event_trips(spark, folder):
    rows = data.positions(spark, folder)
    return rows.groupBy("trip_id").agg(F.min("route_id").alias("route_id"))


@query("stuck_vehicles")
def _(spark, folder):
    ends = timetable.trip_endpoints(data.timepoints(spark, folder))
    return alerts.stuck_vehicles(
        data.positions(spark, folder), NOW, ends,
        timetable.route_terminals(ends, _event_trips(spark, folder)),
        data.nation_stops(spark, folder), data.event_routes(spark, folder), STUCK,
        whole_history=True,
    ).drop("latitude", "longitude")


# Trip explorer, history, timeline.


def _window(spark, folder):
    return explorer.window_trips(
        data.positions(spark, folder), data.timed_events(spark, folder), *WINDOW
    )


@query("trip_window_agg")
def _(spark, folder):
    return _window(spark, folder)


@query("trip_delay_stats")
def _(spark, folder):
    return explorer.trip_arrivals(data.stop_events(spark, folder))


def _described(spark, folder):
    return explorer.describe_trips(
        _window(spark, folder),
        data.event_routes(spark, folder),
        data.nation_stops(spark, folder),
        timetable.trip_endpoints(data.timepoints(spark, folder)),
        dt.datetime(2024, 1, 30, 20, 0, tzinfo=dt.timezone.utc),
    )


@query("trip_explorer")
def trip_explorer(spark, folder):
    return _described(spark, folder)


@query("trip_explorer_page")
def _(spark, folder):
    page = explorer.page(_described(spark, folder), limit=15, offset=15)
    return explorer.page_delays(page, data.updates(spark, folder), *WINDOW).select(
        "trip_id", "vehicle_label", "start_time", "trip_status", "last_delay_seconds"
    )


@query("trip_explorer_filtered")
def _(spark, folder):
    wanted = filters.TripFilter(
        statuses=["complete", "incomplete"], occupancy=["UNKNOWN", "FULL", "EMPTY"],
        avg_delay=(-200.0, 300.0), on_time=(20.0, None), duration=(600.0, None),
    )
    return wanted.apply(_described(spark, folder)).select(
        "trip_id", "trip_status", "avg_delay_seconds", "on_time_pct", "duration_minutes"
    )


@query("trip_facets")
def _(spark, folder):
    return explorer.trip_facets(_described(spark, folder))


@query("trip_facet_totals")
def _(spark, folder):
    return explorer.facet_totals(_described(spark, folder))


@query("vehicle_routes")
def _(spark, folder):
    return explorer.vehicle_routes(_described(spark, folder))


@query("history_page")
def _(spark, folder):
    return explorer.history_page(
        data.positions(spark, folder), data.updates(spark, folder),
        data.event_routes(spark, folder), *WINDOW,
    ).select("id", "trip_id", "route_short_name", "timestamp", "delay_seconds")


@query("bounded_count")
def _(spark, folder):
    return explorer.bounded_count(data.positions(spark, folder))


def _later_events(spark, folder):
    """Events moved three hours on, so that none falls on a position's instant."""
    return data.timed_events(spark, folder).select(
        "id", F.col("stop_id").alias("vehicle_id"),
        times.shift(F.col("timestamp"), 10_800).alias("at"),
    )


@query("nearest_status_at_event")
def _(spark, folder):
    return nearest.nearest_label(
        _later_events(spark, folder), data.positions(spark, folder), ["vehicle_id"], "at", ["id"],
        "occupancy_status", block_seconds=5 * DAY,
    )


@query("interpolated_position")
def _(spark, folder):
    found = nearest.position_at(
        _later_events(spark, folder), data.positions(spark, folder), ["vehicle_id"], "at", ["id"],
        block_seconds=5 * DAY,
    )
    return found.select(
        "id", "vehicle_id", "at",
        *[F.round(c, 6).alias(c) for c in ("at_lat", "at_lon", "at_bearing")],
    )


def _timeline(spark, folder):
    """Each user-week's eight timepoints against the events seen at stops 1 to 10."""
    plan = data.timepoints(spark, folder).withColumns(
        {
            "stop_name": F.concat(F.lit("Stop "), F.col("stop_id")),
            "stop_headsign": F.lit(None).cast("string"),
            "is_timepoint": F.lit(True),
            "pickup_type": F.lit("0"),
            "drop_off_type": F.lit("0"),
        }
    )
    events = data.timed_events(spark, folder).select(
        "trip_id", "stop_sequence",
        F.concat(F.lit("NATION_"), F.col("stop_sequence").cast("string")).alias("stop_id"),
        times.shift(F.col("timestamp"), -F.col("delay_seconds")).alias("scheduled_time"),
        F.col("timestamp").alias("actual_time"), "delay_seconds",
        *[F.lit(None).cast("double").alias(c) for c in ("actual_lat", "actual_lon", "actual_bearing")],
        F.lit("geofence").alias("detection_method"),
    )
    origins = plan.groupBy("trip_id").agg(F.min("stop_sequence").alias("stop_sequence"))
    return timeline.trip_timeline(
        plan, events, data.positions(spark, folder), origins, data.nation_stops(spark, folder),
        block_seconds=5 * DAY,
    )


@query("trip_timeline")
def trip_timeline(spark, folder):
    return _timeline(spark, folder).select(
        "trip_id", "stop_sequence", "stop_id", "stop_name", "scheduled_time", "observed",
        "event_type", "actual_time", "delay_seconds", "occupancy_status",
    )


@query("trip_timeline_totals")
def _(spark, folder):
    return timeline.timeline_totals(_timeline(spark, folder))


# Clock arithmetic on whole columns.


@query("service_date_pick")
def _(spark, folder):
    rows = data.timed_events(spark, folder)
    secs = F.pmod(F.col("id") * 7919, F.lit(108_000)).cast("int")
    day = times.service_day(F.col("timestamp"), secs)
    return rows.select("id", day.alias("d")).select(
        "id", "d.service_date", "d.scheduled_time", round_int(F.col("d.delay")).alias("delay_seconds")
    )


@query("scheduled_instant")
def _(spark, folder):
    """Order dates run through many clock changes."""
    orders = data.table(spark, folder, "orders")
    secs = F.pmod(F.col("o_orderkey") * 977, F.lit(108_000)).cast("int")
    return orders.select(
        "o_orderkey", times.scheduled_instant(F.to_date("o_orderdate"), secs).alias("scheduled")
    )


# Timetable tables.


@query("cumulative_distance")
def _(spark, folder):
    rows = timetable.with_distance(data.located_lines(spark, folder))
    return rows.select("trip_id", "stop_sequence", "stop_id", F.round("dist_m", 3).alias("dist_m"))


@query("neighbour_gap_filter")
def _(spark, folder):
    rows = timetable.with_distance(data.located_lines(spark, folder))
    return timetable.drop_close_neighbours(rows, 20_000.0).select("trip_id", "stop_sequence", "stop_id")


@query("trip_endpoints")
def _(spark, folder):
    return timetable.trip_endpoints(data.timetable_lines(spark, folder))


@query("trip_ends_timepoints")
def _(spark, folder):
    ends = timetable.ends_of_trips(data.timepoints(spark, folder))
    return ends.select(
        "trip_id",
        F.col("origin.stop_id").alias("origin_stop"), F.col("origin.arrival_secs").alias("origin_secs"),
        F.col("terminus.stop_id").alias("terminus_stop"),
        F.col("terminus.arrival_secs").alias("terminus_secs"),
    )


@query("route_terminals")
def _(spark, folder):
    ends = timetable.trip_endpoints(data.timetable_lines(spark, folder))
    return timetable.route_terminals(ends, data.order_trips(spark, folder))


@query("route_stops")
def _(spark, folder):
    return timetable.route_stops(
        data.timetable_lines(spark, folder), data.order_trips(spark, folder),
        data.part_stops(spark, folder),
    ).drop("stop_lat", "stop_lon")


@query("stop_routes")
def _(spark, folder):
    table = timetable.route_stops(
        data.timetable_lines(spark, folder), data.order_trips(spark, folder),
        data.part_stops(spark, folder),
    )
    routes = data.supplier_routes(spark, folder).withColumns(
        {"route_long_name": F.lit(None).cast("string"), "route_color": F.lit(None).cast("string")}
    )
    return timetable.stop_routes(table, routes)


@query("stop_slots")
def _(spark, folder):
    points = data.timetable_lines(spark, folder).withColumn(
        "arrival_secs", F.col("stop_sequence") * 600
    )
    return timetable.stop_slots(points, data.order_trips(spark, folder))


@query("direction_headsign")
def _(spark, folder):
    return timetable.route_directions(data.order_trips(spark, folder))


@query("stop_search")
def _(spark, folder):
    return network.search_stops(data.part_stops(spark, folder), "ol", 40).select(
        "stop_id", "stop_name", "is_rail"
    )


@query("route_list")
def _(spark, folder):
    return network.route_list(
        data.event_routes(spark, folder).withColumn("agency_id", F.lit("A"))
    )


@query("delay_bands")
def _(spark, folder):
    rows = data.timed_events(spark, folder)
    return rows.groupBy(bands.punctuality_band(F.col("delay_seconds")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Arrival detection. Event positions are about seven hours and kilometres apart, so
# the limits are scaled up; the rules are the same.

DETECTION = DetectionConfig(
    radius=2_000.0, radius_rail=3_000.0, segment_max_gap=DAY, origin_radius=4_000.0,
    origin_silence=2 * DAY, terminus_radius=5_000.0, terminus_radius_rail=6_000.0,
    terminus_silence=2 * DAY, max_delay=21_600, alias_min_delay=600, alias_max_gap=3_600,
    alias_active_window=DAY,
)


def _points(spark, folder):
    """The detection timetable, computed once as a job of its own would."""
    rows = timetable.with_distance(data.timepoints(spark, folder))
    return stored(rows.drop("hop_prev", "hop_next"), "timetable")


def _projected(spark, folder, points=None):
    points = _points(spark, folder) if points is None else points
    lines = detect.trip_lines(points).stored()
    routes = data.event_routes(spark, folder)
    return detect.project(data.positions(spark, folder), lines, routes, DETECTION), lines


def _second(name: str):
    """Interpolated instants carry the last bits of a division; a second is enough."""
    return F.date_trunc("second", times.shift(F.col(name), 0.5)).alias(name)


def _by_rule(spark, folder, rule):
    fixes, lines = _projected(spark, folder)
    found = detect.candidates(fixes, DETECTION, methods=(rule,))
    return detect.with_stops(found, lines, DETECTION).select(
        "trip_id", "route_id", "stop_id", "stop_sequence", "service_date", "scheduled_time",
        _second("actual_time"), _second("emit_time"),
        F.round("actual_lat", 6).alias("actual_lat"), F.round("actual_lon", 6).alias("actual_lon"),
    )


@query("route_projection")
def _(spark, folder):
    fixes, _ = _projected(spark, folder)
    return fixes.select(
        "id", F.round("lateral", 2).alias("off_route"), F.round("proj", 2).alias("proj"), "passed",
        "geofence_no",
    )


@query("geofence_arrivals")
def _(spark, folder):
    return _by_rule(spark, folder, detect.GEOFENCE)


@query("segment_arrivals")
def _(spark, folder):
    return _by_rule(spark, folder, detect.SEGMENT)


@query("origin_departure")
def _(spark, folder):
    return _by_rule(spark, folder, detect.ORIGIN)


@query("terminus_fallback")
def _(spark, folder):
    return _by_rule(spark, folder, detect.TERMINUS)


def _guarded(spark, folder):
    points = _points(spark, folder)
    fixes, lines = _projected(spark, folder, points)
    found = detect.with_stops(detect.candidates(fixes, DETECTION), lines, DETECTION)
    slots = timetable.stop_slots(points, _event_trips(spark, folder))
    seen = detect.activity(data.positions(spark, folder), DETECTION)
    return detect.alias_guard(found, slots, seen, DETECTION)


def _event_key(df):
    return df.select(
        "trip_id", "stop_sequence", "service_date", "detection_method", _second("actual_time")
    )


@query("alias_guard")
def _(spark, folder):
    return _event_key(_guarded(spark, folder))


@query("trip_activity_bins")
def _(spark, folder):
    return detect.activity(data.positions(spark, folder), DETECTION)


@query("first_event_per_key")
def _(spark, folder):
    return _event_key(detect.first_per_stop(_guarded(spark, folder)))


@query("closed_runs")
def _(spark, folder):
    return _event_key(detect.close_runs(detect.first_per_stop(_guarded(spark, folder))))


@query("detect_arrivals")
def detect_all(spark, folder):
    points = _points(spark, folder)
    events = detect.detect_arrivals(
        data.positions(spark, folder), points,
        timetable.stop_slots(points, _event_trips(spark, folder)),
        data.event_routes(spark, folder), DETECTION,
    )
    return events.select(
        "trip_id", "route_id", "stop_id", "stop_sequence", "scheduled_time", _second("actual_time"),
        "delay_seconds", "service_date", "detection_method",
        F.round("actual_lat", 6).alias("actual_lat"), F.round("actual_lon", 6).alias("actual_lon"),
    )


@query("detected_punctuality")
def _(spark, folder):
    """From positions to a report: detection, hourly rollup, share by route."""
    points = _points(spark, folder)
    events = detect.detect_arrivals(
        data.positions(spark, folder), points,
        timetable.stop_slots(points, _event_trips(spark, folder)),
        data.event_routes(spark, folder), DETECTION,
    )
    return reports.ontime_by_route(rollups.ontime_hourly(events), *EVENT_DAYS)


# Feeds, exports, games, shapes.


@query("nested_feed_flatten")
def _(spark, folder):
    return realtime_feed.vehicle_positions(data.vehicle_entities(spark, folder)).drop("id")


@query("trip_update_flatten")
def _(spark, folder):
    return realtime_feed.trip_updates(data.update_entities(spark, folder)).drop("id")


@query("route_occupancy_summary")
def _(spark, folder):
    """The status map is unfolded into rows to be comparable."""
    summary = realtime_feed.route_summary(
        data.positions(spark, folder), data.event_routes(spark, folder)
    )
    return summary.select(
        "mode", "route_id", "route_short_name", "total_vehicles",
        F.explode("occupancy_levels").alias("status", "n"),
    )


@query("export_page")
def _(spark, folder):
    rows = sinks.export_rows(data.positions(spark, folder), *WINDOW, limit=5_000)
    return rows.select("vehicle_id", "trip_id", "route_id", "stop_id", "timestamp")


@query("gtfs_time_parse")
def _(spark, folder):
    """Order keys spelled as timetable times, some past midnight, malformed or beyond 32 bits."""
    key = F.col("o_orderkey")
    text = F.format_string(
        "%02d:%02d:%02d", (key % 30).cast("int"), (key % 60).cast("int"), (key % 7).cast("int")
    )
    spelled = F.when(key % 13 == 0, F.substring(text, 1, 5)).when(
        key % 19 == 0, "999999:00:00").otherwise(text)
    secs = times.gtfs_seconds(spelled)
    return data.table(spark, folder, "orders").select(
        "o_orderkey", secs.alias("seconds"), times.hour_minute(secs).alias("clock")
    )


@query("month_parse")
def _(spark, folder):
    """Order months in seven spellings; counts with thousands separators, beyond 32 bits, or no number."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    spellings = [F.date_format(day, f) for f in
                 ("yyyy-MM-dd", "yyyy-MM", "yyyy/MM", "MM/yyyy", "MMM yyyy", "MMMM yyyy", "yyyyMM")]
    text = F.element_at(F.array(*spellings), (key % 7).cast("int") + 1)
    return data.table(spark, folder, "orders").select(
        "o_orderkey",
        times.parse_month(text).alias("month"),
        times.parse_count(F.when(key % 11 == 0, "NaN").when(key % 17 == 0, "3,000,000,000").otherwise(
            F.format_number(key * 37, 0))).alias("boardings"),
    )


@query("games_board")
def _(spark, folder):
    return games.games_history(data.scoreboard_polls(spark, folder)).select(
        "event_id", "team_key", "state", "start", "end", "team_score", "opponent_score", "result"
    )


@query("shape_simplify")
def _(spark, folder):
    return shapes.simplify_shapes(data.shape_points(spark, folder), 0.02)
