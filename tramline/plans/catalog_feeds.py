"""Queries that load files: the supplied tables are first written as feed and ridership files.

Each run writes to a folder of its own below the shared folder and reads it back through the
library's readers, so the scans and their rules (last folder wins, defaults, malformed values)
are what is checked. Also rollup maintenance, rebuilds and exports as stored tables.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.config import FEED_FOLDERS, WEEKDAYS
from tramline.operators import filters, latest, rollups, shapes, sinks, timetable
from tramline.plans import board, network, reports
from tramline.plans import standins as data
from tramline.plans.catalog import NOW, WINDOW, query
from tramline.session import shared_folder
from tramline.sources import ridership, static_feed

FIRST, LAST = FEED_FOLDERS[0], FEED_FOLDERS[-1]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put(rows: DataFrame, root: str, folder: str, table: str) -> None:
    rows.write.option("header", True).csv(f"{root}/{folder}/{table}.txt")


def clock(seconds):
    """Seconds as 'HH:MM:SS', hours past 24 allowed."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


@query("feed_routes")
def _(spark, folder):
    """Suppliers as routes in two folders; the later one wins where it has the route."""
    root, key = fresh(spark, "feed"), F.col("s_suppkey")
    rows = data.table(spark, folder, "supplier")
    put(rows.select(key.alias("route_id"), F.concat(F.lit("old "), "s_name").alias("route_short_name"),
                    F.lit("3").alias("route_type")), root, FIRST, "routes")
    put(rows.filter(key % 3 == 0).select(
        F.lit("ag").alias("agency_id"), F.concat(F.lit(" "), "s_name").alias("route_short_name"),
        (F.col("s_nationkey") % 4).alias("route_type"), key.alias("route_id")), root, LAST, "routes")
    # The fixed overrides are lettered routes.
    return static_feed.routes(spark, root).filter(F.col("route_id").rlike(r"^\d+$"))


def _stop_files(spark, folder):
    root, key = fresh(spark, "feed"), F.col("n_nationkey")
    rows = data.table(spark, folder, "nation")
    put(rows.select(F.col("n_name").alias("stop_id"), F.lit("old").alias("stop_name"), F.lit("d").alias("stop_desc"),
                    key.alias("stop_lat"), F.lit("x").alias("stop_lon")), root, FIRST, "stops")
    put(rows.filter(key % 2 == 1).select(
        F.when(key % 5 != 0, key / 10).alias("stop_lon"), F.concat(F.lit("Stop "), "n_name").alias("stop_name"),
        (key + 39.5).alias("stop_lat"), F.col("n_name").alias("stop_id")), root, LAST, "stops")
    return root


@query("feed_stops")
def _(spark, folder):
    return static_feed.stops(spark, _stop_files(spark, folder))


@query("feed_stop_directory")
def _(spark, folder):
    return static_feed.stop_directory(spark, _stop_files(spark, folder)).drop("is_rail")


@query("feed_trips")
def _(spark, folder):
    root, key = fresh(spark, "feed"), F.col("o_orderkey")
    rows = data.table(spark, folder, "orders")
    put(rows.select(key.alias("trip_id"), F.col("o_custkey").alias("route_id"), F.lit("old").alias("trip_headsign"),
                    (key % 2).alias("direction_id")), root, FIRST, "trips")
    put(rows.filter(key % 3 == 0).select(
        F.col("o_orderstatus").alias("trip_headsign"), key.alias("trip_id"),
        F.when(key % 2 == 0, F.col("o_custkey")).alias("route_id"), F.col("o_orderpriority").alias("service_id")),
        root, LAST, "trips")
    return static_feed.trips(spark, root).select("trip_id", "route_id", "service_id", "direction_id", "trip_headsign")


@query("feed_calendar")
def _(spark, folder):
    root = fresh(spark, "feed")
    days = [(F.pmod("n_nationkey", F.lit(i + 2)) == 0).cast("int").alias(d) for i, d in enumerate(WEEKDAYS)]
    put(data.table(spark, folder, "nation").select(F.col("n_name").alias("service_id"), *days), root, FIRST, "calendar")
    return static_feed.calendar(spark, root)


def _stop_time_files(spark, folder):
    root, line = fresh(spark, "feed"), F.col("l_linenumber")
    secs = line * 4000 + F.col("l_orderkey") % 70_000
    put(data.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"),
        F.when(line == 5, F.lit("five")).otherwise(line.cast("string")).alias("stop_sequence"),
        F.when(line % 3 != 0, clock(secs)).alias("arrival_time"),
        F.when(line % 3 != 1, clock(secs + 30)).alias("departure_time"),
        (line % 2).alias("timepoint")), root, LAST, "stop_times")
    return static_feed.stop_times(spark, root)


@query("feed_stop_times")
def _(spark, folder):
    return _stop_time_files(spark, folder).drop("line", "stop_headsign")


@query("feed_origin_departures")
def _(spark, folder):
    return timetable.origin_departures(_stop_time_files(spark, folder))


@query("feed_timepoints")
def _(spark, folder):
    return timetable.timepoints(_stop_time_files(spark, folder), data.part_stops(spark, folder)).select(
        "trip_id", "stop_sequence", "stop_id", "arrival_secs")


@query("feed_stop_list")
def _(spark, folder):
    return timetable.stop_list(_stop_time_files(spark, folder), data.part_stops(spark, folder)).select(
        "trip_id", "stop_sequence", "stop_id", "stop_name", "is_timepoint", "pickup_type")


@query("feed_shape_points")
def _(spark, folder):
    root, key = fresh(spark, "feed"), F.col("p_partkey")
    put(data.table(spark, folder, "part").select(
        F.col("p_brand").alias("shape_id"), (F.col("p_size") / 8).alias("shape_pt_lat"),
        F.when(key % 10 == 0, F.lit("bad")).otherwise((key % 100).cast("string")).alias("shape_pt_lon"),
        key.alias("shape_pt_sequence")), root, LAST, "shapes")
    return static_feed.shape_points(spark, root).drop("folder_rank")


@query("nearest_variant")
def _(spark, folder):
    part = data.table(spark, folder, "part").select(
        F.lit("R").alias("route_id"), F.col("p_brand").alias("shape_id"),
        (F.col("p_size") / 8).alias("lat"), (F.col("p_partkey") % 1000).cast("double").alias("lon"))
    return shapes.nearest_variant(part, "R", (3.0, 500.0))


@query("ridership_load")
def _(spark, folder):
    """Months of boardings in files whose headers differ in names and order."""
    root, rows = fresh(spark, "ridership"), data.ridership(spark, folder)
    odd = F.month("month") % 2 == 1
    rows.filter(odd).select(
        F.col("route_id").alias("Route"), F.date_format("month", "yyyy-MM").alias("Period"),
        F.format_number("boardings", 0).alias("Riders")).write.option("header", True).csv(root)
    rows.filter(~odd).select(
        F.col("boardings").alias("ridership"), F.lit("x").alias("note"), F.date_format("month", "MM/yyyy").alias("month"),
        F.col("route_id").alias("line")).write.mode("append").option("header", True).csv(root)
    return ridership.read_ridership(spark, root).select("route_id", "month", "boardings")


@query("rollup_refresh")
def _(spark, folder):
    """A stored rollup after a refresh: later delays moved, one day's raw rows gone."""
    spec, path = rollups.ROLLUPS["trip_ontime_hourly"], fresh(spark, "rollup")
    raw = data.timed_events(spark, folder)
    rollups.write_rollup(spec.build(raw), path)
    gone = F.to_date("timestamp") == dt.date(2024, 1, 29)
    moved = raw.filter(~gone).withColumn("delay_seconds", F.col("delay_seconds") + 60)
    rollups.refresh_rollup(moved, spec, path, NOW)
    return spark.read.parquet(path).drop("bucket_date")


@query("guarded_rebuild_rows")
def _(spark, folder):
    """Live events with everything up to the middle of the month replaced by rebuilt ones."""
    live = data.timed_events(spark, folder).select("route_id", "timestamp", "delay_seconds")
    edge = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
    staged = live.filter(F.col("timestamp") <= F.lit(edge)).withColumn("delay_seconds", F.col("delay_seconds") + 1)
    root = fresh(spark, "rebuild")
    sinks.rebuild_events(staged, live, root)
    return sinks.current_events(spark, root)


@query("cold_retained")
def _(spark, folder):
    """Positions stored by day, read back without what is older than two weeks."""
    path = fresh(spark, "cold")
    sinks.write_cold(data.positions(spark, folder), path)
    return sinks.retained(spark.read.parquet(path), NOW, 14).select("id", "route_id", "timestamp")


@query("export_json_rows")
def _(spark, folder):
    """Exported JSON lines, read back as text fields."""
    path = fresh(spark, "export")
    sinks.write_json(sinks.export_rows(data.positions(spark, folder), *WINDOW), path)
    return spark.read.schema("vehicle_id string, trip_id string, occupancy_status string, timestamp string").json(path)


@query("route_scope_rows")
def _(spark, folder):
    """Positions of routes named in a list or run by a mode, by semi-join."""
    routes = data.event_routes(spark, folder)
    scope = filters.route_scope(routes, route_ids="view, click", modes="bus,unknown")
    return filters.on_routes(data.positions(spark, folder), scope).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("route_list_rows")
def _(spark, folder):
    """Positions of a list of route ids."""
    return filters.on_routes(data.positions(spark, folder), ["view", "purchase"]).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("vehicles_at_stop")
def _(spark, folder):
    """Newest position of each vehicle, of those at one stop."""
    newest = latest.latest_positions(data.positions(spark, folder))
    return board.at_stop(newest, "NATION_7").select("vehicle_id", "stop_id", "timestamp")


@query("still_running")
def _(spark, folder):
    """Trips last seen in the last two days of the month whose vehicle is still on them."""
    rows = data.positions(spark, folder)
    legs = rows.groupBy("vehicle_label", "trip_id").agg(F.max("timestamp").alias("end_time"))
    live = latest.latest_positions(rows)
    return filters.still_running(legs, live, NOW, window_seconds=2 * 86_400)


@query("route_headways")
def _(spark, folder):
    """The 24 hours of one route's scheduled headways."""
    events = data.timed_events(spark, folder)
    hourly = events.groupBy("route_id", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("headway_minutes"))
    return reports.route_headways(hourly.filter("hour % 5 != 0"), "view")


@query("route_detail")
def _(spark, folder):
    routes = data.event_routes(spark, folder).withColumn("agency_id", F.lit("A"))
    return network.route_detail(routes, "view")


@query("ordered_route_stops")
def _(spark, folder):
    """One route's stops."""
    table = timetable.route_stops(
        data.timetable_lines(spark, folder), data.order_trips(spark, folder), data.part_stops(spark, folder))
    return network.ordered_route_stops(table, "3").select("route_id", "stop_sequence", "stop_id")


@query("schedule_frequency")
def _(spark, folder):
    trips = data.order_trips(spark, folder)
    summary = timetable.schedule_summary(
        trips.drop("departure_secs"), data.priority_calendar(spark, folder), trips.select("trip_id", "departure_secs"))
    return reports.schedule_frequency(summary).select("route_id", "weekday_trips", "span_start", "span_end")
