"""Queries on look-backs, silences, live windows, keyset pages, polls committed whole, and rollups that
follow a log of changes.

Event positions are hours apart, so windows are hours and days wide.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tramline.functions.bands import mode_of
from tramline.operators import invalidation, latest, rollups, sinks
from tramline.plans import alerts, explorer
from tramline.plans import standins as data
from tramline.plans.catalog import DAY, NOW, STUCK, WINDOW, query
from tramline.plans.catalog_feeds import fresh
from tramline.streaming import ingest, windows

LIVE_NOW = dt.datetime(2024, 1, 20, 12, tzinfo=dt.timezone.utc)
PAGE, PAGE_NO = 150, 4


@query("active_in_window")
def _(spark, folder):
    return windows.active_in_window(data.positions(spark, folder), DAY, DAY // 4)


@query("latest_in_window")
def _(spark, folder):
    return windows.latest_in_window(data.positions(spark, folder), 2 * DAY, DAY).select(
        "vehicle_id", "until", "id", "trip_id", "timestamp")


@query("trip_sessions")
def _(spark, folder):
    return windows.trip_sessions(data.positions(spark, folder), 2 * DAY)


@query("latest_position_live")
def _(spark, folder):
    """The newest rows of a look-back that ends now."""
    return latest.latest_positions(data.positions(spark, folder), LIVE_NOW, 3 * DAY).select(
        "id", "vehicle_id", "trip_id", "route_id", "timestamp")


@query("latest_delay_live")
def _(spark, folder):
    return latest.latest_feed_delays(data.updates(spark, folder), LIVE_NOW, 3 * DAY)


@query("stationary_streak_live")
def _(spark, folder):
    return alerts.stationary_streaks(data.positions(spark, folder), LIVE_NOW, STUCK).select(
        "vehicle", "trip_id", "stuck_since", "streak_rows", "only_stopped")


@query("terminals_in_reach")
def _(spark, folder):
    """Positions of trips without a timetable, at or near an end of their route."""
    rows = data.positions(spark, folder).withColumn("vehicle", F.col("id").cast("string"))
    ends = data.timepoints(spark, folder).limit(0).select(
        "trip_id", F.col("stop_id").alias("first_stop_id"), F.col("stop_id").alias("last_stop_id"))
    routes = data.event_routes(spark, folder).select("route_id")
    stops = data.nation_stops(spark, folder)
    terminals = routes.join(stops.select("stop_id"), F.pmod(F.length("stop_id"), F.lit(5)) == F.pmod(F.length("route_id"), F.lit(5)))
    return alerts.at_terminal(rows, ends, terminals, stops, 9000.0)


@query("history_seek")
def _(spark, folder):
    """A later page, reached by its key."""
    return explorer.history_page(
        data.positions(spark, folder), data.updates(spark, folder), data.event_routes(spark, folder), *WINDOW,
        limit=PAGE, page_no=PAGE_NO,
    ).select("id", "trip_id", "route_short_name", "timestamp", "delay_seconds")


class HalfWritten(Exception):
    pass


def _fails(rows):
    raise HalfWritten


@query("poll_append_rows")
def _(spark, folder):
    """Three polls of three tables: one, one that is landed twice, and one that stops half way."""
    root = fresh(spark, "polls")
    facts = {"positions": data.positions(spark, folder), "updates": data.updates(spark, folder),
             "arrivals": data.timed_events(spark, folder)}
    tables = {name: lambda poll, rows=rows: rows.join(poll, "id", "left_semi") for name, rows in facts.items()}
    ids = facts["positions"].select("id")
    for poll in (0, 1, 1):
        ingest.append_poll(root, tables)(ids.filter(F.pmod("id", F.lit(3)) == poll), poll)
    try:
        ingest.append_poll(root, {**tables, "arrivals": _fails})(ids.filter(F.pmod("id", F.lit(3)) == 2), 2)
    except HalfWritten:
        pass
    out = None
    for name in facts:
        rows = ingest.committed(spark, root, name).groupBy("poll").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum")).select(
            F.lit(name).alias("fact"), F.col("poll").cast("long").alias("poll"), "rows", "id_sum")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rollup_invalidated")
def _(spark, folder):
    """A rollup after late rows of some old days came in; only their buckets are of the second version."""
    spec, root = rollups.ROLLUPS["trip_ontime_hourly"], fresh(spark, "invalidated")
    raw = data.timed_events(spark, folder)
    late = F.pmod("id", F.lit(10)) == 0
    old = F.col("timestamp") < F.lit(dt.datetime(2024, 1, 4, tzinfo=dt.timezone.utc))
    for batch, rows in enumerate((raw.filter(~late), raw.filter(late & old))):
        invalidation.log_changes(rows, spec, root, batch)
        there = raw.filter(~late | (F.lit(batch == 1) & old))
        invalidation.refresh_changed(there, spec, root, NOW)
    return invalidation.current(spark, root)


@query("rollup_backfill")
def _(spark, folder):
    """The first build, over the ninety days before a later day."""
    spec = rollups.ROLLUPS["trip_ontime_hourly"]
    return rollups.build_rollup(data.timed_events(spark, folder), spec, dt.datetime(2024, 4, 15, 6, 30, tzinfo=dt.timezone.utc))


@query("export_by_mode")
def _(spark, folder):
    """The newest positions as JSON, a folder for each mode, read back."""
    path = fresh(spark, "modes")
    rows = latest.latest_positions(data.positions(spark, folder)).join(data.event_routes(spark, folder), "route_id")
    sinks.write_by_mode(rows.select(
        mode_of(F.col("route_type")).alias("mode"), "id", "vehicle_id", "route_id", "occupancy_status"), path)
    return spark.read.schema("id long, vehicle_id string, route_id string, occupancy_status string, mode string").json(path)
