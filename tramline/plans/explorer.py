"""Trip explorer: the trips of a time window with status, statistics and facets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.config import ON_TIME_SECONDS
from tramline.functions.bands import mode_of, natural_key, occupancy_key
from tramline.functions.numbers import mean_half_even, round1
from tramline.functions.times import instant, micros, seconds_between
from tramline.operators.filters import closed, on_routes, within_window
from tramline.operators.latest import page_known_delays
from tramline.plans.board import count_facets
from tramline.session import stored

MAX_TRIP = dt.timedelta(hours=3)
LIVE = dt.timedelta(seconds=90)
# How far around a page's rows its delays are looked for.
PAGE_MARGIN = dt.timedelta(minutes=5)
LONGEST_TRIP = dt.timedelta(hours=3)
MIN_POSITIONS = 10

# Options listed with a zero count.
FACET_OPTIONS = {
    "status": ["in_progress", "complete", "incomplete"],
    "mode": ["rail", "bus", "other"],
}


def trip_extents(positions: DataFrame, min_positions: int = MIN_POSITIONS) -> DataFrame:
    """One row per (vehicle label, trip): first and last time, count, last values.

    The last values come from one row. Legs with few positions are dropped.
    """
    last = F.max_by(
        F.struct("route_id", "vehicle_id", "latitude", "longitude", "occupancy_status"),
        F.struct("timestamp", "id"),
    )
    return (
        positions.groupBy("vehicle_label", "trip_id")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.count(F.lit(1)).alias("observation_count"),
            last.alias("last"),
        )
        .filter(F.col("observation_count") >= min_positions)
        .select("vehicle_label", "trip_id", "start_time", "end_time", "observation_count", "last.*")
    )


def trip_arrivals(events: DataFrame) -> DataFrame:
    """Per trip: arrivals, furthest stop, mean delay and on-time share."""
    on_time = F.when(F.abs("delay_seconds") <= ON_TIME_SECONDS, 1).otherwise(0)
    return (
        events.groupBy("trip_id")
        .agg(
            F.count(F.lit(1)).alias("stop_arrival_count"),
            F.max("stop_sequence").alias("max_stop_sequence"),
            F.sum(F.col("delay_seconds").cast("long")).alias("_sum"),
            F.count("delay_seconds").alias("_n"),
            F.sum(on_time).alias("_on_time"),
        )
        .select(
            "trip_id",
            "stop_arrival_count",
            "max_stop_sequence",
            mean_half_even(F.col("_sum"), F.col("_n")).alias("avg_delay_seconds"),
            round1(F.col("_on_time") / F.col("stop_arrival_count") * 100).alias("on_time_pct"),
        )
    )


def window_trips(
    positions: DataFrame, events: DataFrame, start: dt.datetime, end: dt.datetime,
    strict: bool = False, routes=None, pad: dt.timedelta = MAX_TRIP, cap: int | None = None,
    min_positions: int = MIN_POSITIONS,
) -> DataFrame:
    """Trips that start or end in the window, with at least two arrivals.

    The scan is padded so that a trip is seen whole. The inner join of the two
    aggregates also drops arrivals of trips that are not in the window. ``cap`` is
    the optional ceiling of the page, in start order.
    """
    low, high = start - pad, end + pad
    legs = trip_extents(on_routes(closed(positions, "timestamp", low, high), routes), min_positions)
    legs = legs.filter(within_window(F.col("start_time"), F.col("end_time"), start, end, strict))
    arrivals = trip_arrivals(closed(events, "timestamp", low, high)).filter(
        F.col("stop_arrival_count") > 1
    )
    out = legs.join(arrivals, "trip_id")
    return out if cap is None else in_start_order(out).limit(cap)


def in_start_order(trips: DataFrame) -> DataFrame:
    return trips.orderBy(
        "start_time", F.col("route_id").asc_nulls_last(), "vehicle_label", "trip_id"
    )


def describe_trips(
    trips: DataFrame, routes: DataFrame, stops: DataFrame, endpoints: DataFrame, now: dt.datetime
) -> DataFrame:
    """Add names, mode, ends, duration and status.

    Without a timetable the terminus counts as reached.
    """
    dims = routes.select("route_id", "route_short_name", "route_color", "route_type")
    ends = endpoints.select("trip_id", "max_sequence", "first_stop_id", "last_stop_id")

    def names(prefix: str, key: str) -> DataFrame:
        return stops.select(
            F.col("stop_id").alias(key), F.col("stop_name").alias(f"{prefix}_stop_name")
        )

    reached = F.col("max_sequence").isNull() | F.coalesce(
        F.col("max_stop_sequence") >= F.col("max_sequence"), F.lit(False)
    )
    running = F.col("end_time") >= instant(now - LIVE)
    return (
        trips.join(dims, "route_id", "left")
        .join(ends, "trip_id", "left")
        .join(names("start", "first_stop_id"), "first_stop_id", "left")
        .join(names("end", "last_stop_id"), "last_stop_id", "left")
        .withColumn("reached_terminus", reached)
        .withColumn("in_progress", running)
        .select(
            "vehicle_label", "vehicle_id", "trip_id", "route_id", "route_short_name",
            "route_color", "route_type", mode_of(F.col("route_type")).alias("mode"),
            "start_time", "end_time",
            round1(seconds_between(F.col("end_time"), F.col("start_time")) / 60).alias(
                "duration_minutes"
            ),
            "start_stop_name", "end_stop_name", "reached_terminus", "in_progress",
            F.when(F.col("in_progress"), "in_progress")
            .when(F.col("reached_terminus"), "complete")
            .otherwise("incomplete")
            .alias("trip_status"),
            F.col("latitude").alias("last_latitude"),
            F.col("longitude").alias("last_longitude"),
            F.col("occupancy_status").alias("last_occupancy_status"),
            "avg_delay_seconds", "on_time_pct", "observation_count", "stop_arrival_count",
        )
    )


def trip_facets(trips: DataFrame) -> DataFrame:
    """Counts per status, mode, occupancy, route and vehicle, before any filter."""
    facets = {
        "status": F.col("trip_status"),
        "mode": F.col("mode"),
        "occupancy": occupancy_key(F.col("last_occupancy_status")),
        "route": F.coalesce("route_id", F.lit("")),
        "vehicle": F.nullif("vehicle_label", F.lit("")),
    }
    return count_facets(trips, facets, FACET_OPTIONS).filter(F.col("value").isNotNull())


def vehicle_routes(trips: DataFrame) -> DataFrame:
    """Route names each vehicle ran under, with the start of the first such trip."""
    named = trips.filter(
        F.coalesce("vehicle_label", F.lit("")) != ""
    ).filter(F.coalesce("route_short_name", F.lit("")) != "")
    return named.groupBy("vehicle_label", "route_short_name").agg(
        F.min("start_time").alias("first_seen"), F.count(F.lit(1)).alias("trip_count")
    )


def facet_totals(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.coalesce(F.max("duration_minutes"), F.lit(0.0)).alias("max_duration_minutes"),
    )


def sorted_facet(facets: DataFrame, facet: str) -> DataFrame:
    """One facet's options in natural order."""
    return facets.filter(F.col("facet") == facet).orderBy(*natural_key(F.col("value")))


def page(trips: DataFrame, limit: int = 15, offset: int = 0) -> DataFrame:
    return in_start_order(trips).offset(offset).limit(limit)


def page_delays(trips_page: DataFrame, updates: DataFrame, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """The page with each trip's newest delay within the span of the page's trips.

    The page feeds two branches, so its rows (a request's page size) are written once.
    """
    one = stored(trips_page, "page")
    known = page_known_delays(updates, one, "start_time", "end_time", PAGE_MARGIN, low, high)
    return one.join(known, "trip_id", "left")


def seek(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next rows in descending order of ``keys`` (unique together) behind the row ``after``.

    The first key's bound reaches the scan, and each partition hands on its best ``limit`` rows,
    so a late page reads and sorts no more than an early one.
    """
    if after is not None:
        values = [F.lit(v) if not isinstance(v, dt.datetime) else instant(v) for v in after]
        behind = F.lit(False)
        for i in range(len(keys) - 1, -1, -1):
            behind = (F.col(keys[i]) < values[i]) | ((F.col(keys[i]) == values[i]) & behind)
        rows = rows.filter(F.col(keys[0]) <= values[0]).filter(behind)
    return rows.orderBy(*[F.desc(k) for k in keys]).limit(limit)


def last_key(rows: DataFrame, keys: list[str]) -> tuple | None:
    """Key of a page's last row, to seek the next page with; instants as UTC."""
    shown = [micros(F.col(k)).alias(k) if dict(rows.dtypes)[k] == "timestamp" else F.col(k) for k in keys]
    row = rows.orderBy(*keys).select(*shown).first()
    if row is None:
        return None
    return tuple(
        dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=row[k])
        if dict(rows.dtypes)[k] == "timestamp" else row[k] for k in keys)


def history_page(
    positions: DataFrame, updates: DataFrame, routes: DataFrame, start: dt.datetime,
    end: dt.datetime, route_id: str | None = None, limit: int = 200, page_no: int = 1,
    after: tuple | None = None,
) -> DataFrame:
    """Stored positions of a time span, newest first, one page with names and delays.

    ``after`` is the (timestamp, id) of the page before (see ``last_key``); with ``page_no`` alone
    the page is reached by seeking through the pages before it.
    """
    rows = closed(positions, "timestamp", start, end)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    keys = ["timestamp", "id"]
    for _ in range(page_no - 1):
        after = last_key(seek(rows.select(*keys), keys, after, limit), keys) or after
    one = stored(seek(rows, keys, after, limit), "page")
    delays = page_known_delays(updates, one, "timestamp", "timestamp", LONGEST_TRIP, start, end)
    return (
        one.join(routes.select("route_id", "route_short_name"), "route_id", "left")
        .join(delays.withColumnRenamed("last_delay_seconds", "delay_seconds"), "trip_id", "left")
        .orderBy(*[F.desc(k) for k in keys])
    )


def bounded_count(rows: DataFrame, ceiling: int = 50_000) -> DataFrame:
    """Row count that stops at a ceiling, for page numbers."""
    return rows.select(F.lit(1).alias("one")).limit(ceiling).agg(F.count(F.lit(1)).alias("total"))
