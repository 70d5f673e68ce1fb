"""Vehicles that have not moved for a while, away from the ends of their line."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import EARTH_RADIUS_M, StuckConfig
from tramline.functions.geo import haversine_m, same_place, valid_gps
from tramline.functions.numbers import round1
from tramline.functions.times import instant, seconds_between
from tramline.operators.filters import closed

LATEST = [
    "vehicle_id", "vehicle_label", "trip_id", "route_id", "latitude", "longitude", "stop_id",
    "timestamp", "id",
]


def stationary_streaks(
    positions: DataFrame, now: dt.datetime | None = None, cfg: StuckConfig = StuckConfig()
) -> DataFrame:
    """Per vehicle: since when its rows, newest backwards, stay at the newest place.

    Built from aggregates joined back per vehicle: the newest row, then the newest
    row elsewhere, then the rows after that one.
    """
    rows = positions
    if now is not None:
        rows = closed(rows, "timestamp", now - dt.timedelta(seconds=cfg.window_seconds), now)
    key = F.coalesce(F.nullif("vehicle_id", F.lit("")), F.nullif("trip_id", F.lit("")), F.lit(""))
    rows = rows.withColumn("vehicle", key)
    order = F.struct("timestamp", "id")
    newest = rows.groupBy("vehicle").agg(
        F.max_by(F.struct(*LATEST), order).alias("latest"), F.count(F.lit(1)).alias("rows")
    )
    newest = newest.filter(
        (F.col("rows") >= 2)
        & valid_gps(F.col("latest.latitude"), F.col("latest.longitude"), cfg.zero_deg)
    )
    slim = rows.select("vehicle", "latitude", "longitude", "current_status", "timestamp", "id")
    marked = slim.join(newest.select("vehicle", "latest"), "vehicle").select(
        "vehicle", order.alias("place"), "timestamp", "current_status",
        same_place(
            F.col("latest.latitude"), F.col("latest.longitude"),
            F.col("latitude"), F.col("longitude"), cfg.tolerance_deg,
        ).alias("same"),
    )
    moved = marked.filter(~F.col("same")).groupBy("vehicle").agg(F.max("place").alias("moved"))
    streak = (
        marked.join(moved, "vehicle", "left")
        .filter(F.col("moved").isNull() | (F.col("place") > F.col("moved")))
        .groupBy("vehicle")
        .agg(
            F.min("timestamp").alias("stuck_since"),
            F.count(F.lit(1)).alias("streak_rows"),
            F.count("current_status").alias("_known"),
            F.count_if(F.col("current_status") == 1).alias("_stopped"),
        )
    )
    only_stopped = (F.col("_known") > 0) & (F.col("_stopped") == F.col("_known"))
    return newest.join(streak, "vehicle").select(
        "vehicle", "latest.*", "stuck_since", "streak_rows", only_stopped.alias("only_stopped")
    )


def _cells(radius_m: float) -> tuple[float, int]:
    """Width in degrees and number around the globe of cells that a circle's height doesn't exceed."""
    height = math.degrees(2 * radius_m / EARTH_RADIUS_M)
    around = max(1, int(360 / height))
    return 360 / around, around


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def terminal_cells(places: DataFrame, radius_m: float) -> DataFrame:
    """Each terminal under every cell that the circle around it touches.

    A circle reaches asin(sin(radius) / cos(latitude)) of longitude; within a radius of a pole
    that is all the way round. Longitudes wrap.
    """
    width, around = _cells(radius_m)
    angle = radius_m / EARTH_RADIUS_M * (1 + 1e-9)
    lat, lon = F.col("stop_lat"), F.col("stop_lon")
    ratio = F.lit(math.sin(angle)) / F.cos(F.radians(lat))
    reach = F.when(ratio < 1, F.degrees(F.asin(ratio))).otherwise(F.lit(180.0))
    rows = F.sequence(_cell(lat - math.degrees(angle), width), _cell(lat + math.degrees(angle), width))
    first = _cell(lon - reach, width)
    columns = F.sequence(first, F.least(_cell(lon + reach, width), first + F.lit(around - 1)))
    return places.withColumn("cell_lat", F.explode(rows)).withColumn("cell_lon", F.explode(columns)).withColumn(
        "cell_lon", F.pmod("cell_lon", F.lit(around)))


def at_terminal(
    vehicles: DataFrame, endpoints: DataFrame, terminals: DataFrame, stops: DataFrame,
    radius_m: float = 300.0,
) -> DataFrame:
    """Vehicles at, or close to, an end of their trip.

    A trip without a timetable falls back to the ends of all the route's trips; a
    trip with one does not, even if its end stops are unknown. Both kinds of ends meet
    vehicles by equality only: of the stop, or of the grid cell, in which the distance decides.
    """
    ends = endpoints.select("trip_id", "first_stop_id", "last_stop_id", F.lit(True).alias("_known"))
    base = vehicles.select("vehicle", "trip_id", "route_id", "latitude", "longitude", "stop_id")
    base = base.join(ends, "trip_id", "left")
    places = stops.select(F.col("stop_id").alias("terminal"), "stop_lat", "stop_lon").filter(
        (F.col("stop_lat") != 0) & (F.col("stop_lon") != 0))
    near = haversine_m(F.col("latitude"), F.col("longitude"), F.col("stop_lat"), F.col("stop_lon")) < radius_m
    by_trip = base.filter("_known").select(
        "vehicle", "latitude", "longitude", "stop_id",
        F.explode(F.array("first_stop_id", "last_stop_id")).alias("terminal"),
    ).filter(F.col("terminal").isNotNull())
    at_own = by_trip.join(places, "terminal", "left").filter(
        F.coalesce(F.col("stop_id") == F.col("terminal"), F.lit(False)) | F.coalesce(near, F.lit(False)))
    width, around = _cells(radius_m)
    unknown = base.filter(F.col("_known").isNull())
    of_route = terminals.select("route_id", F.col("stop_id").alias("terminal")).distinct()
    at_stop = unknown.join(of_route, (unknown["route_id"] == of_route["route_id"]) & (unknown["stop_id"] == of_route["terminal"]), "left_semi")
    around_ends = terminal_cells(of_route.join(places, "terminal"), radius_m)
    celled = unknown.withColumn("cell_lat", _cell(F.col("latitude"), width)).withColumn(
        "cell_lon", F.pmod(_cell(F.col("longitude"), width), F.lit(around)))
    at_place = celled.join(around_ends, ["route_id", "cell_lat", "cell_lon"]).filter(near)
    return at_own.select("vehicle").unionByName(at_stop.select("vehicle")).unionByName(at_place.select("vehicle")).distinct()


def stuck_vehicles(
    positions: DataFrame, now: dt.datetime, endpoints: DataFrame, terminals: DataFrame,
    stops: DataFrame, routes: DataFrame, cfg: StuckConfig = StuckConfig(),
    whole_history: bool = False,
) -> DataFrame:
    """Alerts: still for at least the threshold, measured up to ``now``, not merely
    stopped at a stop all along, and not at a terminal."""
    held = seconds_between(instant(now), F.col("stuck_since"))
    streaks = stationary_streaks(positions, None if whole_history else now, cfg)
    stuck = streaks.filter(
        (held >= cfg.threshold_seconds) & ~F.col("only_stopped")
    )
    parked = at_terminal(stuck, endpoints, terminals, stops, cfg.terminal_radius_m)
    names = routes.select("route_id", "route_short_name")
    return (
        stuck.join(parked, "vehicle", "left_anti")
        .join(names, "route_id", "left")
        .join(stops.select("stop_id", "stop_name"), "stop_id", "left")
        .select(
            "vehicle_id", "vehicle_label", "route_id",
            F.coalesce("route_short_name", "route_id").alias("route_short_name"),
            "latitude", "longitude", "stop_id", "stop_name", "stuck_since",
            round1(held / 60).alias("minutes_stuck"),
        )
    )
