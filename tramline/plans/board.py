"""The live board: newest positions with delay, headway and labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT_COLOR, ON_TIME_SECONDS, SNAPSHOT_CYCLE_MINUTES
from tramline.functions import bands
from tramline.functions.numbers import round1
from tramline.operators.latest import latest_feed_delays, latest_positions

# Options a facet lists even when nothing matches them.
FACET_OPTIONS = {
    "mode": ["rail", "bus", "other"],
    "headway": ["under15", "to30", "to60", "over60", "unknown"],
    "punctuality": ["early", "on_time", "late", "very_late", "unknown"],
    "movement": ["stopped", "in_transit", "incoming", "unknown"],
}


def with_route(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Left join of the route's display fields with their defaults."""
    dims = routes.select(
        "route_id", "route_short_name", "route_long_name", "route_color", "route_type"
    )
    return df.join(dims, "route_id", "left").withColumns(
        {
            "route_short_name": F.coalesce("route_short_name", "route_id"),
            "route_long_name": F.coalesce("route_long_name", F.lit("")),
            "route_color": F.coalesce("route_color", F.lit(DEFAULT_COLOR)),
            "route_type": F.coalesce("route_type", F.lit("")),
        }
    )


def snapshot_headways(latest: DataFrame) -> DataFrame:
    """Headway per route from the vehicles in one snapshot; one vehicle gives 0."""
    counts = latest.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    minutes = F.when(
        F.col("n") >= 2, round1(F.lit(SNAPSHOT_CYCLE_MINUTES) / F.col("n"))
    ).otherwise(F.lit(0.0))
    return counts.select("route_id", minutes.alias("headway_minutes"))


def live_board(
    positions: DataFrame, updates: DataFrame, routes: DataFrame, stops: DataFrame,
    now: dt.datetime | None = None, route_id: str | None = None,
) -> DataFrame:
    """Vehicles with coordinates; headways count those without coordinates too."""
    latest = latest_positions(positions, now, route_id=route_id)
    rows = (
        latest.join(snapshot_headways(latest), "route_id", "left")
        .join(latest_feed_delays(updates, now), "trip_id", "left")
        .join(stops.select("stop_id", "stop_name"), "stop_id", "left")
    )
    rows = with_route(rows, routes).filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    return rows.withColumn("is_late", F.col("delay_seconds") > ON_TIME_SECONDS).withColumn(
        "current_status_label", bands.status_label(F.col("current_status"))
    )


def with_bands(board: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """Add the filter columns; ``stuck`` is the result of ``stuck_vehicles``."""
    out = board.withColumns(
        {
            "mode": bands.mode_of(F.col("route_type")),
            "vehicle_key": bands.vehicle_key(
                F.col("vehicle_label"), F.col("vehicle_id"), F.col("route_id"), F.col("trip_id")
            ),
            "headway_band": bands.headway_band(F.col("headway_minutes")),
            "occupancy_key": bands.occupancy_key(F.col("occupancy_status")),
            "punctuality_band": bands.punctuality_band(F.col("delay_seconds")),
            "movement_band": bands.movement_band(F.col("current_status")),
        }
    )
    if stuck is None:
        return out.withColumn("stuck", F.lit(False))
    names = stuck.select(F.explode(F.array("vehicle_label", "vehicle_id")).alias("name"))
    names = names.filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    by_label = names.select(F.col("name").alias("vehicle_label"), F.lit(True).alias("_by_label"))
    by_id = names.select(F.col("name").alias("vehicle_id"), F.lit(True).alias("_by_id"))
    return (
        out.join(by_label, "vehicle_label", "left")
        .join(by_id, "vehicle_id", "left")
        .withColumn("stuck", F.coalesce("_by_label", "_by_id", F.lit(False)))
        .drop("_by_label", "_by_id")
    )


def count_facets(df: DataFrame, facets: dict[str, Column], options: dict[str, list[str]]) -> DataFrame:
    """Flat (facet, value, n) counts of several columns in one pass over the rows."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("facet"), column.cast("string").alias("value"))
                for name, column in facets.items()
            ]
        )
    ).alias("p")
    counted = df.select(pairs).select("p.facet", "p.value", F.lit(1).alias("n"))
    listed = [(f, v, 0) for f, values in options.items() for v in values]
    if listed:
        zero = df.sparkSession.createDataFrame(listed, "facet string, value string, n int")
        counted = counted.unionByName(zero)
    return counted.groupBy("facet", "value").agg(F.sum("n").cast("long").alias("n"))


def board_facets(banded: DataFrame) -> DataFrame:
    """Option counts of the map filter, over the unfiltered board."""
    facets = {
        "mode": F.col("mode"),
        "route": F.col("route_id"),
        "headway": F.col("headway_band"),
        "occupancy": F.col("occupancy_key"),
        "punctuality": F.col("punctuality_band"),
        "movement": F.col("movement_band"),
        "vehicle": F.col("vehicle_key"),
        "stuck": F.when(F.col("stuck"), F.lit("stuck")),
    }
    return count_facets(banded, facets, FACET_OPTIONS).filter(F.col("value").isNotNull())


def active_routes(banded: DataFrame, query: str = "") -> DataFrame:
    """Routes on the board with their vehicles, one row per pair, in natural order.

    A text keeps the routes whose name, or any of whose vehicles, contains it.
    """
    pairs = banded.select(
        "route_id", "route_short_name", "route_long_name", "mode", "vehicle_key",
        F.coalesce("vehicle_label", "vehicle_key").alias("label"),
    ).distinct()
    text = query.lower().strip()
    if text:
        hit = F.lit(False)
        for name in ("route_short_name", "route_long_name", "label"):
            hit = hit | F.lower(name).contains(text)
        pairs = pairs.join(pairs.filter(hit).select("route_id").distinct(), "route_id", "left_semi")
    return pairs.orderBy(
        *bands.natural_key(F.col("route_short_name")), "route_id",
        *bands.natural_key(F.col("label")), "vehicle_key",
    )


def at_stop(board: DataFrame, stop_id: str) -> DataFrame:
    return board.filter(F.col("stop_id") == stop_id)
