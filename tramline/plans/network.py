"""Route and stop look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT_COLOR, RAIL_TYPES
from tramline.functions.bands import type_name


def search_stops(directory: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Stops whose name contains the text: prefix matches, then rail, then by name."""
    text = query.lower().strip()
    name = F.lower("stop_name")
    return (
        directory.filter(name.contains(text))
        .orderBy(
            F.when(name.startswith(text), 0).otherwise(1),
            F.when(F.col("is_rail"), 0).otherwise(1),
            name,
            "stop_id",
        )
        .limit(limit)
    )


def with_serving_routes(stops: DataFrame, serving: DataFrame) -> DataFrame:
    """One row per stop and serving route; stops without a route keep one row."""
    return stops.join(serving, "stop_id", "left")


def route_list(routes: DataFrame) -> DataFrame:
    return routes.select(
        "route_id",
        F.col("route_short_name").alias("short_name"),
        F.col("route_long_name").alias("long_name"),
        "route_type",
        type_name(F.col("route_type")).alias("type_name"),
        F.coalesce("route_color", F.lit(DEFAULT_COLOR)).alias("color"),
        "agency_id",
    )


def route_detail(routes: DataFrame, route_id: str) -> DataFrame:
    return route_list(routes).filter(F.col("route_id") == route_id)


def ordered_route_stops(route_stops: DataFrame, route_id: str) -> DataFrame:
    return route_stops.filter(F.col("route_id") == route_id).orderBy("stop_sequence", "stop_id")


def rail_only(shapes: DataFrame) -> DataFrame:
    return shapes.filter(F.col("route_type").isin(RAIL_TYPES))
