"""Look-backs and silences as window aggregates, the same for stored rows and for streams.

A look-back of 60 seconds, five or thirty minutes is a sliding window: each row counts in
``size / slide`` windows, so the rows to aggregate grow by that factor and no row is kept. A
silence ends a session window. Both have state in a stream, which goes when the watermark has
passed a window's end; for stored rows the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIVE_MINUTES, HALF_HOUR, SILENCE = 300, 1800, 900


def _window(size: int, slide: int) -> Column:
    return F.window("timestamp", f"{size} seconds", f"{slide} seconds")


def active_in_window(
    positions: DataFrame, size: int = HALF_HOUR, slide: int = FIVE_MINUTES, lateness: str = "1 minute",
) -> DataFrame:
    """Per look-back and route: sightings of named trips, the first and the last of them."""
    rows = positions.filter(F.coalesce("trip_id", F.lit("")) != "").withWatermark("timestamp", lateness)
    return (
        rows.groupBy(_window(size, slide).alias("w"), "route_id")
        .agg(F.count(F.lit(1)).alias("sightings"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .select("route_id", F.col("w.start").alias("from_time"), F.col("w.end").alias("until"), "sightings", "first_seen", "last_seen")
    )


def latest_in_window(
    positions: DataFrame, size: int = FIVE_MINUTES, slide: int = 60, lateness: str = "1 minute",
) -> DataFrame:
    """Per look-back and vehicle: the newest position, as a live view at the window's end has it."""
    row = F.struct("id", "trip_id", "route_id", "latitude", "longitude", "timestamp")
    return (
        positions.withWatermark("timestamp", lateness)
        .groupBy(_window(size, slide).alias("w"), "vehicle_id")
        .agg(F.max_by(row, F.struct("timestamp", "id")).alias("r"))
        .select("vehicle_id", F.col("w.end").alias("until"), "r.*")
    )


def trip_sessions(positions: DataFrame, silence: int = SILENCE, lateness: str = "1 minute") -> DataFrame:
    """Runs of a trip's fixes without a silence longer than the given one."""
    rows = positions.filter(F.coalesce("trip_id", F.lit("")) != "").withWatermark("timestamp", lateness)
    return (
        rows.groupBy(F.session_window("timestamp", f"{silence} seconds").alias("w"), "trip_id")
        .agg(F.count(F.lit(1)).alias("fixes"), F.max("timestamp").alias("last_seen"))
        .select("trip_id", F.col("w.start").alias("first_seen"), "last_seen", "fixes")
    )
