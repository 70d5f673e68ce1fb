"""Decoded feed entities as flat rows, and the per-route summary of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.bands import occupancy_key, type_name


def vehicle_positions(entities: DataFrame) -> DataFrame:
    """One row per vehicle entity with a route. A missing part gives nulls, a missing
    occupancy 'UNKNOWN'; the time is that of the poll, not the vehicle's clock."""
    v = "vehicle"
    return entities.filter(F.coalesce(f"{v}.trip.route_id", F.lit("")) != "").select(
        F.xxhash64("poll_time", "entity_id").alias("id"),
        F.col(f"{v}.trip.trip_id").alias("trip_id"),
        F.col(f"{v}.trip.route_id").alias("route_id"),
        F.col(f"{v}.vehicle.id").alias("vehicle_id"),
        F.col(f"{v}.vehicle.label").alias("vehicle_label"),
        F.col(f"{v}.position.latitude").alias("latitude"),
        F.col(f"{v}.position.longitude").alias("longitude"),
        F.col(f"{v}.position.bearing").alias("bearing"),
        F.col(f"{v}.current_stop_sequence").alias("current_stop_sequence"),
        F.col(f"{v}.current_status").alias("current_status"),
        F.col(f"{v}.stop_id").alias("stop_id"),
        occupancy_key(F.col(f"{v}.occupancy_status")).alias("occupancy_status"),
        F.col("poll_time").alias("timestamp"),
    )


def trip_updates(entities: DataFrame) -> DataFrame:
    """One row per stop-time update. Sequence 0 and an empty stop are null, an unset
    delay inside a given arrival is 0, the feed's time falls back to the poll's."""
    t = "trip_update"
    rows = entities.filter(F.coalesce(f"{t}.trip.route_id", F.lit("")) != "").select(
        "entity_id", "poll_time", F.col(f"{t}.trip").alias("trip"),
        F.nullif(F.col(f"{t}.timestamp"), F.lit(0)).alias("feed_time"),
        F.posexplode(f"{t}.stop_time_update").alias("place", "stop"),
    )

    def delay(part: str):
        return F.when(F.col(part).isNotNull(), F.coalesce(f"{part}.delay", F.lit(0)))

    return rows.select(
        F.xxhash64("poll_time", "entity_id", "place").alias("id"),
        F.col("trip.trip_id").alias("trip_id"),
        F.col("trip.route_id").alias("route_id"),
        F.nullif(F.col("stop.stop_id"), F.lit("")).alias("stop_id"),
        F.nullif(F.col("stop.stop_sequence"), F.lit(0)).alias("stop_sequence"),
        delay("stop.arrival").alias("arrival_delay"),
        delay("stop.departure").alias("departure_delay"),
        F.nullif(F.col("stop.arrival.time"), F.lit(0)).alias("arrival_time"),
        F.nullif(F.col("stop.departure.time"), F.lit(0)).alias("departure_time"),
        F.coalesce(F.timestamp_seconds("feed_time"), F.col("poll_time")).alias("timestamp"),
    )


def with_mode(vehicles: DataFrame, routes: DataFrame) -> DataFrame:
    """Vehicles with route fields and fine mode name; unknown routes are 'other'."""
    dims = routes.select("route_id", "route_short_name", "route_long_name", "route_type")
    return vehicles.join(dims, "route_id", "left").withColumn(
        "mode", F.coalesce(type_name(F.col("route_type")), F.lit("other"))
    )


def route_summary(vehicles: DataFrame, routes: DataFrame) -> DataFrame:
    """Vehicles per mode and route with a count per occupancy status.

    The map holds one entry per status name, so it stays small on any route.
    """
    counts = with_mode(vehicles, routes).groupBy(
        "mode", "route_id", "route_short_name", occupancy_key(F.col("occupancy_status")).alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("status", "n")))
    return counts.groupBy("mode", "route_id", "route_short_name").agg(
        F.sum("n").alias("total_vehicles"), F.map_from_entries(pairs).alias("occupancy_levels")
    )
