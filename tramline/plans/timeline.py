"""Stop-by-stop timelines: the timetable of trips beside what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import ON_TIME_SECONDS, ZONE
from tramline.functions.numbers import round1
from tramline.functions.times import local_date, local_midnight, seconds_between, shift
from tramline.operators.nearest import nearest_label

EVENT = [
    "stop_id", "scheduled_time", "actual_time", "delay_seconds", "actual_lat", "actual_lon",
    "actual_bearing", "detection_method",
]


def observed_stops(events: DataFrame) -> DataFrame:
    """One event per (trip, stop sequence); of several the last one."""
    return (
        events.groupBy("trip_id", "stop_sequence")
        .agg(F.max_by(F.struct(*EVENT), F.struct("actual_time", "stop_id")).alias("ev"))
    )


def service_day_anchor(
    schedule: DataFrame, observed: DataFrame, positions: DataFrame, zone: str = ZONE
) -> DataFrame:
    """UTC instant of the service-day midnight per trip.

    Exact from the first observed stop with a scheduled offset; else the midnight
    of the track's local date, the day before or the day after, whichever puts the
    first stop nearest to the start of the track.
    """
    offsets = schedule.select("trip_id", "stop_sequence", "arrival_secs")
    exact = (
        observed.join(
            offsets.filter(F.col("arrival_secs").isNotNull()), ["trip_id", "stop_sequence"]
        )
        .groupBy("trip_id")
        .agg(
            F.min_by(
                shift(F.col("ev.scheduled_time"), -F.col("arrival_secs")), "stop_sequence"
            ).alias("exact")
        )
    )
    first = offsets.groupBy("trip_id").agg(
        F.min_by("arrival_secs", "stop_sequence").alias("first_secs")
    )
    track = positions.groupBy("trip_id").agg(F.min("timestamp").alias("track_start"))
    day = local_date(F.col("track_start"), zone)
    options = []
    for rank, days in enumerate((0, -1, 1)):
        midnight = local_midnight(F.date_add(day, days), zone)
        gap = F.abs(seconds_between(shift(midnight, F.col("first_secs")), F.col("track_start")))
        options.append(F.struct(gap.alias("gap"), F.lit(rank).alias("rank"), midnight.alias("at")))
    guess = F.when(
        F.col("first_secs").isNotNull() & F.col("track_start").isNotNull(),
        F.array_min(F.array(*options))["at"],
    )
    return (
        first.join(track, "trip_id", "left")
        .join(exact, "trip_id", "left")
        .select("trip_id", F.coalesce("exact", guess).alias("anchor"))
    )


def trip_timeline(
    schedule: DataFrame, events: DataFrame, positions: DataFrame, origins: DataFrame,
    stops: DataFrame, zone: str = ZONE, block_seconds: int = 3600,
) -> DataFrame:
    """All scheduled stops of the trips in ``positions`` and any observed stop the
    timetable lacks, with scheduled and actual time and the occupancy on arrival.

    ``schedule`` is ``timetable.stop_list``, ``origins`` has (trip_id, stop_sequence).
    """
    ridden = positions.select("trip_id").filter(F.col("trip_id").isNotNull()).distinct()
    plan = schedule.join(ridden, "trip_id", "left_semi").withColumn("scheduled", F.lit(True))
    seen = observed_stops(events.join(ridden, "trip_id", "left_semi"))
    anchors = service_day_anchor(plan, seen, positions, zone)
    occupied = nearest_label(
        seen.select("trip_id", "stop_sequence", F.col("ev.actual_time").alias("at")),
        positions.filter(F.col("trip_id").isNotNull()),
        ["trip_id"], "at", ["stop_sequence"], "occupancy_status", block_seconds,
    ).drop("at")
    seen = seen.join(occupied, ["trip_id", "stop_sequence"], "left")
    first = origins.select(
        "trip_id", F.col("stop_sequence").alias("origin_sequence")
    )
    unplanned = stops.select(
        F.col("stop_id").alias("_stop"), F.col("stop_name").alias("_name"),
        F.col("stop_lat").alias("_lat"), F.col("stop_lon").alias("_lon"),
    )
    both = (
        plan.join(seen, ["trip_id", "stop_sequence"], "full_outer")
        .join(anchors, "trip_id", "left")
        .join(first, "trip_id", "left")
        .join(unplanned, F.col("ev.stop_id") == F.col("_stop"), "left")
    )
    planned, hit = F.coalesce("scheduled", F.lit(False)), F.col("ev").isNotNull()

    def either(name: str, other: Column) -> Column:
        return F.when(planned, F.col(name)).otherwise(other).alias(name)

    return both.select(
        "trip_id",
        "stop_sequence",
        either("stop_id", F.col("ev.stop_id")),
        either("stop_name", F.col("_name")),
        either("stop_lat", F.col("_lat")),
        either("stop_lon", F.col("_lon")),
        either("stop_headsign", F.lit(None).cast("string")),
        either("is_timepoint", F.lit(True)),
        either("pickup_type", F.lit("0")),
        either("drop_off_type", F.lit("0")),
        F.coalesce(
            "ev.scheduled_time", shift(F.col("anchor"), F.col("arrival_secs"))
        ).alias("scheduled_time"),
        hit.alias("observed"),
        F.when(
            hit,
            F.when(F.col("stop_sequence") == F.col("origin_sequence"), "departure").otherwise("arrival"),
        ).alias("event_type"),
        *[F.col(f"ev.{c}").alias(c) for c in EVENT if c not in ("stop_id", "scheduled_time")],
        "occupancy_status",
    )


def timeline_totals(timeline: DataFrame) -> DataFrame:
    """Stop counts, mean delay and on-time share per trip."""
    delay = F.when(F.col("observed"), F.col("delay_seconds"))
    known = F.count(delay)
    on_time = F.count_if(F.abs(delay) <= ON_TIME_SECONDS)
    return timeline.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("scheduled_stop_count"),
        F.count_if("observed").alias("observed_stop_count"),
        F.avg(delay).alias("avg_delay_seconds"),
        F.when(known > 0, round1(on_time / known * 100)).alias("on_time_pct"),
    )


def track(positions: DataFrame) -> DataFrame:
    """Points of the trips in time order, rows without coordinates left out."""
    return (
        positions.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(
            "trip_id", "latitude", "longitude", "bearing", "timestamp", "current_status",
            "occupancy_status",
        )
        .orderBy("timestamp")
    )


def vehicle_leg(positions: DataFrame, vehicle_label: str, trip_id: str | None = None) -> DataFrame:
    """Positions of one vehicle; without a trip, those of its latest one."""
    mine = positions.filter(F.col("vehicle_label") == vehicle_label)
    if trip_id is not None:
        return mine.filter(F.col("trip_id") == trip_id)
    last = mine.agg(F.max_by("trip_id", F.struct("timestamp", "id")).alias("trip_id"))
    return mine.join(last, "trip_id", "left_semi")
