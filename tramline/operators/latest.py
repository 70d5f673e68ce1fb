"""Newest row per key, as aggregates so that hot keys combine before the shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.functions.times import instant, micros, shift
from tramline.operators.filters import closed

LAST_SEQUENCE = 2_147_483_647


def newest(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The last row of each key in ``order`` (unique); null keys form one group."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def latest_positions(
    positions: DataFrame, now: dt.datetime | None = None, seconds: int = 60,
    route_id: str | None = None,
) -> DataFrame:
    """Newest snapshot per vehicle (vehicle id, else trip id) of the last minute."""
    rows = positions
    if now is not None:
        rows = closed(rows, "timestamp", now - dt.timedelta(seconds=seconds), now)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    return newest(rows, F.coalesce("vehicle_id", "trip_id"), ["timestamp", "id"])


def latest_feed_delays(
    updates: DataFrame, now: dt.datetime | None = None, seconds: int = 300
) -> DataFrame:
    """Delay per trip from its newest update: stops with a delay first, then the
    earliest stop. Trips whose pick has no delay are left out."""
    rows = updates.filter(F.col("trip_id").isNotNull())
    if now is not None:
        rows = closed(rows, "timestamp", now - dt.timedelta(seconds=seconds), now)
    rank = F.struct(
        (-micros(F.col("timestamp"))).alias("a"),
        F.col("arrival_delay").isNull().cast("int").alias("b"),
        F.coalesce("stop_sequence", F.lit(LAST_SEQUENCE)).alias("c"),
        F.col("id").alias("d"),
    )
    return (
        rows.groupBy("trip_id")
        .agg(F.min_by("arrival_delay", rank).alias("delay_seconds"))
        .filter(F.col("delay_seconds").isNotNull())
    )


def latest_known_delays(
    updates: DataFrame, low: dt.datetime, high: dt.datetime, trips: DataFrame | None = None
) -> DataFrame:
    """Newest non-null delay per trip in a closed time span, for the given trips."""
    rows = closed(updates, "timestamp", low, high).filter(F.col("arrival_delay").isNotNull())
    if trips is not None:
        ids = trips.select("trip_id").filter(F.col("trip_id").isNotNull()).distinct()
        rows = rows.join(ids, "trip_id", "left_semi")
    return _newest_delay(rows)


def page_known_delays(
    updates: DataFrame, page: DataFrame, first: str, last: str, margin: dt.timedelta,
    low: dt.datetime, high: dt.datetime,
) -> DataFrame:
    """Newest non-null delay of each trip on a page, from the span the page covers.

    The span goes from the page's earliest ``first`` to its latest ``last``, widened by
    ``margin`` and clamped to ``low`` and ``high``: trip ids recur every day, and another
    day's delay is not this trip's. When all rows have a route, only updates of the
    page's routes count. The windows over a page see its rows only; whether its keys are
    broadcast is left to the planner, which knows their size.
    """
    rows = W.partitionBy(F.lit(0))
    routed = F.coalesce(F.col("route_id"), F.lit("")) != ""
    keys = page.select(
        F.col("trip_id").alias("k_trip"),
        F.greatest(shift(F.min(first).over(rows), -margin.total_seconds()), instant(low)).alias("k_low"),
        F.least(shift(F.max(last).over(rows), margin.total_seconds()), instant(high)).alias("k_high"),
        F.collect_set("route_id").over(rows).alias("k_routes"),
        F.min(routed).over(rows).alias("k_routed"),
    ).filter(F.coalesce(F.col("k_trip"), F.lit("")) != "").dropDuplicates(["k_trip"])
    known = closed(updates, "timestamp", low, high).filter(F.col("arrival_delay").isNotNull())
    return _newest_delay(known.join(
        keys,
        (F.col("trip_id") == F.col("k_trip")) & F.col("timestamp").between(F.col("k_low"), F.col("k_high"))
        & (~F.col("k_routed") | F.expr("array_contains(k_routes, route_id)"))))


def _newest_delay(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trip_id").agg(
        F.max_by("arrival_delay", F.struct("timestamp", "id")).alias("last_delay_seconds")
    )


def dedupe_poll(rows: DataFrame, poll: str = "timestamp", order: str = "id") -> DataFrame:
    """Within one poll keep the first row per vehicle and place; time is not compared."""
    who = F.coalesce("vehicle_id", "trip_id", "route_id")
    row = F.struct(*rows.columns)
    return (
        rows.groupBy(F.col(poll).alias("_poll"), who.alias("_who"),
                     F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
        .agg(F.min_by(row, order).alias("r"))
        .select("r.*")
    )
