"""Stored summaries of the fact tables: definitions, building, refreshing, reading."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import OCCUPANCY_COUNTERS
from tramline.functions.times import instant
from tramline.session import stored


@dataclass(frozen=True)
class Band:
    """Delay interval in seconds; an open end is None."""

    name: str
    above: int | None
    above_closed: bool
    below: int | None
    below_closed: bool

    def holds(self, delay: Column) -> Column:
        test = F.lit(True)
        if self.above is not None:
            test = (delay >= self.above) if self.above_closed else (delay > self.above)
        if self.below is not None:
            test = test & ((delay <= self.below) if self.below_closed else (delay < self.below))
        return test & delay.isNotNull()


def six_bands(cuts: tuple[int, int, int, int, int]) -> list[Band]:
    """Six bands from five cuts; the on-time band owns both of its ends."""
    very_early, early, on_time, slightly, late = cuts
    return [
        Band("very_early", None, False, very_early, False),
        Band("early", very_early, True, early, False),
        Band("on_time", early, True, on_time, True),
        Band("slightly_late", on_time, False, slightly, True),
        Band("late", slightly, False, late, True),
        Band("very_late", late, False, None, False),
    ]


# Delay cuts in seconds of each threshold profile.
PROFILES = {
    "five_minutes": six_bands((-600, -300, 300, 600, 900)),
    "two_minutes": six_bands((-300, -120, 120, 300, 600)),
    "feed_delay": six_bands((-300, -60, 300, 600, 1200)),
    "three_way": [
        Band("late", 300, False, None, False),
        Band("early", None, False, -60, False),
        Band("on_time", -60, True, 300, True),
    ],
}
BAND_NAMES = [band.name for band in PROFILES["five_minutes"]]


def bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).alias("bucket")


def ontime_hourly(
    events: DataFrame, delay: str = "delay_seconds", ts: str = "timestamp",
    profile: str = "five_minutes",
) -> DataFrame:
    """Band counts, count, sum and sum of squares of delays per route and UTC hour."""
    d = F.col(delay)
    squares = [] if profile == "three_way" else [
        F.sum(d.cast("long") * d.cast("long")).alias("delay_sumsq")
    ]
    return events.groupBy("route_id", bucket(ts, "hour")).agg(
        *[F.count_if(band.holds(d)).alias(band.name) for band in PROFILES[profile]],
        F.count(d).alias("observations"),
        F.sum(d.cast("long")).alias("delay_sum"),
        *squares,
    )


def stop_delay_daily(
    events: DataFrame, delay: str = "delay_seconds", ts: str = "timestamp",
    profile: str = "five_minutes",
) -> DataFrame:
    """Late and on-time counts and the delay sum per route, stop and UTC day."""
    d = F.col(delay)
    on_time = next(band for band in PROFILES[profile] if band.name == "on_time")
    if profile in ("feed_delay", "three_way"):
        events = events.filter(F.col("stop_id").isNotNull())
    return events.groupBy("route_id", "stop_id", bucket(ts, "day")).agg(
        F.count_if(d > on_time.below).alias("late"),
        F.count_if(on_time.holds(d)).alias("on_time"),
        F.count(d).alias("observations"),
        F.sum(d.cast("long")).alias("delay_sum"),
    )


def trip_activity_daily(positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per route, trip and UTC day; counting its rows counts distinct trips."""
    return (
        positions.filter(F.col("trip_id").isNotNull())
        .groupBy("route_id", "trip_id", bucket(ts, "day"))
        .agg(F.count(F.lit(1)).alias("observations"))
    )


def _unknown(occ: Column) -> Column:
    return occ.isNull() | (occ == "UNKNOWN")


def occupancy_hourly(positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """A counter per occupancy status per route, trip and UTC hour."""
    occ = F.col("occupancy_status")
    return (
        positions.filter(F.col("trip_id").isNotNull())
        .groupBy("route_id", "trip_id", bucket(ts, "hour"))
        .agg(
            *[F.count_if(occ == value).alias(name) for name, value in OCCUPANCY_COUNTERS.items()],
            F.count_if(_unknown(occ)).alias("unknown"),
            F.count(F.lit(1)).alias("samples"),
        )
    )


def occupancy_levels_hourly(positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The coarser low / medium / high counters per route and UTC hour."""
    occ = F.col("occupancy_status")
    names = OCCUPANCY_COUNTERS
    levels = {
        "low": ["empty", "many_seats"],
        "medium": ["few_seats"],
        "high": ["standing", "crushed", "full", "not_accepting"],
    }
    return positions.groupBy("route_id", bucket(ts, "hour")).agg(
        *[
            F.count_if(occ.isin([names[m] for m in members])).alias(level)
            for level, members in levels.items()
        ],
        F.count_if(_unknown(occ)).alias("unknown"),
        F.count(F.lit(1)).alias("samples"),
    )


@dataclass(frozen=True)
class RollupSpec:
    """A rollup, the width of its buckets and the span a refresh re-reads."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    unit: str
    start_offset: dt.timedelta
    end_offset: dt.timedelta = dt.timedelta(hours=1)


ROLLUPS = {
    spec.name: spec
    for spec in (
        RollupSpec("trip_ontime_hourly", ontime_hourly, "hour", dt.timedelta(days=3)),
        RollupSpec("stop_delay_daily", stop_delay_daily, "day", dt.timedelta(days=7)),
        RollupSpec("trip_activity_daily", trip_activity_daily, "day", dt.timedelta(days=7)),
        RollupSpec("occupancy_status_hourly", occupancy_hourly, "hour", dt.timedelta(days=3)),
    )
}


def floor_to(moment: dt.datetime, unit: str) -> dt.datetime:
    if unit == "day":
        return moment.replace(hour=0, minute=0, second=0, microsecond=0)
    return moment.replace(minute=0, second=0, microsecond=0)


def since(raw: DataFrame, moment: dt.datetime, ts: str = "timestamp") -> DataFrame:
    """Rows from an instant on; the day predicate prunes day partitions."""
    rows = raw.filter(F.col(ts) >= instant(moment))
    if "date" in raw.columns:
        rows = rows.filter(F.col("date") >= F.lit(moment.date()))
    return rows


def build_rollup(
    raw: DataFrame, spec: RollupSpec, now: dt.datetime | None = None, backfill_days: int | None = 90
) -> DataFrame:
    """The rollup over the recent history, or over all of it without ``backfill_days``."""
    if now is not None and backfill_days is not None:
        raw = since(raw, floor_to(now - dt.timedelta(days=backfill_days), spec.unit))
    return spec.build(raw)


def by_bucket_day(rollup: DataFrame) -> DataFrame:
    """Dealt out by bucket day; adaptive execution splits large days and merges small ones."""
    return (
        rollup.withColumn("bucket_date", F.to_date("bucket"))
        .hint("rebalance", "bucket_date")
        .sortWithinPartitions("bucket_date", "route_id", "bucket")
    )


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Store a rollup by bucket day, so a refresh replaces whole days."""
    by_bucket_day(rollup).write.mode("overwrite").partitionBy("bucket_date").parquet(path)


def refresh_rollup(raw: DataFrame, spec: RollupSpec, path: str, now: dt.datetime) -> None:
    """Recompute the buckets of the refresh span and replace them.

    Whole bucket days are rebuilt, from the day the span starts in to the last
    complete bucket before ``now - end_offset``; buckets after that stay out and
    are answered from the raw rows (``with_live_tail``). Days of the span that have
    no raw rows any more lose their buckets.
    """
    first = floor_to(now - spec.start_offset, "day")
    last = floor_to(now - spec.end_offset, spec.unit)
    rows = since(raw, first).filter(F.col("timestamp") < instant(last))
    fresh = stored(spec.build(rows), "fresh")   # written and asked for its days: the same rows
    (
        by_bucket_day(fresh).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date")
        .parquet(path)
    )
    spark = raw.sparkSession
    filled = {r[0] for r in fresh.select(F.to_date("bucket")).distinct().collect()}   # days of the span
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    day = first.date()
    while day <= (last - dt.timedelta(microseconds=1)).date():
        old = spark._jvm.org.apache.hadoop.fs.Path(root, f"bucket_date={day.isoformat()}")
        if day not in filled and files.exists(old):
            files.delete(old, True)
        day += dt.timedelta(days=1)


def with_live_tail(
    kept: DataFrame, raw: DataFrame, spec: RollupSpec, watermark: dt.datetime
) -> DataFrame:
    """Stored buckets before the watermark, fresh ones from the raw rows after it.

    The watermark is moved back to a bucket start so no bucket is split.
    """
    edge = floor_to(watermark, spec.unit)
    old = kept.filter(F.col("bucket") < instant(edge))
    if "bucket_date" in kept.columns:
        old = old.filter(F.col("bucket_date") <= F.lit(edge.date())).drop("bucket_date")
    return old.unionByName(spec.build(since(raw, edge)))


def merge_rollups(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the counters of rollup rows into coarser groups."""
    skip = {"route_id", "stop_id", "trip_id", "bucket", "bucket_date", *keys}
    return rollup.groupBy(*keys).agg(
        *[F.sum(c).cast("long").alias(c) for c in rollup.columns if c not in skip]
    )
