"""Exports, layouts, retention and the guarded rebuild."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.times import instant
from tramline.operators.filters import closed

# Columns of the position export, in order.
EXPORT_COLUMNS = [
    "vehicle_id", "vehicle_label", "trip_id", "route_id", "latitude", "longitude", "bearing",
    "current_stop_sequence", "current_status", "stop_id", "occupancy_status", "timestamp",
]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def export_rows(
    positions: DataFrame, start: dt.datetime, end: dt.datetime, route_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Positions of a time span, oldest first; ``limit`` is a request's page size, if it has one."""
    rows = closed(positions, "timestamp", start, end)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    rows = rows.orderBy("timestamp", "id") if "id" in rows.columns else rows.orderBy("timestamp")
    out = rows if limit is None else rows.limit(limit)
    return out.select(*EXPORT_COLUMNS)


def iso_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", F.date_format("timestamp", ISO))


def write_csv(rows: DataFrame, path: str) -> None:
    iso_text(rows).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, so every line has all the columns."""
    iso_text(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_mode(vehicles: DataFrame, path: str) -> None:
    """One folder of JSON per transit mode; modes without vehicles have none."""
    vehicles.write.mode("overwrite").partitionBy("mode").json(path)


def write_cold(facts: DataFrame, path: str, ts: str = "timestamp") -> None:
    """By day, sorted by route and newest first, so row groups can be skipped by route.

    Adaptive execution splits a large day over several files and merges small days.
    """
    (
        facts.withColumn("date", F.to_date(ts))
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "route_id", F.desc(ts))
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(path)
    )


def retained(facts: DataFrame, now: dt.datetime, days: int = 365, ts: str = "timestamp") -> DataFrame:
    """Facts without what is older than the retention; prunes day partitions."""
    edge = now - dt.timedelta(days=days)
    rows = facts.filter(F.col(ts) >= instant(edge))
    return rows.filter(F.col("date") >= F.lit(edge.date())) if "date" in facts.columns else rows


class RebuildRefused(ValueError):
    """A rebuild that would lose history."""


def rebuild_guard(staged: DataFrame, live: DataFrame, ts: str = "timestamp") -> tuple[int, dt.datetime | None, int]:
    """Rows staged, their newest time, and live rows up to that time."""
    # Times travel as text: the session's zone must not be applied twice.
    rows, newest = staged.agg(F.count(F.lit(1)), F.max(ts).cast("string")).first()
    if not rows:
        return 0, None, 0
    moment = dt.datetime.fromisoformat(newest).replace(tzinfo=dt.timezone.utc)
    return rows, moment, live.filter(F.col(ts) <= instant(moment)).count()


def rebuild_events(
    staged: DataFrame, live: DataFrame, root: str, force: bool = False, ts: str = "timestamp"
) -> str:
    """Replace the live events up to the newest staged one and return the new version.

    The staged rows are written to the version's folder first, once, and judged there.
    Refuses an empty result, and one with less than half of the rows it replaces
    unless forced; the folder then stays unnamed. Later live rows are added. The version
    is complete before it is named; readers take the last name (``current_events``).
    """
    spark = staged.sparkSession
    path = f"{root}/version={uuid.uuid4().hex}"
    staged.write.parquet(path)
    written = spark.read.schema(staged.schema).parquet(path)
    rows, newest, before = rebuild_guard(written, live, ts)
    if rows == 0:
        raise RebuildRefused("the rebuild produced no events")
    if before and rows * 2 < before and not force:
        raise RebuildRefused(f"the rebuild produced {rows} events where {before} are stored")
    live.filter(F.col(ts) > instant(newest)).select(*staged.columns).write.mode("append").parquet(path)
    named = spark.createDataFrame([(path, time.time_ns())], "path string, named_at bigint")
    named.coalesce(1).write.mode("append").json(f"{root}/current")
    return path


def current_events(spark: SparkSession, root: str) -> DataFrame:
    """The version named last."""
    names = spark.read.schema("path string, named_at bigint").json(f"{root}/current")
    return spark.read.parquet(names.agg(F.max_by("path", "named_at")).first()[0])
