"""Row filters shared by the reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import ROUTE_TYPE_NAMES
from tramline.functions import bands
from tramline.functions.times import day_bounds, instant



def split_csv(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def half_open(df: DataFrame, column: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """``low <= column < high``; a ``date`` column is narrowed too, to prune partitions."""
    rows = df.filter((F.col(column) >= instant(low)) & (F.col(column) < instant(high)))
    for part in ("date", "bucket_date"):
        if part in df.columns:
            rows = rows.filter(F.col(part).between(F.lit(low.date()), F.lit(high.date())))
    return rows


def closed(df: DataFrame, column: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
    rows = df.filter(F.col(column).between(instant(low), instant(high)))
    if "date" in df.columns:
        rows = rows.filter(F.col("date").between(F.lit(low.date()), F.lit(high.date())))
    return rows


def local_days(df: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of the local calendar days ``start`` to ``end``, both included."""
    low, high = day_bounds(start, end)
    return half_open(df, column, low, high)


def on_routes(df: DataFrame, routes: DataFrame | list[str] | None) -> DataFrame:
    """Keep the rows of the given routes; None keeps all.

    A list is what a request names; ids that come from data are a frame.
    """
    if routes is None:
        return df
    if isinstance(routes, DataFrame):
        return df.join(routes.select("route_id").distinct(), "route_id", "left_semi")
    return df.filter(F.col("route_id").isin(routes))


def route_scope(
    routes: DataFrame,
    route_id: str | None = None,
    route_ids: str | None = None,
    modes: str | None = None,
) -> DataFrame | None:
    """Route ids named singly, in a list, or through modes; None when nothing is named.

    Unknown modes are ignored. Modes that no route runs, with no ids beside them,
    restrict nothing.
    """
    named = set(split_csv(route_ids)) | ({route_id} if route_id else set())
    codes = {name: code for code, name in ROUTE_TYPE_NAMES.items()}
    wanted = [codes[m] for m in split_csv(modes) if m in codes]
    if not named and not wanted:
        return None
    spark = routes.sparkSession
    scope = spark.createDataFrame([(r,) for r in sorted(named)], "route_id string")
    if wanted:
        by_mode = routes.filter(F.trim("route_type").isin(wanted)).select("route_id")
        if not named and by_mode.isEmpty():
            return None
        scope = scope.union(by_mode)
    return scope.distinct()


def within_window(start: Column, end: Column, low: dt.datetime, high: dt.datetime, strict: bool) -> Column:
    """Trip window test. The loose form needs one end inside the window, so a trip
    running from before it to after it is not kept."""
    lo, hi = instant(low), instant(high)
    if strict:
        return (start >= lo) & (end <= hi)
    return start.between(lo, hi) | end.between(lo, hi)


@dataclass(frozen=True)
class TripFilter:
    """Groups are ANDed, values inside a group ORed, an empty group keeps all."""

    routes: list[str] = field(default_factory=list)
    modes: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    occupancy: list[str] = field(default_factory=list)
    duration: tuple[float | None, float | None] = (None, None)
    avg_delay: tuple[float | None, float | None] = (None, None)
    on_time: tuple[float | None, float | None] = (None, None)

    def apply(self, trips: DataFrame) -> DataFrame:
        lists = [
            (F.col("route_id"), self.routes),
            (F.col("mode"), self.modes),
            (F.coalesce("vehicle_label", F.lit("")), self.labels),
            (F.col("trip_status"), self.statuses),
            (bands.occupancy_key(F.col("last_occupancy_status")), self.occupancy),
        ]
        for column, wanted in lists:
            if wanted:
                trips = trips.filter(column.isin(wanted))
        ranges = [
            ("duration_minutes", self.duration),
            ("avg_delay_seconds", self.avg_delay),
            ("on_time_pct", self.on_time),
        ]
        for name, (low, high) in ranges:
            if low is not None:
                trips = trips.filter(F.col(name) >= low)
            if high is not None:
                trips = trips.filter(F.col(name) <= high)
        return trips


@dataclass(frozen=True)
class LiveFilter:
    """The same for vehicles on the live board."""

    modes: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)
    vehicles: list[str] = field(default_factory=list)
    headway: list[str] = field(default_factory=list)
    occupancy: list[str] = field(default_factory=list)
    punctuality: list[str] = field(default_factory=list)
    movement: list[str] = field(default_factory=list)
    stuck_only: bool = False

    def apply(self, banded: DataFrame) -> DataFrame:
        """``banded`` comes from ``board.with_bands``."""
        lists = [
            ("mode", self.modes),
            ("route_id", self.routes),
            ("vehicle_key", self.vehicles),
            ("headway_band", self.headway),
            ("occupancy_key", self.occupancy),
            ("punctuality_band", self.punctuality),
            ("movement_band", self.movement),
        ]
        for column, wanted in lists:
            if wanted:
                banded = banded.filter(F.col(column).isin(wanted))
        return banded.filter("stuck") if self.stuck_only else banded


def still_running(
    legs: DataFrame, live: DataFrame, now: dt.datetime, window_seconds: int = 90
) -> DataFrame:
    """Legs whose (label, trip) is on the live board and that reported just now."""
    recent = legs.filter(
        F.col("end_time") >= instant(now - dt.timedelta(seconds=window_seconds))
    )
    keys = live.select("vehicle_label", "trip_id").distinct()
    return recent.join(keys, ["vehicle_label", "trip_id"], "left_semi")
