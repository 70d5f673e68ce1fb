"""Punctuality, crowding, delivery, frequency and ridership reports.

Each report reads rollups and small dimensions and returns one DataFrame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import (
    CYCLE_MINUTES,
    DEFAULT_CYCLE_MINUTES,
    OCCUPANCY_COUNTERS,
    WEEKDAYS,
    ZONE,
)
from tramline.functions.bands import frequency_label
from tramline.functions.numbers import (
    capped_percent,
    mean,
    percent,
    population_sd,
    ratio,
    round1,
)
from tramline.functions.times import (
    day_bounds,
    five_minutes,
    instant,
    local_day,
    local_dow,
    local_hour,
)
from tramline.operators.filters import closed, half_open, local_days, on_routes
from tramline.operators.rollups import BAND_NAMES

# Display names of the delay bins.
BIN_LABELS = {
    "very_early": "Very early (>10m)",
    "early": "Early (5–10m)",
    "on_time": "On time (±5m)",
    "slightly_late": "Slightly late (5–10m)",
    "late": "Late (10–15m)",
    "very_late": "Very late (>15m)",
}


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def three_way() -> list[Column]:
    """Counts of the rollup's six bands folded into on time / late / early."""
    late = F.col("slightly_late") + F.col("late") + F.col("very_late")
    early = F.col("very_early") + F.col("early")
    return [
        total("on_time"),
        F.coalesce(F.sum(late), F.lit(0)).cast("long").alias("late"),
        F.coalesce(F.sum(early), F.lit(0)).cast("long").alias("early"),
        total("observations"),
        total("delay_sum"),
    ]


def banded() -> Column:
    return F.col("on_time") + F.col("late") + F.col("early")


def scoped(rollup: DataFrame, start: dt.date, end: dt.date, routes) -> DataFrame:
    return on_routes(local_days(rollup, "bucket", start, end), routes)


def with_route_names(df: DataFrame, routes: DataFrame | None, default_to_id: bool = True) -> DataFrame:
    """Left join of the route short name; unknown routes show their id."""
    if routes is None:
        return df
    named = df.join(routes.select("route_id", "route_short_name"), "route_id", "left")
    if default_to_id:
        named = named.withColumn("route_short_name", F.coalesce("route_short_name", "route_id"))
    return named


def ontime_by_route(
    rollup: DataFrame, start: dt.date, end: dt.date, routes=None, names: DataFrame | None = None
) -> DataFrame:
    """One row per route and one overall row (``route_id`` null, ``overall`` true).

    Route shares divide by the banded observations, the overall share by all of them.
    """
    out = (
        scoped(rollup, start, end, routes)
        .rollup("route_id")
        .agg(*three_way(), F.grouping("route_id").cast("int").alias("_all"))
    )
    overall = F.col("_all") == 1
    out = out.withColumn(
        "on_time_pct",
        F.when(overall, percent(F.col("on_time"), F.col("observations"))).otherwise(
            percent(F.col("on_time"), banded())
        ),
    ).withColumn("avg_delay_seconds", mean(F.col("delay_sum"), F.col("observations")))
    out = out.withColumn("overall", overall).drop("_all")
    return with_route_names(out, names)


def ontime_trend(
    rollup: DataFrame, start: dt.date, end: dt.date, routes=None, granularity: str = "day",
    zone: str = ZONE,
) -> DataFrame:
    """On-time share by UTC hour or local day."""
    t = F.col("bucket") if granularity == "hour" else local_day(F.col("bucket"), zone)
    return (
        scoped(rollup, start, end, routes)
        .groupBy(t.alias("t"))
        .agg(*three_way())
        .select(
            "t",
            percent(F.col("on_time"), banded()).alias("on_time_pct"),
            mean(F.col("delay_sum"), F.col("observations")).alias("avg_delay_seconds"),
            "observations",
        )
        .orderBy("t")
    )


def ontime_heatmap(
    rollup: DataFrame, start: dt.date, end: dt.date, routes=None, zone: str = ZONE
) -> DataFrame:
    """Local hour by day of week, Sunday = 0."""
    return (
        scoped(rollup, start, end, routes)
        .groupBy(
            local_dow(F.col("bucket"), zone).alias("dow"),
            local_hour(F.col("bucket"), zone).alias("hour"),
        )
        .agg(*three_way())
        .select(
            "dow",
            "hour",
            percent(F.col("on_time"), banded()).alias("on_time_pct"),
            mean(F.col("delay_sum"), F.col("observations")).alias("avg_delay_seconds"),
            "observations",
        )
    )


def delay_distribution(rollup: DataFrame, start: dt.date, end: dt.date, routes=None) -> DataFrame:
    """Six labelled bins with count and share, and the mean and deviation beside each."""
    sums = scoped(rollup, start, end, routes).agg(
        *[total(name) for name in BAND_NAMES],
        total("observations"),
        total("delay_sum"),
        F.coalesce(F.sum("delay_sumsq"), F.lit(0)).cast("double").alias("delay_sumsq"),
    )
    bins = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("bin"),
                    F.lit(key).alias("key"),
                    F.lit(BIN_LABELS[key]).alias("label"),
                    F.col(key).alias("count"),
                )
                for i, key in enumerate(BAND_NAMES)
            ]
        )
    )
    everything = sum((F.col(name) for name in BAND_NAMES[1:]), F.col(BAND_NAMES[0]))
    return sums.select(
        everything.alias("total"),
        mean(F.col("delay_sum"), F.col("observations")).alias("avg_delay_seconds"),
        population_sd(F.col("delay_sum"), F.col("delay_sumsq"), F.col("observations")).alias(
            "stddev_seconds"
        ),
        bins.alias("b"),
    ).select(
        "b.bin",
        "b.key",
        "b.label",
        "b.count",
        percent(F.col("b.count"), F.col("total")).alias("pct"),
        "total",
        "avg_delay_seconds",
        "stddev_seconds",
    )


def worst_stops(
    rollup: DataFrame, start: dt.date, end: dt.date, routes=None, limit: int = 15,
    min_observations: int = 20, stops: DataFrame | None = None,
) -> DataFrame:
    """Stops with the largest mean delay among those seen often enough."""
    ranked = (
        scoped(rollup, start, end, routes)
        .groupBy("stop_id")
        .agg(*[total(c) for c in ("on_time", "late", "observations", "delay_sum")])
        .filter(F.col("observations") >= min_observations)
        .withColumn("mean_delay", ratio(F.col("delay_sum"), F.col("observations")))
        .orderBy(F.desc("mean_delay"), "stop_id")
        .limit(limit)
    )
    out = ranked.select(
        "stop_id",
        "observations",
        "mean_delay",
        percent(F.col("on_time"), F.col("observations")).alias("on_time_pct"),
        round1(F.col("mean_delay")).alias("avg_delay_seconds"),
    )
    if stops is not None:
        out = out.join(stops.select("stop_id", "stop_name"), "stop_id", "left")
    return out


def day_counts(start: dt.date, end: dt.date) -> dict[str, int]:
    """How often each day of the week falls in a closed date range."""
    days = (end - start).days + 1
    first = start.weekday()
    return {
        name: days // 7 + (1 if (i - first) % 7 < days % 7 else 0)
        for i, name in enumerate(WEEKDAYS)
    }


def scheduled_trips(trips_per_dow: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Scheduled trips per route: trips of each weekday times how often it occurs."""
    counts = day_counts(start, end)
    terms = [F.coalesce(F.col(d), F.lit(0)) * F.lit(n) for d, n in counts.items()]
    return trips_per_dow.select(
        "route_id", sum(terms[1:], terms[0]).cast("long").alias("scheduled_trips")
    )


def service_delivery(
    activity: DataFrame, trips_per_dow: DataFrame, start: dt.date, end: dt.date, routes=None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Observed against scheduled trips per observed route, and an overall row."""
    observed = (
        scoped(activity, start, end, routes)
        .groupBy("route_id")
        .agg(F.count(F.lit(1)).alias("observed_trips"))
    )
    both = observed.join(scheduled_trips(trips_per_dow, start, end), "route_id", "left").fillna(
        0, ["scheduled_trips"]
    )
    out = (
        both.rollup("route_id")
        .agg(
            total("observed_trips"),
            total("scheduled_trips"),
            (F.grouping("route_id") == 1).alias("overall"),
        )
        .withColumn(
            "delivered_pct", capped_percent(F.col("observed_trips"), F.col("scheduled_trips"))
        )
    )
    return with_route_names(out, names).orderBy("delivered_pct", "route_id")


def least_delivered(delivery: DataFrame, limit: int = 20) -> DataFrame:
    """Routes with a schedule that delivered the least of it."""
    return (
        delivery.filter(~F.col("overall") & (F.col("scheduled_trips") > 0))
        .orderBy("delivered_pct", "route_id")
        .limit(limit)
    )


def best_on_time(by_route: DataFrame, limit: int = 20) -> DataFrame:
    return (
        by_route.filter(~F.col("overall"))
        .orderBy(F.desc("on_time_pct"), "route_id")
        .limit(limit)
    )


def scorecard(by_route: DataFrame, sort: str = "on_time_pct", ascending: bool = False) -> DataFrame:
    """The route table sorted by a measure; ties by route."""
    key = F.col(sort).asc() if ascending else F.col(sort).desc()
    return by_route.filter(~F.col("overall")).orderBy(key, "route_id")


def shortest_headways(frequency: DataFrame) -> DataFrame:
    """Routes with a known headway, shortest first, with their table label."""
    return (
        frequency.filter(F.col("avg_headway_minutes") > 0)
        .withColumn("label", frequency_label(F.col("avg_headway_minutes")))
        .orderBy("avg_headway_minutes", "route_id")
    )


def latest_ridership(ridership: DataFrame, routes=None) -> DataFrame:
    """One row: the latest month, its total and the month before it in the data."""
    months = on_routes(ridership, routes).groupBy("month").agg(F.sum("boardings").alias("total"))
    top = months.orderBy(F.desc("month")).limit(2)
    both = top.agg(F.max("month").alias("latest"), F.min("month").alias("earliest"), F.max_by("total", "month").alias("t"), F.min_by("total", "month").alias("p"))
    return both.select(
        F.col("latest").alias("latest_ridership_month"),
        F.col("t").cast("long").alias("latest_ridership_total"),
        F.when(F.col("earliest") < F.col("latest"), F.col("p").cast("long")).alias(
            "prev_ridership_total"
        ),
    )


def ridership_series(ridership: DataFrame, route_id: str | None = None, months: int = 24) -> DataFrame:
    """Boardings of the last months, oldest first."""
    rows = ridership if route_id is None else ridership.filter(F.col("route_id") == route_id)
    return (
        rows.groupBy("month")
        .agg(F.sum(F.coalesce("boardings", F.lit(0))).cast("long").alias("boardings"))
        .orderBy(F.desc("month"))
        .limit(months)
        .orderBy("month")
    )


def ridership_by_route(
    ridership: DataFrame, names: DataFrame | None = None, route_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Routes of the latest month, busiest first.

    A route only decides which month is the latest; all routes are listed.
    """
    rows = ridership if route_id is None else ridership.filter(F.col("route_id") == route_id)
    latest = rows.agg(F.max("month").alias("month"))
    out = (
        ridership.join(latest, "month", "left_semi")
        .select("route_id", "month", F.coalesce("boardings", F.lit(0)).cast("long").alias("boardings"))
    )
    out = with_route_names(out, names).orderBy(F.desc("boardings"), "route_id")
    return out if limit is None else out.limit(limit)


def overview(
    ontime: DataFrame, activity: DataFrame, trips_per_dow: DataFrame, ridership: DataFrame,
    start: dt.date, end: dt.date, routes=None,
) -> DataFrame:
    """Headline figures of a date range beside those of the same span before it."""
    low, high = day_bounds(start, end)
    before = low - (high - low)
    days = (end - start).days + 1
    prev_end = start - dt.timedelta(days=1)
    prev_start = prev_end - dt.timedelta(days=days - 1)
    now = F.col("bucket") >= instant(low)

    def split(name: str, value: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(now, value)), F.lit(0)).cast("long").alias(name),
            F.coalesce(F.sum(F.when(~now, value)), F.lit(0)).cast("long").alias(f"{name}_prev"),
        ]

    late = F.col("slightly_late") + F.col("late") + F.col("very_late")
    early = F.col("very_early") + F.col("early")
    punctuality = on_routes(half_open(ontime, "bucket", before, high), routes).agg(
        *split("on_time", F.col("on_time")),
        *split("banded", F.col("on_time") + late + early),
        *split("observations", F.col("observations")),
        *split("delay_sum", F.col("delay_sum")),
        F.coalesce(F.sum(F.when(now, F.col("delay_sumsq"))), F.lit(0)).cast("double").alias("delay_sumsq"),
        F.count_distinct(F.when(now, F.col("route_id"))).alias("routes_tracked"),
    )
    trips = on_routes(half_open(activity, "bucket", before, high), routes).agg(
        F.count_if(now).alias("observed_trips"), F.count_if(~now).alias("observed_trips_prev")
    )
    plan = on_routes(trips_per_dow, routes)
    parts = [punctuality, trips]
    for name, first, last in (
        ("scheduled_trips", start, end),
        ("scheduled_trips_prev", prev_start, prev_end),
    ):
        parts.append(
            scheduled_trips(plan, first, last).agg(
                F.coalesce(F.sum("scheduled_trips"), F.lit(0)).alias(name)
            )
        )
    parts.append(latest_ridership(ridership, routes))
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    row = wide.agg(*[F.max(c).alias(c) for c in wide.columns])
    out = [F.lit(days).alias("period_days")]
    for suffix in ("", "_prev"):
        out += [
            percent(F.col(f"on_time{suffix}"), F.col(f"banded{suffix}")).alias(f"on_time_pct{suffix}"),
            mean(F.col(f"delay_sum{suffix}"), F.col(f"observations{suffix}")).alias(
                f"avg_delay_seconds{suffix}"
            ),
            capped_percent(
                F.col(f"observed_trips{suffix}"), F.col(f"scheduled_trips{suffix}")
            ).alias(f"service_delivered_pct{suffix}"),
        ]
    return row.select(
        *out,
        population_sd(F.col("delay_sum"), F.col("delay_sumsq"), F.col("observations")).alias(
            "delay_stddev_seconds"
        ),
        "observed_trips",
        "scheduled_trips",
        "routes_tracked",
        F.col("observations").alias("total_observations"),
        "latest_ridership_month",
        "latest_ridership_total",
        "prev_ridership_total",
    )


def occupancy_totals(
    rollup: DataFrame, start: dt.date, end: dt.date, route_id: str | None = None,
    direction_trips: DataFrame | None = None,
) -> DataFrame:
    """Counters, three levels and the share standing over known samples."""
    names = [*OCCUPANCY_COUNTERS, "unknown", "samples"]
    sums = occupancy_rows(rollup, start, end, route_id, direction_trips).agg(
        *[total(n) for n in names]
    )
    low = F.col("empty") + F.col("many_seats")
    high = F.col("standing") + F.col("crushed") + F.col("full") + F.col("not_accepting")
    known = low + F.col("few_seats") + high
    return sums.select(
        "*",
        low.alias("low"),
        F.col("few_seats").alias("medium"),
        high.alias("high"),
        (known > 0).alias("reported"),
        F.when(known > 0, percent(high, known)).alias("standing_pct"),
    )


def occupancy_rows(
    rollup: DataFrame, start: dt.date, end: dt.date, route_id: str | None,
    direction_trips: DataFrame | None,
) -> DataFrame:
    rows = local_days(rollup, "bucket", start, end)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
        if direction_trips is not None:
            rows = rows.join(direction_trips.select("trip_id").distinct(), "trip_id", "left_semi")
    return rows


def occupancy_by_hour(
    rollup: DataFrame, start: dt.date, end: dt.date, route_id: str | None = None,
    direction_trips: DataFrame | None = None, zone: str = ZONE,
) -> DataFrame:
    """Counters per local hour; hours without a known status are left out.

    A direction without trips gives no rows, not the rows of both directions.
    """
    names = list(OCCUPANCY_COUNTERS)
    known = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return (
        occupancy_rows(rollup, start, end, route_id, direction_trips)
        .groupBy(local_hour(F.col("bucket"), zone).alias("hour"))
        .agg(*[total(n) for n in [*names, "unknown"]], F.sum("samples").cast("long").alias("total"))
        .filter(known > 0)
        .orderBy("hour")
    )


def occupancy_shares(by_hour: DataFrame) -> DataFrame:
    """Counters as a percentage of the hour's known samples."""
    names = list(OCCUPANCY_COUNTERS)
    known = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return by_hour.select("hour", *[percent(F.col(n), known).alias(n) for n in names])


def active_per_bucket(positions: DataFrame, since: dt.datetime | None = None, routes=None) -> DataFrame:
    """Distinct vehicles per route and five minutes; a vehicle without id counts by trip."""
    rows = positions if since is None else positions.filter(F.col("timestamp") >= instant(since))
    return (
        on_routes(rows, routes)
        .groupBy("route_id", five_minutes(F.col("timestamp")).alias("bucket"))
        .agg(F.count_distinct(F.coalesce("vehicle_id", "trip_id")).alias("vehicles"))
    )


def headway_now(per_bucket: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Headway from vehicle counts: round-trip minutes over vehicles on the road."""
    counts = per_bucket.groupBy("route_id").agg(
        F.sum("vehicles").alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.max("vehicles").alias("vehicle_count"),
        F.min("vehicles").alias("_min"),
    )
    cycle = F.lit(DEFAULT_CYCLE_MINUTES)
    if routes is not None:
        counts = counts.join(
            routes.select("route_id", "route_short_name", "route_type"), "route_id", "left"
        ).withColumn("route_short_name", F.coalesce("route_short_name", "route_id"))
        for code, minutes in CYCLE_MINUTES.items():
            cycle = F.when(F.col("route_type") == code, F.lit(minutes)).otherwise(cycle)
    enough = F.col("vehicle_count") >= 2
    figures = {
        "avg_headway_minutes": cycle / (F.col("_sum") / F.col("_n")),
        "min_headway_minutes": cycle / F.col("vehicle_count"),
        "max_headway_minutes": cycle / F.greatest(F.lit(1), F.col("_min")),
    }
    out = counts
    for name, value in figures.items():
        out = out.withColumn(name, F.when(enough, round1(value)).otherwise(F.lit(0.0)))
    return out.drop("_sum", "_n", "_min", "route_type")


def frequency(
    positions: DataFrame, now: dt.datetime, routes: DataFrame | None = None, scope=None,
    minutes: int = 30,
) -> DataFrame:
    """Current headway per route over the last half hour."""
    recent = closed(positions, "timestamp", now - dt.timedelta(minutes=minutes), now)
    return headway_now(active_per_bucket(recent, routes=scope), routes)


def schedule_frequency(summary: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Weekday routes with their trip counts and service span, by name."""
    out = summary.filter(F.col("weekday_trips") > 0)
    out = with_route_names(out, names)
    return out.orderBy("route_short_name" if names is not None else "route_id")


def route_headways(headways: DataFrame, route_id: str) -> DataFrame:
    """One route's 24 hours; hours without departures are null."""
    hours = headways.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    mine = headways.filter(F.col("route_id") == route_id).select("hour", "headway_minutes")
    return hours.join(mine, "hour", "left").orderBy("hour")
