"""Tables derived from the timetable: timepoints, ends, terminals, counts, headways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import DEFAULT_COLOR, WEEKDAYS
from tramline.functions.geo import haversine_m
from tramline.functions.numbers import round1
from tramline.functions.times import hour_minute
from tramline.operators.blocks import by_merge, range_block

MIN_GAP_M = 150.0
SEQUENCE_BLOCK = 1000


def reading_order(df: DataFrame, fallback: str) -> Column:
    """Place in the files where known, else a column that at least fixes ties."""
    return F.col("line") if "line" in df.columns else F.col(fallback)


def origin_departures(stop_times: DataFrame) -> DataFrame:
    """Departure at each trip's lowest stop sequence that has a time."""
    order = F.struct("stop_sequence", reading_order(stop_times, "departure_secs"))
    return (
        stop_times.filter(F.col("departure_secs").isNotNull())
        .groupBy("trip_id")
        .agg(F.min_by("departure_secs", order).alias("departure_secs"))
    )


def timepoints(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Timepoint rows whose stop has coordinates."""
    placed = stops.filter((F.col("stop_lat") != 0) & (F.col("stop_lon") != 0)).select(
        "stop_id", "stop_lat", "stop_lon"
    )
    return (
        stop_times.filter(F.col("is_timepoint") & F.col("arrival_secs").isNotNull())
        .select("trip_id", "stop_sequence", "stop_id", "arrival_secs")
        .join(placed, "stop_id")
    )


def stop_list(stop_times: DataFrame, stops: DataFrame, trip_id: str | None = None) -> DataFrame:
    """Every scheduled stop, of one trip or of all, with its name where known."""
    rows = stop_times.filter(F.col("stop_id").isNotNull())
    if trip_id is not None:
        rows = rows.filter(F.col("trip_id") == trip_id)
    named = stops.select(
        "stop_id", F.nullif("stop_name", F.lit("")).alias("stop_name"), "stop_lat", "stop_lon"
    )
    out = rows.join(named, "stop_id", "left").select(
        "trip_id", "stop_sequence", "stop_id", "stop_name", "stop_lat", "stop_lon",
        "arrival_secs", "stop_headsign", "is_timepoint", "pickup_type", "drop_off_type",
    )
    return out.orderBy("stop_sequence") if trip_id is not None else out


def with_distance(points: DataFrame) -> DataFrame:
    """Add ``dist_m``, the straight-line distance along the trip's timepoints, and the
    hops ``hop_prev`` / ``hop_next`` to its neighbours (null at the ends).

    One walk: a window per block of sequence numbers gives the neighbours and the distance
    inside the block; a row for each block carries its ends and its length to the others.
    """
    part = ["trip_id", "_block"]
    rows = points.withColumn("_block", range_block(F.col("stop_sequence"), SEQUENCE_BLOCK)).repartition(*part)
    inside = Window.partitionBy(*part).orderBy("stop_sequence")
    along = Window.partitionBy("trip_id").orderBy("_block")
    here = F.struct("stop_lat", "stop_lon")

    def hop(other: Column, place: Column) -> Column:
        return haversine_m(other["stop_lat"], other["stop_lon"], place["stop_lat"], place["stop_lon"])

    rows = rows.withColumns({"_here": here, "_before": F.lag(here).over(inside), "_after": F.lead(here).over(inside)})
    rows = rows.withColumn("_hop", hop(F.col("_before"), F.col("_here")))
    blocks = rows.groupBy(*part).agg(
        F.min_by("_here", "stop_sequence").alias("_first"), F.max_by("_here", "stop_sequence").alias("_last"),
        F.sum("_hop").alias("_length"))
    blocks = blocks.select(
        *part, "_first", "_length", F.lag("_last").over(along).alias("_from"), F.lead("_first").over(along).alias("_to"),
        F.lag("_length").over(along).alias("_behind"))
    gap = F.coalesce(hop(F.col("_from"), F.col("_first")), F.lit(0.0))
    blocks = blocks.select(*part, "_from", "_to", F.sum(F.coalesce("_behind", F.lit(0.0)) + gap).over(along).alias("_offset"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_local", F.sum(F.coalesce("_hop", F.lit(0.0))).over(so_far)).join(by_merge(blocks), part)
    return rows.select(
        *points.columns,
        F.coalesce("_hop", hop(F.col("_from"), F.col("_here"))).alias("hop_prev"),
        hop(F.coalesce("_after", "_to"), F.col("_here")).alias("hop_next"),
        (F.col("_offset") + F.col("_local")).alias("dist_m"),
    )


def numbered(points: DataFrame, place: Column) -> DataFrame:
    """Add ``tp_no``, a trip's timepoints from 1, and ``prev_sample`` / ``next_sample``, the ``place``
    of its neighbours. One walk, as in ``with_distance``."""
    part = ["trip_id", "_block"]
    rows = points.withColumn("_block", range_block(F.col("stop_sequence"), SEQUENCE_BLOCK)).repartition(*part)
    inside = Window.partitionBy(*part).orderBy("stop_sequence")
    along = Window.partitionBy("trip_id").orderBy("_block")
    rows = rows.withColumn("_place", place).withColumns({
        "_no": F.row_number().over(inside), "_before": F.lag("_place").over(inside), "_after": F.lead("_place").over(inside)})
    blocks = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by("_place", "stop_sequence").alias("_first"),
        F.max_by("_place", "stop_sequence").alias("_last")).select(
        *part, F.lag("_last").over(along).alias("_from"), F.lead("_first").over(along).alias("_to"),
        (F.sum("_rows").over(along) - F.col("_rows")).alias("_offset"))
    return rows.join(by_merge(blocks), part).select(
        *points.columns, (F.col("_offset") + F.col("_no")).cast("int").alias("tp_no"),
        F.coalesce("_before", "_from").alias("prev_sample"), F.coalesce("_after", "_to").alias("next_sample"))


def drop_close_neighbours(points: DataFrame, min_gap_m: float = MIN_GAP_M) -> DataFrame:
    """Drop inner timepoints too close to a neighbour, measured before any is dropped.

    The first and last of a trip stay.
    """
    nearest = F.least("hop_prev", "hop_next")
    inner = F.col("hop_prev").isNotNull() & F.col("hop_next").isNotNull()
    return points.filter(~inner | (nearest >= min_gap_m)).drop("hop_prev", "hop_next")


def detection_timetable(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Timepoints with distances, ready for arrival detection."""
    return drop_close_neighbours(with_distance(timepoints(stop_times, stops)))


def ends_of_trips(points: DataFrame) -> DataFrame:
    """First and last timepoint of each trip as structs ``origin`` and ``terminus``."""
    fields = F.struct("stop_sequence", "stop_id", "arrival_secs", "stop_lat", "stop_lon")
    return points.groupBy("trip_id").agg(
        F.min_by(fields, "stop_sequence").alias("origin"),
        F.max_by(fields, "stop_sequence").alias("terminus"),
    )


def stop_slots(points: DataFrame, trips: DataFrame) -> DataFrame:
    """Scheduled slots per route and stop: who is due when.

    Repeats go before the join, of each side by itself; its result then has none. One sort
    by trip serves both, and no task holds a hash table of its slots.
    """
    def once(rows: DataFrame) -> DataFrame:
        alike = Window.partitionBy(*rows.columns).orderBy("trip_id")
        return rows.repartition("trip_id").withColumn("_no", F.row_number().over(alike)).filter(F.col("_no") == 1).drop("_no")

    stops = once(points.select("trip_id", "stop_id", "arrival_secs"))
    owners = once(trips.select("trip_id", "route_id"))
    return stops.join(by_merge(owners), "trip_id").select("route_id", "stop_id", "arrival_secs", "trip_id")


def trip_endpoints(stop_times: DataFrame) -> DataFrame:
    """Lowest and highest stop sequence of each trip and the stops there."""
    # Of several rows at one sequence the first read counts.
    order = reading_order(stop_times, "stop_id")
    rows = stop_times.groupBy("trip_id", "stop_sequence").agg(
        F.min_by("stop_id", order).alias("stop_id")
    )
    place = F.struct("stop_sequence", "stop_id")
    lowest, highest = F.min_by(place, "stop_sequence"), F.max_by(place, "stop_sequence")
    return (
        rows.groupBy("trip_id")
        .agg(lowest.alias("lo"), highest.alias("hi"))
        .select(
            "trip_id",
            F.col("lo.stop_sequence").alias("min_sequence"),
            F.col("hi.stop_sequence").alias("max_sequence"),
            F.col("lo.stop_id").alias("first_stop_id"),
            F.col("hi.stop_id").alias("last_stop_id"),
        )
    )


def route_terminals(endpoints: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct (route, stop) pairs at either end of any of the route's trips."""
    ends = endpoints.join(trips.select("trip_id", "route_id"), "trip_id")
    both = F.explode(F.array("first_stop_id", "last_stop_id")).alias("stop_id")
    return (
        ends.select("route_id", both)
        .filter(F.col("stop_id").isNotNull() & (F.col("route_id") != ""))
        .distinct()
    )


def trips_per_dow(trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trips per route and weekday; routes that never run are absent."""
    counts = (
        trips.join(calendar, "service_id")
        .groupBy("route_id")
        .agg(*[F.sum(F.col(d).cast("int")).cast("long").alias(d) for d in WEEKDAYS])
    )
    return counts.filter(F.greatest(*WEEKDAYS) > 0)


def monday_departures(trips: DataFrame, calendar: DataFrame, origins: DataFrame) -> DataFrame:
    """Origin departures of Monday service, which stands for weekdays."""
    mondays = calendar.filter("monday").select("service_id")
    return (
        trips.join(mondays, "service_id", "left_semi")
        .join(origins, "trip_id")
        .select("route_id", "direction_id", "departure_secs")
    )


def scheduled_headways(departures: DataFrame) -> DataFrame:
    """Minutes between departures per route and hour, averaged over its directions."""
    hour = F.pmod(F.floor(F.col("departure_secs") / 3600), F.lit(24)).cast("int").alias("hour")
    return (
        departures.groupBy("route_id", "direction_id", hour)
        .agg((F.lit(60.0) / F.count(F.lit(1))).alias("gap"))
        .groupBy("route_id", "hour")
        .agg(round1(F.sum("gap") / F.count("gap")).alias("headway_minutes"))
    )


def service_span(departures: DataFrame) -> DataFrame:
    """First and last departure per route as HH:MM, hours folded into one day."""
    ends = departures.groupBy("route_id").agg(
        F.min("departure_secs").alias("a"), F.max("departure_secs").alias("b")
    )
    return ends.select(
        "route_id",
        hour_minute(F.col("a")).alias("span_start"),
        hour_minute(F.col("b")).alias("span_end"),
    )


def schedule_summary(trips: DataFrame, calendar: DataFrame, origins: DataFrame) -> DataFrame:
    """Per route: trips per weekday, the three headline counts and the service span."""
    spans = service_span(monday_departures(trips, calendar, origins))
    return (
        trips_per_dow(trips, calendar)
        .join(spans, "route_id", "left")
        .select(
            "route_id", *WEEKDAYS, F.col("monday").alias("weekday_trips"),
            F.col("saturday").alias("saturday_trips"), F.col("sunday").alias("sunday_trips"),
            "span_start", "span_end",
        )
    )


def route_directions(trips: DataFrame) -> DataFrame:
    """Most common headsign per route and direction; of equals the first read."""
    order = reading_order(trips, "trip_id")
    signs = trips.groupBy(
        "route_id", "direction_id", F.coalesce("trip_headsign", F.lit("")).alias("headsign")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    most = signs.groupBy("route_id", "direction_id").agg(
        F.max("n").alias("n"), F.sum("n").alias("trips")
    )
    return (
        signs.join(most, ["route_id", "direction_id", "n"])
        .groupBy("route_id", "direction_id", "trips")
        .agg(F.min_by("headsign", "first_seen").alias("headsign"))
    )


def direction_trips(trips: DataFrame, route_id: str, direction: int) -> DataFrame:
    """Trips of one route and direction, for direction filters."""
    return trips.filter(
        (F.col("route_id") == route_id) & (F.col("direction_id") == str(direction))
    ).select("trip_id")


def route_stops(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Each route's distinct stops with coordinates and their lowest sequence."""
    lowest = (
        stop_times.filter(F.col("stop_id").isNotNull())
        .join(trips.select("trip_id", "route_id"), "trip_id")
        .groupBy("route_id", "stop_id")
        .agg(F.min("stop_sequence").alias("stop_sequence"))
    )
    placed = stops.filter((F.col("stop_lat") != 0) | (F.col("stop_lon") != 0))
    return lowest.join(placed.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id")


def stop_routes(route_stop_table: DataFrame, routes: DataFrame) -> DataFrame:
    """Flat (stop, route) table with the route's names, for stop pages."""
    dims = routes.select(
        "route_id",
        F.col("route_short_name").alias("short_name"),
        F.col("route_long_name").alias("long_name"),
        F.col("route_color").alias("color"),
        "route_type",
    )
    return (
        route_stop_table.select("stop_id", "route_id")
        .distinct()
        .join(dims, "route_id", "left")
        .fillna({"short_name": "", "long_name": "", "color": DEFAULT_COLOR, "route_type": "3"})
    )
