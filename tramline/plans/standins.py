"""The supplied star schema and event tables read as transit tables.

The column definitions are repeated as SQL in ``oracle.py``; both sides read
whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.config import OCCUPANCY_ORDER, WEEKDAYS
from tramline.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stop_events(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as stop arrivals: order = trip, supplier = route, part = stop."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.col("l_suppkey").cast("string").alias("route_id"),
        F.col("l_partkey").cast("string").alias("stop_id"),
        F.col("l_linenumber").cast("int").alias("stop_sequence"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.date_diff("l_shipdate", "o_orderdate").alias("delay_seconds"),
    )


def k_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def trip_of() -> Column:
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return F.concat_ws("-", F.col("user_id").cast("string"), week)


def timed_events(spark: SparkSession, folder: str) -> DataFrame:
    """User events as stop arrivals with a time of day."""
    k = k_of()
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        trip_of().alias("trip_id"),
        F.col("event_type").alias("route_id"),
        F.col("user_id").cast("string").alias("stop_id"),
        (F.pmod(k, F.lit(10)) + 1).alias("stop_sequence"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ((k - 50) * 20).alias("delay_seconds"),
    )


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """User events as vehicle positions: user = vehicle, user and week = trip."""
    k = k_of()
    names = F.array(*[F.lit(name) for name in OCCUPANCY_ORDER])
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        trip_of().alias("trip_id"),
        F.col("event_type").alias("route_id"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("vehicle_label"),
        (F.lit(39.5) + k / 200.0).alias("latitude"),
        (F.lit(-105.2) + F.col("value") / 1000.0).alias("longitude"),
        (k * 3.6).alias("bearing"),
        F.pmod(k, F.lit(10)).alias("current_stop_sequence"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("current_status"),
        F.concat(F.lit("NATION_"), F.pmod(k, F.lit(25)).cast("string")).alias("stop_id"),
        F.try_element_at(names, F.pmod(k, F.lit(9)) + 1).alias("occupancy_status"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """User events as trip updates; the hour is the feed time, so times collide."""
    k = k_of()
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        trip_of().alias("trip_id"),
        F.col("event_type").alias("route_id"),
        F.nullif(F.pmod(k, F.lit(10)), F.lit(0)).alias("stop_sequence"),
        F.when(F.pmod(k, F.lit(7)) != 0, (k - 50) * 20).alias("arrival_delay"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("timestamp"),
    )


def event_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as routes; the name's length picks a route type."""
    kinds = table(spark, folder, "events").select(F.col("event_type").alias("route_id")).distinct()
    return kinds.select(
        "route_id",
        F.upper("route_id").alias("route_short_name"),
        F.concat(F.lit("Line "), F.col("route_id")).alias("route_long_name"),
        F.pmod(F.length("route_id"), F.lit(5)).cast("string").alias("route_type"),
        F.lit("00AA00").alias("route_color"),
    )


def supplier_routes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("route_id"),
        F.col("s_name").alias("route_short_name"),
        F.pmod("s_nationkey", F.lit(4)).cast("string").alias("route_type"),
    )


def nation_stops(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("stop_id"),
        F.concat(F.lit("Stop "), F.col("n_name")).alias("stop_name"),
        (F.lit(39.5) + n / 15.0).alias("stop_lat"),
        (F.lit(-105.2) + n / 20.0).alias("stop_lon"),
    )


def part_stops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        (F.lit(39.0) + F.pmod("p_partkey", F.lit(1000)) / 1000.0).alias("stop_lat"),
        (F.lit(-105.0) + F.col("p_size") / 100.0).alias("stop_lon"),
        (F.col("p_size") <= 10).alias("is_rail"),
    )


def timepoints(spark: SparkSession, folder: str) -> DataFrame:
    """Eight timepoints for every trip of ``positions``, at eight of the nations each.

    The last letter of the trip's name picks where in the row of nations it starts, so all
    nations are stops and neighbouring starts share some.
    """
    trips = table(spark, folder, "events").select(trip_of().alias("trip_id")).distinct()
    n = F.col("n")
    start = F.pmod(F.ascii(F.right("trip_id", F.lit(1))), F.lit(5)) * 5
    numbered = trips.select("trip_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n")).withColumn(
        "n_nationkey", F.pmod(n + start, F.lit(25)).cast("long"))
    return numbered.join(table(spark, folder, "nation"), "n_nationkey").select(
        "trip_id",
        (n + 1).alias("stop_sequence"),
        F.col("n_name").alias("stop_id"),
        (n * 10800).alias("arrival_secs"),
        (F.lit(39.5) + n / 15.0).alias("stop_lat"),
        (F.lit(-105.2) + n / 100.0).alias("stop_lon"),
    )


def timetable_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as scheduled stops, one row per (order, line number)."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.col("l_linenumber").cast("int").alias("stop_sequence"),
        F.col("part").cast("string").alias("stop_id"),
    )


def located_lines(spark: SparkSession, folder: str) -> DataFrame:
    return timetable_lines(spark, folder).join(
        part_stops(spark, folder).select("stop_id", "stop_lat", "stop_lon"), "stop_id"
    )


def order_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trips: the lowest supplier is the route, priority the service."""
    route = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").cast("string").alias("route_id")
    )
    orders = table(spark, folder, "orders")
    return orders.join(route, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("trip_id"),
        "route_id",
        F.col("o_orderpriority").alias("service_id"),
        F.pmod("o_custkey", F.lit(2)).cast("string").alias("direction_id"),
        F.col("o_orderstatus").alias("trip_headsign"),
        F.pmod(F.col("o_orderkey") * 977, F.lit(100000)).cast("int").alias("departure_secs"),
    )


def priority_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities as services; service n runs on the weekdays after day n mod 3."""
    services = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("service_id")
    ).distinct()
    digit = F.substring("service_id", 1, 1).cast("int")
    return services.select(
        "service_id",
        *[(F.pmod(digit + i, F.lit(3)) != 0).alias(day) for i, day in enumerate(WEEKDAYS)],
    )


def ridership(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per customer nation and month as boardings."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").cast("string").alias("route_id"),
            F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"),
        )
        .agg(F.count(F.lit(1)).alias("boardings"))
    )


def vehicle_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Positions packed as decoded feed entities; some lack a vehicle, place or route."""
    p, k = positions(spark, folder).withColumn("k", (F.col("bearing") / 3.6).cast("int")), F.col("k")
    body = F.struct(
        F.struct(
            "trip_id", F.when(F.pmod(k, F.lit(11)) == 0, "").otherwise(F.col("route_id")).alias("route_id")
        ).alias("trip"),
        F.when(F.pmod(k, F.lit(7)) != 0, F.struct(F.col("vehicle_id").alias("id"), F.col("vehicle_label").alias("label"))).alias("vehicle"),
        F.when(F.pmod(k, F.lit(13)) != 0, F.struct("latitude", "longitude", "bearing")).alias("position"),
        "current_stop_sequence", "current_status", "stop_id", "occupancy_status",
        F.unix_seconds("timestamp").alias("timestamp"),
    )
    return p.select(
        F.col("id").cast("string").alias("entity_id"),
        F.date_trunc("hour", "timestamp").alias("poll_time"),
        F.when(F.pmod(k, F.lit(10)) != 3, body).alias("vehicle"),
    )


def update_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Updates packed as decoded feed entities with two stops each."""
    u = updates(spark, folder)
    seq, delay = F.coalesce("stop_sequence", F.lit(0)), F.col("arrival_delay")

    def stop(number: Column, late: Column) -> Column:
        return F.struct(
            F.when(number % 2 == 0, "").otherwise("S").alias("stop_id"),
            number.alias("stop_sequence"),
            F.when(delay.isNotNull(), F.struct(late.alias("delay"), F.lit(0).cast("long").alias("time"))).alias("arrival"),
            F.when(number > 3, F.struct(F.lit(None).cast("int").alias("delay"), number.cast("long").alias("time"))).alias("departure"),
        )

    body = F.struct(
        F.struct("trip_id", "route_id").alias("trip"),
        F.when(seq > 5, F.unix_seconds("timestamp") - 60).otherwise(F.lit(0)).alias("timestamp"),
        F.array(stop(seq, delay), stop(seq + 1, delay + 30)).alias("stop_time_update"),
    )
    return u.select(
        F.col("id").cast("string").alias("entity_id"), F.col("timestamp").alias("poll_time"),
        body.alias("trip_update"),
    )


def scoreboard_polls(spark: SparkSession, folder: str) -> DataFrame:
    """User events as scoreboard polls: user and day are a game, the hour its phase."""
    k, hour = k_of(), F.hour("ts")
    club = F.pmod("user_id", F.lit(6)).cast("int")
    leagues = F.array(*[F.lit(x) for x in ("NHL", "NBA", "MLB", "NFL", "MLS", "NWSL")])
    names = F.array(*[F.lit(x) for x in ("Avalanche", "Nuggets", "Rockies", "Broncos", "Rapids", "Summit")])
    kind = F.struct(
        F.struct(
            F.when(hour < 8, "PRE").when(hour < 16, "in").otherwise("post").alias("state"),
            F.lit("detail").alias("shortDetail"), F.lit("").alias("detail"), F.lit("").alias("description"),
        ).alias("type")
    )

    def side(place: str, name: Column, score: Column) -> Column:
        fields = [F.lit(None).cast("string").alias(c) for c in
                  ("shortDisplayName", "name", "location", "nickname", "abbreviation", "color", "alternateColor")]
        return F.struct(
            F.lit(place).alias("homeAway"), score.cast("string").alias("score"),
            F.lit(None).cast("boolean").alias("winner"),
            F.struct(name.alias("displayName"), *fields).alias("team"),
        )

    ours = F.element_at(names, club + 1)
    home = F.when(F.pmod("user_id", F.lit(5)) == 0, "Visitors").otherwise(ours)
    game = F.struct(
        F.lit(None).cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'10:00'Z'").alias("date"), kind.alias("status"),
        F.struct(F.lit("Park").alias("fullName")).alias("venue"),
        F.array(
            side("away", F.lit("Guests"), F.pmod(k, F.lit(10))),
            side("home", home, F.floor(k / 10)),
        ).alias("competitors"),
    )
    event = F.struct(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("id"),
        F.lit(None).cast("string").alias("date"), kind.alias("status"), F.array(game).alias("competitions"),
    )
    return table(spark, folder, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp").alias("poll_time"),
        F.element_at(leagues, club + 1).alias("league"),
        F.col("event_id").cast("int").alias("day_order"), F.array(event).alias("events"),
    )


def shape_points(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's positions in time order as the points of a shape."""
    return positions(spark, folder).select(
        F.col("vehicle_id").alias("shape_id"), F.col("id").alias("seq"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )


def naive(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC readings, the form of the supplied tables."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )
