"""Timetable files: five folders of CSV text, read by column name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.config import FEED_FOLDERS, RAIL_FOLDERS, ROUTE_OVERRIDES, WEEKDAYS
from tramline.functions.times import gtfs_seconds

ROUTE_COLUMNS = [
    "route_id", "route_short_name", "route_long_name", "route_type", "route_color", "agency_id",
]
STOP_COLUMNS = ["stop_id", "stop_name", "stop_desc", "stop_lat", "stop_lon"]
TRIP_COLUMNS = ["trip_id", "route_id", "service_id", "direction_id", "trip_headsign", "shape_id"]
STOP_TIME_COLUMNS = [
    "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "stop_headsign",
    "pickup_type", "drop_off_type", "timepoint",
]
SHAPE_COLUMNS = ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"]


def read_table(
    spark: SparkSession, root: str, table: str, columns: list[str],
    folders: list[str] = FEED_FOLDERS,
) -> DataFrame:
    """One table of all folders as text, with ``source`` = (folder, place in the file).

    Folders without the file are skipped, columns a file lacks are null.
    """
    frames = []
    for rank, folder in enumerate(folders):
        try:
            raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(
                f"{root}/{folder}/{table}.txt"
            )
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                continue
            raise
        found = {name.lstrip("﻿").strip(): name for name in raw.columns}
        place = F.struct(
            F.lit(rank).alias("folder_rank"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        frames.append(
            raw.select(
                *[
                    (F.trim(F.col(f"`{found[c]}`")) if c in found else F.lit(None).cast("string")).alias(c)
                    for c in columns
                ],
                F.lit(folder).alias("folder"),
                place.alias("source"),
            )
        )
    if not frames:
        raise FileNotFoundError(f"no {table}.txt below {root}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def present(*names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull() & (F.col(name) != "")
    return test


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the one read last; an aggregate, so copies combine map-side."""
    rest = [c for c in df.columns if c not in (key, "source")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("source")).alias("r")).select(
        key, "r.*"
    )


def routes(spark: SparkSession, root: str) -> DataFrame:
    """Routes, later folders winning and the fixed overrides last."""
    files = read_table(spark, root, "routes", ROUTE_COLUMNS).filter(present("route_id"))
    fixed = spark.createDataFrame(ROUTE_OVERRIDES, ", ".join(f"{c} string" for c in ROUTE_COLUMNS))
    fixed = fixed.withColumn("folder", F.lit(None).cast("string")).withColumn(
        "source",
        F.struct(
            F.lit(len(FEED_FOLDERS)).alias("folder_rank"),
            F.lit(0).cast("long").alias("block"),
            F.lit(0).cast("long").alias("line"),
        ),
    )
    out = last_wins(files.unionByName(fixed), "route_id")
    return out.select("route_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ROUTE_COLUMNS[1:]])


def coordinate(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name)


def stops(spark: SparkSession, root: str) -> DataFrame:
    """Stops, later folders winning; blank coordinates are 0."""
    files = read_table(spark, root, "stops", STOP_COLUMNS).filter(present("stop_id"))
    return last_wins(files, "stop_id").select(
        "stop_id", F.coalesce("stop_name", F.lit("")).alias("stop_name"),
        coordinate("stop_lat"), coordinate("stop_lon"),
    )


def stop_directory(spark: SparkSession, root: str) -> DataFrame:
    """Stops for search: earlier folders winning, rail if any rail folder has the stop."""
    files = read_table(spark, root, "stops", STOP_COLUMNS).filter(present("stop_id"))
    rail = F.max(F.col("folder").isin(RAIL_FOLDERS)).alias("is_rail")
    fields = F.struct("stop_name", "stop_desc", "stop_lat", "stop_lon")
    return (
        files.groupBy("stop_id")
        .agg(F.min_by(fields, F.col("source")).alias("r"), rail)
        .select("stop_id", "r.*", "is_rail")
        .select(
            "stop_id",
            F.coalesce("stop_name", F.lit("")).alias("stop_name"),
            F.coalesce("stop_desc", F.lit("")).alias("stop_desc"),
            coordinate("stop_lat"),
            coordinate("stop_lon"),
            "is_rail",
        )
    )


def trips(spark: SparkSession, root: str) -> DataFrame:
    """trip -> route, service, direction, headsign, shape; later folders winning.

    ``line`` keeps the reading order for first-seen rules.
    """
    files = read_table(spark, root, "trips", TRIP_COLUMNS).filter(present("trip_id", "route_id"))
    kept = files.withColumn("line", F.col("source")).withColumn(
        "direction_id", F.coalesce(F.nullif("direction_id", F.lit("")), F.lit("0"))
    )
    return last_wins(kept, "trip_id")


def calendar(spark: SparkSession, root: str) -> DataFrame:
    """service -> one boolean per weekday. Date limits and exceptions are not used."""
    files = read_table(spark, root, "calendar", ["service_id", *WEEKDAYS]).filter(
        present("service_id")
    )
    return last_wins(files, "service_id").select(
        "service_id", *[F.coalesce(F.col(d) == "1", F.lit(False)).alias(d) for d in WEEKDAYS]
    )


def stop_times(spark: SparkSession, root: str) -> DataFrame:
    """All scheduled stops with parsed times; rows without trip or sequence dropped."""
    files = read_table(spark, root, "stop_times", STOP_TIME_COLUMNS)
    arrival, departure = (F.nullif(c, F.lit("")) for c in ("arrival_time", "departure_time"))
    return files.withColumn("stop_sequence", F.col("stop_sequence").try_cast("int")).filter(
        present("trip_id") & F.col("stop_sequence").isNotNull()
    ).select(
        "trip_id",
        F.nullif("stop_id", F.lit("")).alias("stop_id"),
        "stop_sequence",
        gtfs_seconds(F.coalesce(arrival, departure)).alias("arrival_secs"),
        gtfs_seconds(F.coalesce(departure, arrival)).alias("departure_secs"),
        F.nullif("stop_headsign", F.lit("")).alias("stop_headsign"),
        F.coalesce(F.nullif("pickup_type", F.lit("")), F.lit("0")).alias("pickup_type"),
        F.coalesce(F.nullif("drop_off_type", F.lit("")), F.lit("0")).alias("drop_off_type"),
        F.coalesce(F.col("timepoint") == "1", F.lit(False)).alias("is_timepoint"),
        F.col("source").alias("line"),
    )


def shape_points(spark: SparkSession, root: str) -> DataFrame:
    """Shape points; rows with a bad number are dropped."""
    files = read_table(spark, root, "shapes", SHAPE_COLUMNS).filter(present("shape_id"))
    return files.select(
        "shape_id",
        F.col("source.folder_rank").alias("folder_rank"),
        F.col("shape_pt_sequence").try_cast("int").alias("seq"),
        F.col("shape_pt_lat").try_cast("double").alias("lat"),
        F.col("shape_pt_lon").try_cast("double").alias("lon"),
    ).dropna()
