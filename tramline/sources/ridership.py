"""Monthly ridership files with headers of many spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.times import parse_count, parse_month

# Accepted header names of each column, tried in this order.
ALIASES = {
    "route_id": ["route_id", "route", "route_short_name", "line", "routename"],
    "month": ["month", "period", "date", "service_month", "yearmonth"],
    "boardings": ["boardings", "ridership", "riders", "trips", "passengers", "upt"],
    "avg_weekday_boardings": ["avg_weekday_boardings", "weekday_boardings", "avg_weekday"],
}


def _fields(line: Column, width: int) -> Column:
    """A line's fields as an array of strings, read as CSV."""
    names = [f"c{i}" for i in range(width)]
    row = F.from_csv(line, ", ".join(f"{n} string" for n in names))
    return F.array(*[row[n] for n in names])


def _place_of(wanted: str, explicit: str | None) -> Column:
    """Where a header has a column (from 1), by the first accepted name; null if nowhere."""
    names = [explicit.strip().lower()] if explicit else ALIASES[wanted]
    return F.coalesce(*[F.nullif(F.array_position("header", name), F.lit(0)) for name in names])


def read_ridership(
    spark: SparkSession, path: str, names: dict[str, str] | None = None, source: str | None = None
) -> DataFrame:
    """Rows with route, month and boardings; others are skipped.

    Each file has a header of its own, in any order and any accepted spelling; a file
    without one of the three columns is an error. The source is the file's name without
    its ending, unless given. ``row_no`` keeps the order of the file for last-wins loads.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("row_no"),
    )
    tops = lines.groupBy("file").agg(F.min("row_no").alias("top"), F.min_by("value", "row_no").alias("title"))
    width = tops.agg(F.max(F.size(F.split("title", ",")))).first()[0] or 1
    bare = F.transform(_fields(F.regexp_replace("title", "^\ufeff", ""), width), lambda c: F.lower(F.trim(c)))
    headers = tops.withColumn("header", bare).select(
        "file", "top", *[_place_of(w, (names or {}).get(w)).cast("int").alias(f"at_{w}") for w in ALIASES])
    needed = ("route_id", "month", "boardings")
    lost = headers.filter(" or ".join(f"at_{w} is null" for w in needed)).select("file").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0][0]} lacks a column for one of {', '.join(needed)}")
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)

    def text(wanted: str) -> Column:
        return F.try_element_at("fields", F.col(f"at_{wanted}"))

    return (
        lines.join(headers, "file").filter(F.col("row_no") != F.col("top"))
        .withColumn("fields", _fields(F.col("value"), width))
        .select(
            F.trim(text("route_id")).alias("route_id"),
            parse_month(text("month")).alias("month"),
            parse_count(text("boardings")).alias("boardings"),
            parse_count(text("avg_weekday_boardings")).alias("avg_weekday_boardings"),
            F.lit(source).alias("source") if source else stem.alias("source"),
            "row_no",
        )
        .filter((F.col("route_id") != "") & F.col("month").isNotNull() & F.col("boardings").isNotNull())
    )
