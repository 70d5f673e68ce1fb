"""Hourly rollup of a stream of stop events, merged into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.rollups import PROFILES


def hourly_stream(events: DataFrame, lateness: str = "36 hours", profile: str = "five_minutes") -> DataFrame:
    """Band counts per route and hour.

    A terminus fallback is dated at the closest approach but comes out 15 minutes after
    the trip's last sighting, which may be hours later when a vehicle keeps reporting
    short of its terminus. A trip ends within its service day, so the watermark allows a
    day and a half; with less, such events are dropped.
    """
    d = F.col("delay_seconds")
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 hour").alias("w"), "route_id")
        .agg(
            *[F.count_if(band.holds(d)).alias(band.name) for band in PROFILES[profile]],
            F.count(d).alias("observations"),
            F.sum(d.cast("long")).alias("delay_sum"),
            F.sum(d.cast("long") * d.cast("long")).alias("delay_sumsq"),
        )
        .select("route_id", F.col("w.start").alias("bucket"), F.col("*"))
        .drop("w")
        .select("route_id", "bucket", *[b.name for b in PROFILES[profile]], "observations", "delay_sum", "delay_sumsq")
    )


def write_versions(path: str):
    """``foreachBatch`` for update mode: each batch adds the new values of its buckets."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("bucket_date", F.to_date("bucket"))
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket_date", "batch_id")
            .parquet(path)
        )

    return write


def newest_versions(stored: DataFrame) -> DataFrame:
    """The last written value of each route and bucket."""
    rest = [c for c in stored.columns if c not in ("route_id", "bucket", "batch_id", "bucket_date")]
    return (
        stored.groupBy("route_id", "bucket")
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
        .select("route_id", "bucket", "r.*")
    )
