"""A rollup that follows a log of changed buckets.

Every append of raw rows logs the distinct buckets it touched, a few rows, whatever their age. A
refresh recomputes the logged buckets only, from the raw rows of just these, and writes them as
a version beside the older ones. A version counts from the moment its manifest, one small file,
appears; readers take each bucket from the newest version that names it. So a bucket whose rows
are all gone is named and empty, no reader sees half a refresh, and a refresh that failed leaves
nothing behind that is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.times import instant
from tramline.operators.rollups import RollupSpec, floor_to, since
from tramline.session import stored

CHANGES, VERSIONS, DATA = "_changes", "_versions", "data"
CHANGE = "batch long, bucket timestamp"
VERSION = "version long, upto long, bucket timestamp"


def bucket_of(spec: RollupSpec) -> Column:
    return F.date_trunc(spec.unit, "timestamp")


def log_changes(rows: DataFrame, spec: RollupSpec, root: str, batch: int) -> None:
    """Log the buckets that a batch of new, moved or removed rows touches; a repeated batch logs the same."""
    rows.select(F.lit(batch).cast("long").alias("batch"), bucket_of(spec).alias("bucket")).distinct().write.mode(
        "overwrite").json(f"{root}/{CHANGES}/{batch}")


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(f"{path}/*")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def pending(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, batch): logged and in no version yet, with the newest batch that touched it."""
    logged = _log(spark, f"{root}/{CHANGES}", CHANGE).groupBy("bucket").agg(F.max("batch").alias("batch"))
    done = _log(spark, f"{root}/{VERSIONS}", VERSION).groupBy("bucket").agg(F.max("upto").alias("upto"))
    return logged.join(done, "bucket", "left").filter(F.col("upto").isNull() | (F.col("upto") < F.col("batch"))).select(
        "bucket", "batch")


def refresh_changed(raw: DataFrame, spec: RollupSpec, root: str, now: dt.datetime) -> int:
    """Recompute the logged buckets that are complete; the number of buckets refreshed.

    Buckets after ``now - end_offset`` stay logged. Rows that came after their batch was logged
    are logged by their own batch, so a bucket is never older than its log says.
    """
    spark = raw.sparkSession
    last = floor_to(now - spec.end_offset, spec.unit)
    changed = stored(pending(spark, root).filter(F.col("bucket") < instant(last)), "changed")
    first, end, count = changed.agg(
        F.unix_seconds(F.min("bucket")), F.unix_seconds(F.max("bucket")), F.count(F.lit(1))).first()
    if not count:
        return 0
    moment = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    beyond = moment(end) + (dt.timedelta(days=1) if spec.unit == "day" else dt.timedelta(hours=1))
    rows = since(raw, moment(first)).filter(F.col("timestamp") < instant(beyond))
    rows = rows.withColumn("_bucket", bucket_of(spec)).join(
        changed.select(F.col("bucket").alias("_bucket")), "_bucket", "left_semi").drop("_bucket")
    newest = _log(spark, f"{root}/{VERSIONS}", VERSION).agg(F.max("version")).first()[0]
    version = (newest or 0) + 1
    spec.build(rows).withColumn("version", F.lit(version).cast("long")).withColumn("bucket_date", F.to_date("bucket")).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket_date").parquet(f"{root}/{DATA}")
    changed.select(F.lit(version).cast("long").alias("version"), F.col("batch").alias("upto"), "bucket").coalesce(1).write.mode(
        "overwrite").json(f"{root}/{VERSIONS}/{version}")
    return count


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rollup's rows, each bucket from the newest version that names it."""
    newest = _log(spark, f"{root}/{VERSIONS}", VERSION).groupBy("bucket").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{root}/{DATA}").join(newest, ["bucket", "version"], "left_semi").drop("bucket_date")
