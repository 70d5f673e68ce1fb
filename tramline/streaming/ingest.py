"""Landed feed files to fact tables, one micro-batch at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
COMMIT = "poll long, attempt string, tables array<string>"


def landed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of landed JSON files; a batch takes a bounded number of them."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )


def facts_once(rows: DataFrame, keys: list[str], ts: str = "timestamp", lateness: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen before within the watermark, so a poll landed twice counts once.

    Keys are held until the watermark has passed their row by; a column of them may be null.
    """
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def append_facts(path: str, ts: str = "timestamp"):
    """``foreachBatch`` append: by day, sorted by route and newest first within files.

    The batch number is part of the path, so a repeated batch replaces its own rows.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("date", F.to_date(ts))
            .withColumn("batch_id", F.lit(batch_id))
            .sortWithinPartitions("date", "route_id", F.desc(ts))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "batch_id")
            .parquet(path)
        )

    return append


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(poll, attempt, tables) of the polls that are there whole."""
    try:
        return spark.read.schema(COMMIT).json(f"{root}/{COMMITS}/*")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], COMMIT)
        raise


def append_poll(root: str, tables: dict[str, Callable[[DataFrame], DataFrame]], ts: str = "timestamp"):
    """``foreachBatch`` append of one poll to several fact tables that commits all or none of it.

    Each table's files go to a folder of the poll and of this attempt. Last comes the poll's
    manifest, one small file that appears by a rename and names the attempt; ``committed``
    reads only what a manifest names. A poll that failed half way leaves files no reader looks
    at, and a poll that is there already is left alone.
    """

    def append(batch: DataFrame, poll: int) -> None:
        spark = batch.sparkSession
        if not commits(spark, root).filter(F.col("poll") == poll).isEmpty():
            return
        attempt = uuid.uuid4().hex
        batch = batch.persist()
        for name, rows_of in tables.items():
            (
                rows_of(batch).withColumn("date", F.to_date(ts))
                .withColumn("poll", F.lit(poll)).withColumn("attempt", F.lit(attempt))
                .sortWithinPartitions("date", "route_id", F.desc(ts))
                .write.mode("append").partitionBy("poll", "attempt", "date").parquet(f"{root}/{name}")
            )
        batch.unpersist()
        spark.createDataFrame([(poll, attempt, list(tables))], COMMIT).coalesce(1).write.mode("error").json(
            f"{root}/{COMMITS}/poll-{poll}")

    return append


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A fact table's rows of whole polls; folders of other attempts are pruned by the join."""
    whole = commits(spark, root).filter(F.array_contains("tables", table)).select("poll", "attempt")
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows.join(whole, ["poll", "attempt"], "left_semi").drop("attempt")
