"""Merging a load of monthly ridership into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["route_id", "month"]


def last_of_load(load: DataFrame, order: str = "row_no") -> DataFrame:
    """Of several rows for one route and month the last of the load counts."""
    if order not in load.columns:
        return load
    rest = [c for c in load.columns if c not in (*KEYS, order)]
    return load.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*KEYS, "r.*")


def upsert_ridership(stored: DataFrame, load: DataFrame) -> DataFrame:
    """Stored rows overwritten by the load, with what happened to each row.

    An update replaces all values, a null included.
    """
    fresh = last_of_load(load).withColumn("_new", F.lit(True))
    rest = [c for c in stored.columns if c not in KEYS]
    old = stored.select(*KEYS, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_old"))
    both = old.join(fresh, KEYS, "full_outer")
    values = [
        F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in rest
    ]
    outcome = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "inserted")
        .otherwise("updated")
    )
    return both.select(*KEYS, *values, outcome.alias("outcome"))


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.count_if(F.col("outcome") == "updated").alias("updated"),
    )
