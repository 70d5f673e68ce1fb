"""As-of joins in time: bracketing samples, nearest label, position at an instant.

Targets and samples are put in one ordered series per key and read with windows;
no target is ever paired with every sample of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import bearing_deg
from tramline.functions.times import micros
from tramline.operators.blocks import bracket, time_block

HOUR = 3600


def bracketing(
    targets: DataFrame, samples: DataFrame, keys: list[str], at: str, target_id: list[str],
    payload: list[str], block_seconds: int = HOUR, equal_is_before: bool = True,
) -> DataFrame:
    """Add ``prev_sample`` and ``next_sample`` around each target's instant ``at``.

    ``samples`` has ``timestamp`` and ``id``; a sample at the very instant counts
    as before or after the target.
    """
    side = 1 if equal_is_before else 0
    carried = F.struct(
        *[F.col(c) for c in payload], F.col("timestamp").alias("sample_time")
    ).alias("_payload")
    left = targets.select(
        *keys,
        F.col(at).alias("_t"),
        F.lit(side).alias("_side"),
        F.struct(*target_id).alias("_target"),
        F.lit(None).cast("long").alias("_id"),
        F.struct(*targets.columns).alias("_row"),
    )
    right = samples.select(
        *keys,
        F.col("timestamp").alias("_t"),
        F.lit(1 - side).alias("_side"),
        F.col("id").cast("long").alias("_id"),
        carried,
    )
    series = left.unionByName(right, allowMissingColumns=True)
    found = bracket(
        series, keys, ["_t", "_side", "_id", "_target"],
        time_block(F.col("_t"), block_seconds), F.col("_payload"),
    )
    return found.filter(F.col("_row").isNotNull()).select("_row.*", "prev_sample", "next_sample")


def nearest_label(
    targets: DataFrame, samples: DataFrame, keys: list[str], at: str, target_id: list[str],
    label: str, block_seconds: int = HOUR,
) -> DataFrame:
    """Add the label reported closest to each target; of equally close ones the earlier.

    Of several samples at one instant the first reported counts.
    """
    known = (
        samples.filter(F.col(label).isNotNull())
        .groupBy(*keys, "timestamp")
        .agg(F.min_by(label, "id").alias(label), F.min("id").alias("id"))
    )
    around = bracketing(targets, known, keys, at, target_id, [label], block_seconds)

    def gap(name: str) -> Column:
        return F.abs(micros(F.col(f"{name}.sample_time")) - micros(F.col(at)))

    before, after = gap("prev_sample"), gap("next_sample")
    pick = F.when(
        before.isNotNull() & (after.isNull() | (before <= after)), F.col(f"prev_sample.{label}")
    ).otherwise(F.col(f"next_sample.{label}"))
    return around.withColumn(label, pick).drop("prev_sample", "next_sample")


def position_at(
    targets: DataFrame, track: DataFrame, keys: list[str], at: str, target_id: list[str],
    block_seconds: int = HOUR,
) -> DataFrame:
    """Add lat, lon and travel bearing at an instant, linear between two samples.

    Before the first and after the last sample it stays there with the reported
    bearing; tracks without coordinates give nulls.
    """
    placed = track.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    around = bracketing(
        targets, placed, keys, at, target_id, ["latitude", "longitude", "bearing"],
        block_seconds, equal_is_before=False,
    )
    a, b = F.col("prev_sample"), F.col("next_sample")
    ta, tb, t = micros(a["sample_time"]), micros(b["sample_time"]), micros(F.col(at))
    share = (t - ta) / (tb - ta)
    inside = a.isNotNull() & b.isNotNull()

    def between(name: str) -> Column:
        return (
            F.when(inside, a[name] + (b[name] - a[name]) * share)
            .otherwise(F.coalesce(a[name], b[name]))
        )

    travel = F.when(
        inside,
        F.coalesce(
            bearing_deg(a["latitude"], a["longitude"], b["latitude"], b["longitude"]),
            a["bearing"], b["bearing"],
        ),
    ).otherwise(F.coalesce(a["bearing"], b["bearing"]))
    return around.select(
        *targets.columns,
        between("latitude").alias("at_lat"),
        between("longitude").alias("at_lon"),
        travel.alias("at_bearing"),
    )
