"""Ordered operators that cut each key's series into blocks.

A plain window puts the whole series of a key in one task. Here a window covers
one block (a time or sequence range) of a key, one summary row per block carries
what the next blocks need, and the windows over summaries only see one row per
block. A key with a third of all rows is then spread over as many tasks as it
has blocks.

Rows and summaries read the same shuffle: the summaries keep whole rows, so both
sides ask for the same columns and the second reading reuses the first exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.times import micros

ALL_BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def time_block(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def range_block(number: Column, width: int) -> Column:
    return F.floor(number / F.lit(width))


def by_merge(df: DataFrame) -> DataFrame:
    """A side of a join that has a row for each trip or timepoint, and so is never broadcast.

    Timetables repeat themselves and shrink in files to a small part of their rows; a join
    planned by the size of the files would gather millions of rows on the driver, and adaptive
    execution keeps such a plan where the other one needs a shuffle more.
    """
    return df.hint("merge")


def walk(
    df: DataFrame, keys: list[str], order: list[str], block: Column,
    sample: Column | None = None, totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add neighbours and running sums of an ordered series.

    ``prev_sample`` and ``next_sample`` are the nearest non-null ``sample`` strictly
    before and after each row; each entry of ``totals`` becomes an inclusive running
    sum. ``order`` must be unique within ``keys``.
    """
    totals = totals or {}
    part = [*keys, "_block"]
    rows = df.withColumn("_block", block)
    if sample is not None:
        rows = rows.withColumn("_sample", sample)
    for name, value in totals.items():
        rows = rows.withColumn(f"_value_{name}", value)
    rows = rows.repartition(*part)
    forward = Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in order])
    backward = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    behind = Window.partitionBy(*keys).orderBy(F.col("_block").asc()).rowsBetween(*ALL_BEFORE)
    ahead = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(*ALL_BEFORE)

    whole, place = F.struct(*rows.columns), F.struct(*order)
    local, summary, carried = {}, [], []
    if sample is not None:
        local["_prev"] = F.last("_sample", ignorenulls=True).over(forward.rowsBetween(*ALL_BEFORE))
        local["_next"] = F.last("_sample", ignorenulls=True).over(backward.rowsBetween(*ALL_BEFORE))
        there = F.when(F.col("_sample").isNotNull(), place)
        summary += [F.min_by(whole, there).alias("_first"), F.max_by(whole, there).alias("_last")]
        carried += [
            F.last("_last", ignorenulls=True).over(behind).alias("_from"),
            F.last("_first", ignorenulls=True).over(ahead).alias("_to"),
        ]
    else:
        summary.append(F.max_by(whole, place).alias("_last"))
        carried.append(F.last("_last", ignorenulls=True).over(behind).alias("_from"))
    for name in totals:
        local[f"_local_{name}"] = F.sum(f"_value_{name}").over(forward.rowsBetween(*SO_FAR))
        summary.append(F.sum(f"_value_{name}").alias(f"_sum_{name}"))
        carried.append(F.sum(f"_sum_{name}").over(behind).alias(f"_offset_{name}"))
    blocks = rows.groupBy(*part).agg(*summary).select(*part, *carried)
    out = rows.withColumns(local).join(blocks, part, "left")
    added = []
    if sample is not None:
        added += [
            F.coalesce("_prev", "_from._sample").alias("prev_sample"),
            F.coalesce("_next", "_to._sample").alias("next_sample"),
        ]
    first = F.col("_from").isNull()
    added += [
        (F.col(f"_local_{n}") + F.when(first, 0).otherwise(F.col(f"_offset_{n}"))).alias(n)
        for n in totals
    ]
    return out.select(*df.columns, *added)


def bracket(df: DataFrame, keys: list[str], order: list[str], block: Column, sample: Column) -> DataFrame:
    return walk(df, keys, order, block, sample)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, Column]
) -> DataFrame:
    return walk(df, keys, order, block, totals=values)
