"""Ratios, means and the one-decimal rounding of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(value: Column) -> Column:
    """Round a double to one decimal, ties decided on its exact binary value.

    ``F.round`` and ``F.bround`` look at the shortest decimal text instead, which
    turns 0.15 (stored as 0.1499…) into 0.2. Near a tie ``20 * value`` and the odd
    integer it is compared with are within a factor of two of each other, so the
    two subtractions below are exact and ``side`` carries the true sign.
    """
    x = value.cast("double")
    low = F.floor(x * 10).cast("double")
    side = (x * 16 - (low * 2 + 1)) + x * 4
    whole = (
        F.when(side > 0, low + 1)
        .when(side < 0, low)
        .otherwise(low + F.pmod(low, F.lit(2.0)))
    )
    return whole / 10.0


def round_int(value: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(value.cast("double")).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """One-decimal percentage, 0 for an empty whole."""
    return F.when(
        whole > 0, round1((F.lit(100) * part).cast("double") / whole.cast("double"))
    ).otherwise(F.lit(0.0))


def capped_percent(part: Column, whole: Column) -> Column:
    return F.when(
        whole > 0,
        round1(F.least(F.lit(100.0), (F.lit(100) * part).cast("double") / whole.cast("double"))),
    ).otherwise(F.lit(0.0))


def mean(total: Column, count: Column) -> Column:
    return round1(ratio(total, count))


def mean_half_even(total: Column, count: Column) -> Column:
    """One-decimal mean of whole numbers, exact, ties to the even tenth; null for none."""
    rest = F.pmod(total * 10, count)
    low = ((total * 10 - rest) / count).cast("long")
    up = (rest * 2 > count) | ((rest * 2 == count) & (F.pmod(low, F.lit(2)) == 1))
    return F.when(count > 0, (low + up.cast("long")) / 10.0)


def population_sd(total: Column, squares: Column, count: Column) -> Column:
    """Population standard deviation from count, sum and sum of squares."""
    avg = ratio(total, count)
    variance = ratio(squares, count) - avg * avg
    return F.when(variance > 0, round1(F.sqrt(variance))).otherwise(F.lit(0.0))
