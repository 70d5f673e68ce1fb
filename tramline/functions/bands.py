"""Bands, labels and identities of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import RAIL_TYPES, ROUTE_TYPE_NAMES, STATUS_LABELS


def first_match(rules: list[tuple[Column, str]], default: str | None) -> Column:
    chain = None
    for test, name in rules:
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(F.lit(default))


def mode_of(route_type: Column) -> Column:
    """rail / bus / other."""
    return first_match(
        [(route_type.isin(RAIL_TYPES), "rail"), (route_type == "3", "bus")], "other"
    )


def is_rail(route_type: Column) -> Column:
    return F.coalesce(route_type.isin(RAIL_TYPES), F.lit(False))


def type_name(route_type: Column) -> Column:
    """light_rail / heavy_rail / commuter_rail / bus / other."""
    return first_match([(route_type == k, v) for k, v in ROUTE_TYPE_NAMES.items()], "other")


def punctuality_band(delay: Column) -> Column:
    return first_match(
        [
            (delay.isNull(), "unknown"),
            (delay < -300, "early"),
            (delay <= 300, "on_time"),
            (delay <= 900, "late"),
        ],
        "very_late",
    )


def headway_band(minutes: Column) -> Column:
    return first_match(
        [
            (minutes.isNull() | (minutes == 0), "unknown"),
            (minutes < 15, "under15"),
            (minutes < 30, "to30"),
            (minutes < 60, "to60"),
        ],
        "over60",
    )


def frequency_label(minutes: Column) -> Column:
    """Table label; unlike the band its ends are closed."""
    return first_match(
        [(minutes <= 0, "—"), (minutes <= 15, "High"), (minutes <= 30, "Moderate")], "Low"
    )


def movement_band(status: Column) -> Column:
    return first_match(
        [(status == 0, "incoming"), (status == 1, "stopped"), (status == 2, "in_transit")],
        "unknown",
    )


def status_label(status: Column) -> Column:
    """Name of a reported status.

    0 and null have no label on the board: a zero counts as missing there.
    """
    return first_match(
        [(status == k, v) for k, v in STATUS_LABELS.items() if k != 0], None
    )


def occupancy_key(status: Column) -> Column:
    return F.coalesce(status, F.lit("UNKNOWN"))


def vehicle_key(label: Column, vehicle_id: Column, route_id: Column, trip_id: Column) -> Column:
    return F.coalesce(
        label, vehicle_id, F.concat(route_id, F.lit(":"), F.coalesce(trip_id, F.lit("?")))
    )


def natural_key(name: Column) -> list[Column]:
    """Sort columns: digit-only names by number, then the others by text."""
    text = F.coalesce(name, F.lit(""))
    digits = text.rlike("^[0-9]+$")
    return [
        F.when(digits, 0).otherwise(1).asc(),
        F.when(digits, text.try_cast("decimal(38,0)")).asc_nulls_last(),
        text.asc(),
    ]
