"""Clock arithmetic: timetable times, service days, local calendar keys."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import ZONE


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def shift(ts: Column, seconds: Column | int | float) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return from_micros(micros(ts) + F.rint(amount.cast("double") * 1_000_000).cast("long"))


def gtfs_seconds(text: Column) -> Column:
    """'HH:MM:SS' to seconds; hours may pass 24, anything malformed or past 32 bits is null."""
    parts = F.split(F.trim(text), ":")
    number = [F.trim(F.try_element_at(parts, F.lit(i))).try_cast("int").cast("long") for i in (1, 2, 3)]
    return F.when(
        F.size(parts) == 3, number[0] * 3600 + number[1] * 60 + number[2]
    ).try_cast("int")


def hour_minute(seconds: Column) -> Column:
    """Seconds to 'HH:MM', hours folded into one day."""
    hours = F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", hours, minutes))


def local(ts: Column, zone: str = ZONE) -> Column:
    """The wall-clock reading of an instant, as a value for keys and display."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def local_hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(local(ts, zone))


def local_dow(ts: Column, zone: str = ZONE) -> Column:
    """Day of the week with Sunday = 0."""
    return F.dayofweek(local(ts, zone)) - 1


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.date_trunc("day", local(ts, zone)).cast("timestamp_ntz")


def five_minutes(ts: Column) -> Column:
    return F.date_trunc("hour", ts) + F.make_dt_interval(
        F.lit(0), F.lit(0), (F.floor(F.minute(ts) / 5) * 5).cast("int"), F.lit(0)
    )


def scheduled_instant(service_date: Column, seconds: Column, zone: str = ZONE) -> Column:
    """Local midnight plus seconds on the wall clock, then to UTC."""
    wall = service_date.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)


def service_day(actual: Column, seconds: Column, zone: str = ZONE) -> Column:
    """struct(service_date, scheduled_time, delay): the nearest of today and yesterday.

    Today wins a tie.
    """
    today = local_date(actual, zone)
    options = []
    for date in (today, F.date_sub(today, 1)):
        when = scheduled_instant(date, seconds, zone)
        options.append(
            F.struct(
                date.alias("service_date"),
                when.alias("scheduled_time"),
                seconds_between(actual, when).alias("delay"),
            )
        )
    return F.when(
        F.abs(options[0]["delay"]) <= F.abs(options[1]["delay"]), options[0]
    ).otherwise(options[1])


def wall_seconds(ts: Column, service_date: Column, zone: str = ZONE) -> Column:
    """Wall-clock seconds of an instant since the service date's midnight."""
    return (micros(local(ts, zone)) - micros(service_date.cast("timestamp"))) / F.lit(1_000_000.0)


def local_midnight(date: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def resolve_range(
    start: dt.date | None,
    end: dt.date | None,
    *,
    today: dt.date,
    default_days: int = 7,
    max_span_days: int = 366,
) -> tuple[dt.date, dt.date]:
    """Fill in a missing start or end date; a future end becomes today."""
    end = today if end is None else min(end, today)
    start = start if start is not None else end - dt.timedelta(days=default_days - 1)
    if start > end:
        raise ValueError("start must be on or before end")
    span = (end - start).days + 1
    if span > max_span_days:
        raise ValueError(f"range too wide: {span} days (max {max_span_days})")
    return start, end


def day_bounds(start: dt.date, end: dt.date, zone: str = ZONE) -> tuple[dt.datetime, dt.datetime]:
    """UTC instants of local midnight on ``start`` and after ``end``; half open."""
    tz = ZoneInfo(zone)
    edges = [
        dt.datetime.combine(day, dt.time.min, tzinfo=tz).astimezone(dt.timezone.utc)
        for day in (start, end + dt.timedelta(days=1))
    ]
    return edges[0], edges[1]


def instant(value: dt.datetime) -> Column:
    """A literal instant; literals keep partition pruning and filter push-down."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    text = value.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


# Accepted month spellings, tried in this order.
MONTH_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}/\d{1,2}$", "yyyy/M"),
    (r"^\d{1,2}/\d{4}$", "M/yyyy"),
    (r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"),
    (r"^[A-Z][a-z]{3,} \d{4}$", "MMMM yyyy"),
    (r"^\d{6}$", "yyyyMM"),
]


def parse_month(text: Column) -> Column:
    """First day of the month a text names, or null."""
    value = F.trim(text)
    words = F.initcap(F.lower(value))
    tries = [
        F.when(
            words.rlike(pattern), F.to_date(F.try_to_timestamp(words, F.lit(fmt)))
        )
        for pattern, fmt in MONTH_FORMATS
    ]
    return F.trunc(F.coalesce(*tries), "month")


def parse_count(text: Column) -> Column:
    """'1,234' or '12.5' to a rounded whole number, or null; NaN and infinities are null."""
    value = F.rint(F.trim(F.regexp_replace(text, ",", "")).try_cast("double"))
    return F.when(~F.isnan(value), value).try_cast("long")


def parse_iso(text: Column) -> Column:
    """ISO text, 'Z' allowed and seconds optional, to an instant or null."""
    plain = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(plain),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mmXXX")),
    )
