import datetime as dt
import math
from zoneinfo import ZoneInfo

import naive
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.functions import bands, geo, numbers, times

UTC = dt.timezone.utc


def column(spark, values, kind, make):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_round1_is_round_of_the_binary_value(spark):
    ties = [0.25, 0.15, 0.35, 0.75, 2.675, 12.25, -0.25, -0.15, 0.05, 1e9 + 0.25, 0.0, -3.0]
    grid = [i / 100 for i in range(-500, 500)] + [100 * a / b for a in range(1, 40) for b in range(a, 41)]
    values = ties + grid
    assert column(spark, values, "double", numbers.round1) == [round(v, 1) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=50, max_size=200))
def test_round1_on_any_values(spark, values):
    assert column(spark, values, "double", numbers.round1) == [round(v, 1) for v in values]


def test_empty_wholes_give_zero(spark):
    row = spark.range(1).select(
        numbers.percent(F.lit(3), F.lit(0)), numbers.mean(F.lit(3), F.lit(0)),
        numbers.population_sd(F.lit(10), F.lit(20.0), F.lit(5)), numbers.capped_percent(F.lit(9), F.lit(3)),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 100.0)


def test_timetable_times(spark):
    texts = ["08:05:30", "25:10:00", " 7:00:01 ", "8:00", "a:b:c", "", None]
    assert column(spark, texts, "string", times.gtfs_seconds) == [29130, 90600, 25201, None, None, None, None]
    assert column(spark, [0, 90600, None], "int", times.hour_minute) == ["00:00", "01:10", None]


def test_schedule_over_clock_changes(spark):
    tz = ZoneInfo("America/Denver")
    days = [dt.date(2026, 3, 8), dt.date(2026, 11, 1), dt.date(2026, 6, 20)]
    for secs in (0, 5400, 9000, 10800, 90000):
        got = column(
            spark, days, "date",
            lambda d, s=secs: F.unix_seconds(times.scheduled_instant(d, F.lit(s))),
        )
        want = [
            int((dt.datetime(d.year, d.month, d.day, tzinfo=tz) + dt.timedelta(seconds=secs)).timestamp())
            for d in days
        ]
        assert got == want


def test_service_day_crosses_midnight(spark):
    # 00:10 local, scheduled 24:05 of the day before
    at = dt.datetime(2026, 6, 21, 6, 10, tzinfo=UTC)
    df = spark.createDataFrame([(at,)], "x timestamp")
    row = df.select(times.service_day(F.col("x"), F.lit(86700)).alias("d")).select("d.*").first()
    assert (row.service_date, row.delay) == (dt.date(2026, 6, 20), 300.0)


def test_ranges():
    today = dt.date(2026, 6, 20)
    assert times.resolve_range(None, None, today=today) == (dt.date(2026, 6, 14), today)
    assert times.resolve_range(None, dt.date(2027, 1, 1), today=today, default_days=1) == (today, today)
    low, high = times.day_bounds(dt.date(2026, 3, 8), dt.date(2026, 3, 8))
    assert high - low == dt.timedelta(hours=23)
    for bad in ((today, dt.date(2026, 6, 1)), (dt.date(2020, 1, 1), today)):
        try:
            times.resolve_range(*bad, today=today)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_months_and_counts(spark):
    texts = ["2026-04-15", "2026-04", "2026/04", "04/2026", "Apr 2026", "April 2026", "202604", "soon", " "]
    assert column(spark, texts, "string", times.parse_month) == [dt.date(2026, 4, 1)] * 7 + [None, None]
    assert column(spark, ["1,234", "12.5", "13.5", "", "x"], "string", times.parse_count) == [1234, 12, 14, None, None]


def test_iso(spark):
    got = column(spark, ["2026-09-10T01:10Z", "2026-09-10T01:10:00+02:00", "x"], "string",
                 lambda c: F.unix_seconds(times.parse_iso(c)))
    first = int(dt.datetime(2026, 9, 10, 1, 10, tzinfo=UTC).timestamp())
    assert got == [first, first - 7200, None]


def test_geo(spark):
    pairs = [(39.7, -105.0, 39.8, -104.9), (0.0, 0.0, 0.0, 1.0), (39.7, -105.0, 39.7, -105.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    rows = df.select(geo.haversine_m(*cols).alias("m"), geo.bearing_deg(*cols).alias("b")).collect()
    for row, pair in zip(rows, pairs):
        assert math.isclose(row.m, naive.metres(*pair), rel_tol=1e-12)
    assert math.isclose(rows[1].b, 90.0) and rows[2].b is None


def test_bands(spark):
    assert column(spark, [None, -301, -300, 300, 301, 900, 901], "int", bands.punctuality_band) == [
        "unknown", "early", "on_time", "on_time", "late", "late", "very_late"]
    assert column(spark, [None, 0.0, 14.9, 15.0, 30.0, 60.0], "double", bands.headway_band) == [
        "unknown", "unknown", "under15", "to30", "to60", "over60"]
    assert column(spark, [0.0, 15.0, 30.0, 30.1], "double", bands.frequency_label) == ["—", "High", "Moderate", "Low"]
    assert column(spark, [0, 1, 2, None], "int", bands.status_label) == [None, "STOPPED_AT", "IN_TRANSIT_TO", None]
    assert column(spark, ["0", "3", "7", None], "string", bands.mode_of) == ["rail", "bus", "other", "other"]


def test_natural_order(spark):
    names = ["15", "A", "120", "2", None, "FF1"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(*bands.natural_key(F.col("x"))).collect()] == ["2", "15", "120", None, "A", "FF1"]


def test_parsers_never_throw(spark):
    texts = ["999999:00:00", "-1:00:00", "99999999999:00:00", "1:2", ":::", "25:00:01"]
    assert column(spark, texts, "string", times.gtfs_seconds)[5] == 90_001
    assert column(spark, texts, "string", times.gtfs_seconds)[0] is None
    counts = ["NaN", "Infinity", "3000000000", "1e30", "-", "7"]
    assert column(spark, counts, "string", times.parse_count) == [None, None, 3_000_000_000, None, None, 7]
