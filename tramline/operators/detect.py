"""Arrival detection: stored positions against the timetable.

Shape of the job
----------------
1. ``project``: one row-level pass per fix (no shuffle beyond the join with the
   timetable): route distance, nearest timepoint, distances to both ends.
2. One shuffle by (trip, stretch of hours). No rule looks further than the longest silence,
   so the fixes near the ends of a stretch are copied to the ones beside it.
3. Windows inside (trip, stretch) for the wanted rules, all over that one partitioning; the
   candidates of a row are exploded from one array. A trip's departure and its terminus
   fallback of a service day are picked by an aggregate over few rows.
4. ``settle``: stop details by equi-join, delay limit, alias guard by existence
   joins, then first event per stop and closing of finished runs.

A trip that fills a third of the table is spread over its stretches of hours, also where all
its fixes are of one day.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import DetectionConfig
from tramline.functions.bands import is_rail
from tramline.functions.geo import along_leg, haversine_m, leg, leg_terms, metres_of_term
from tramline.functions.numbers import round_int
from tramline.functions.times import (
    instant,
    micros,
    seconds_between,
    service_day,
    shift,
    wall_seconds,
)
from tramline.operators.blocks import by_merge, range_block
from tramline.operators.timetable import numbered
from tramline.session import stored

GEOFENCE, SEGMENT = "geofence", "segment"
ORIGIN, TERMINUS = "origin_departure", "terminus_fallback"
METHODS = (GEOFENCE, SEGMENT, ORIGIN, TERMINUS)
LEGS_PER_ROW = 512
# Seconds of a trip's fixes that lie together, four times the longest silence at least.
TIME_BLOCK = 14_400
CLOSEST = (
    "struct<terminus_m:double,timestamp:timestamp,id:bigint,latitude:double,longitude:double,"
    "bearing:double,route_id:string,n_tp:int>"
)
SPELL = f"struct<block:bigint,spell:bigint,closest:{CLOSEST},arrived:boolean,last:timestamp>"

# Order of candidates within one instant: first those a row brings, in row order
# and by rule, then those brought by silence.
RANK = {ORIGIN: 0, SEGMENT: 1, GEOFENCE: 2, TERMINUS: 3}
ORDER = ["emit_time", "phase", "row_id", "rank", "tp_no"]


@dataclass(frozen=True)
class TripLines:
    """Timepoints numbered per trip, and the trips' legs with both ends beside them."""

    numbered: DataFrame
    legs: DataFrame

    def stored(self) -> TripLines:
        """The same, computed once: several branches of the job read them."""
        return TripLines(stored(self.numbered, "timepoints"), stored(self.legs, "legs"))


def trip_lines(points: DataFrame) -> TripLines:
    """``points``: trip_id, stop_sequence, stop_id, arrival_secs, stop_lat, stop_lon, dist_m."""
    place = F.struct("stop_lat", "stop_lon", "dist_m")
    around = numbered(points, place)
    end = F.struct("stop_sequence", "arrival_secs", "stop_lat", "stop_lon", "dist_m")
    heads = around.groupBy("trip_id").agg(
        F.max("tp_no").alias("n_tp"),
        F.min_by(end, "tp_no").alias("origin"),
        F.max_by(end, "tp_no").alias("terminus"),
        F.max_by("prev_sample.dist_m", "tp_no").alias("before_last_m"),
    )
    single = F.col("prev_sample").isNull() & F.col("next_sample").isNull()
    other = F.coalesce("next_sample", place)
    numbered_leg = F.struct(
        "tp_no",
        leg(
            F.col("stop_lat"), F.col("stop_lon"), F.col("dist_m"),
            other["stop_lat"], other["stop_lon"], other["dist_m"],
        ).alias("leg"),
    )
    legs = (
        around.filter(F.col("next_sample").isNotNull() | single)
        .groupBy("trip_id", range_block(F.col("tp_no") - 1, LEGS_PER_ROW).alias("chunk"))
        .agg(F.sort_array(F.collect_list(numbered_leg)).alias("n"))
        .select("trip_id", "chunk", "n.leg", F.col("n")[0]["tp_no"].alias("first_no"))
        .withColumnRenamed("leg", "legs")
        .join(by_merge(heads), "trip_id")
    )
    return TripLines(around.drop("prev_sample", "next_sample"), legs)


FIX = [
    "id", "trip_id", "route_id", "latitude", "longitude", "bearing", "current_stop_sequence",
    "timestamp",
]


def project(
    positions: DataFrame, lines: TripLines, routes: DataFrame | None,
    cfg: DetectionConfig = DetectionConfig(), chunked: bool | None = None,
) -> DataFrame:
    """Everything about a fix that needs no other fix.

    Fixes without coordinates stay: they still come between two others. A trip with
    more legs than fit one row is met row by row and the nearest leg picked after;
    ``chunked`` says whether any such trip exists and is looked up when not given.
    """
    fixes = positions.select(*FIX).filter(F.coalesce("trip_id", F.lit("")) != "")
    if routes is None:
        fixes = fixes.withColumn("rail", F.lit(False))
    else:
        rail = routes.select("route_id", is_rail(F.col("route_type")).alias("rail"))
        fixes = fixes.join(rail, "route_id", "left").fillna(False, ["rail"])
    lat, lon = F.col("latitude"), F.col("longitude")
    met = (
        fixes.join(by_merge(lines.legs), "trip_id")
        .withColumn("_cos", F.cos(F.radians(lat)))
        .withColumn("_terms", F.when(lat.isNotNull() & lon.isNotNull(), leg_terms(lat, lon, F.col("_cos"), F.col("legs"))))
        .withColumn("term", F.array_min("_terms"))
        .withColumn("_at", F.array_position("_terms", F.col("term")).cast("int"))
        .withColumn("on", F.element_at("legs", F.col("_at")))
        .withColumn("a_no", F.col("first_no") + F.col("_at") - 1)
        .drop("legs", "_cos", "_terms", "_at", "first_no")
    )
    if chunked is None:
        chunked = not lines.legs.filter(F.col("chunk") > 0).isEmpty()
    if chunked:
        best = F.struct(F.coalesce("term", F.lit(0.0)), F.col("chunk"))
        rest = [c for c in met.columns if c not in ("trip_id", "id")]
        met = (
            met.groupBy("trip_id", "id")
            .agg(F.min_by(F.struct(*rest), best).alias("r"))
            .select("trip_id", "id", "r.*")
        )
    radius = F.when(F.col("rail"), F.lit(cfg.radius_rail)).otherwise(F.lit(cfg.radius))
    wide = F.when(F.col("rail"), F.lit(cfg.terminus_radius_rail)).otherwise(F.lit(cfg.terminus_radius))
    many = F.col("n_tp") >= 2
    on, a_no, proj = F.col("on"), F.col("a_no"), F.col("proj")
    met = met.withColumn("_share", along_leg(lat, lon, on)).withColumn(
        "proj",
        F.when(F.col("_share") >= 1, on["end_dist"]).otherwise(
            on["dist"] + F.col("_share") * (on["end_dist"] - on["dist"])
        ),
    )
    leg_end = on["end_dist"]
    gap_a, gap_b = F.abs(proj - on["dist"]), F.abs(proj - leg_end)
    use_a = (a_no != 1) & (gap_a <= gap_b)
    nearest = F.when(use_a, F.struct(a_no.alias("no"), gap_a.alias("gap"))).when(
        many, F.struct((a_no + 1).alias("no"), gap_b.alias("gap"))
    )
    lateral = metres_of_term(F.col("term"))
    near_end = F.least(wide, (F.col("terminus.dist_m") - F.col("before_last_m")) / 2)
    columns = {
        "lateral": lateral,
        "radius": radius,
        # Timepoints at or before the projected point.
        "passed": F.when(many & (proj >= leg_end), a_no + 1).otherwise(a_no),
        "geofence_no": F.when((lateral <= radius) & (nearest["gap"] <= radius), nearest["no"]),
        "origin_m": haversine_m(lat, lon, F.col("origin.stop_lat"), F.col("origin.stop_lon")),
        "past_origin": F.col("current_stop_sequence").isNull()
        | (F.col("current_stop_sequence") > F.col("origin.stop_sequence")),
        "progressed": ~many | (proj - F.col("origin.dist_m") >= cfg.origin_radius * 0.5),
        "terminus_m": haversine_m(lat, lon, F.col("terminus.stop_lat"), F.col("terminus.stop_lon")),
        "end_radius": F.when(many, near_end).otherwise(wide),
        "approached": ~many | (proj >= F.col("before_last_m")),
    }
    days = {
        "origin_day": service_day(F.col("timestamp"), F.col("origin.arrival_secs"), cfg.zone)["service_date"],
        "terminus_day": service_day(F.col("timestamp"), F.col("terminus.arrival_secs"), cfg.zone)["service_date"],
    }
    return (
        met.withColumns(columns)
        .withColumns(days)
        .select(*FIX, "n_tp", "proj", *columns, *days)
    )


def _candidate(method: str, when: Column, **fields: Column) -> Column:
    """A candidate struct, null unless ``when`` holds."""
    defaults = {
        "method": F.lit(method),
        "tp_no": F.lit(None).cast("int"),
        "actual_time": F.col("timestamp"),
        "lat": F.col("latitude"),
        "lon": F.col("longitude"),
        "bearing": F.col("bearing"),
        "emit_time": F.col("timestamp"),
        "phase": F.lit(0),
        "row_id": F.col("id").cast("long"),
        "rank": F.lit(RANK[method]),
        "from": F.lit(None).cast("struct<timestamp:timestamp,latitude:double,longitude:double,proj:double>"),
        "to_proj": F.lit(None).cast("double"),
        "route_id": F.col("route_id"),
        "n_tp": F.col("n_tp"),
        "fix_time": F.col("timestamp"),
        "fix_id": F.col("id"),
        "day": F.col("day"),
        "part": F.lit(None).cast(SPELL),
    }
    body = {**defaults, **fields}
    return F.when(when, F.struct(*[value.alias(name) for name, value in body.items()]))


def placed() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def in_blocks(projected: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Fixes by trip and stretch of time; ``own`` are a block's fixes.

    No rule looks further back or ahead than the longest silence, so each block also gets the
    fixes that near its two ends from the blocks beside it, and no row needs more.
    """
    reach = max(cfg.origin_silence, cfg.terminus_silence, cfg.segment_max_gap) * 1_000_000
    width = max(TIME_BLOCK * 1_000_000, 4 * reach)
    at = micros(F.col("timestamp"))
    block = F.floor(at / F.lit(width))
    into = at - block * F.lit(width)
    beside = F.array_compact(F.array(
        block, F.when(into <= reach, block - 1), F.when(F.lit(width) - into <= reach, block + 1)))
    return (
        projected.withColumn("_home", block).withColumn("block", F.explode(beside))
        .withColumn("own", F.col("block") == F.col("_home")).drop("_home")
        .repartition("trip_id", "block")
    )


def _with_crossings(rows: DataFrame, cfg: DetectionConfig) -> tuple[DataFrame, Column]:
    """Timepoints passed between two fixes in the corridor."""
    series = Window.partitionBy("trip_id", "block").orderBy("timestamp", "id")
    here = F.struct("timestamp", "latitude", "longitude", "proj", "lateral", "passed")
    rows = rows.withColumn("prev", F.lag(here).over(series))
    gap = seconds_between(F.col("timestamp"), F.col("prev.timestamp"))
    corridor = F.col("radius") * cfg.corridor_factor
    moved = (
        F.col("own") & placed() & (gap > 0) & (gap <= cfg.segment_max_gap)
        & (F.col("prev.lateral") <= corridor) & (F.col("lateral") <= corridor)
        & (F.col("proj") > F.col("prev.proj")) & (F.col("passed") > F.col("prev.passed"))
    )
    first = F.greatest(F.col("prev.passed") + 1, F.lit(2))
    numbers = F.when(moved & (F.col("passed") >= first), F.sequence(first, F.col("passed")))
    origin = F.struct(*[F.col(f"prev.{c}").alias(c) for c in ("timestamp", "latitude", "longitude", "proj")])
    return rows, F.transform(numbers, lambda no: _candidate(
        SEGMENT, F.lit(True), tp_no=no, to_proj=F.col("proj"), **{"from": origin}))


def _with_departures(rows: DataFrame, cfg: DetectionConfig, watermark: dt.datetime | None) -> tuple[DataFrame, Column]:
    """Each fix inside the origin's circle opens an epoch; what follows it until the next one
    either confirms the departure, denies it, or says nothing."""
    keys = ["trip_id", "origin_day", "block"]
    series = Window.partitionBy(*keys).orderBy("timestamp", "id")
    run = Window.partitionBy(*keys, "epoch")
    ts = F.col("timestamp")
    at_origin = F.coalesce(F.col("origin_m") <= cfg.origin_radius, F.lit(False))
    rows = rows.withColumn("at_origin", at_origin).withColumns({
        "next_time": F.lead("timestamp").over(series),
        "next_at_origin": F.lead("at_origin").over(series),
        "epoch": F.sum(F.col("at_origin").cast("int")).over(series.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("inside_time", F.min(F.when(F.col("at_origin"), ts)).over(run))
    outside = (
        placed() & ~F.col("at_origin") & (F.col("epoch") > 0) & F.col("past_origin")
        & (seconds_between(ts, F.col("inside_time")) <= cfg.origin_silence)
    )
    rows = rows.withColumn("outside", F.coalesce(outside, F.lit(False)))
    rows = rows.withColumns({
        "first_out": F.min(F.when(F.col("outside"), F.struct("timestamp", "id", "origin_m"))).over(run),
        "confirm": F.min(F.when(F.col("outside") & F.col("progressed"), F.struct("timestamp", "id"))).over(run),
        "denied": F.max(F.col("outside") & ~F.col("progressed")).over(run),
        "back_at": F.max(F.when(F.col("next_at_origin"), F.col("next_time"))).over(run),
    })
    confirmed = F.col("confirm").isNotNull()
    back = F.coalesce(seconds_between(F.col("back_at"), ts) <= cfg.origin_silence, F.lit(False))
    quiet = ~confirmed & ~back & ~F.coalesce("denied", F.lit(False))
    if watermark is not None:
        quiet = quiet & (shift(ts, cfg.origin_silence) <= instant(watermark))
    span = F.col("first_out.origin_m") - F.col("origin_m")
    share = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), (F.lit(cfg.origin_radius) - F.col("origin_m")) / span)
    )
    crossing = F.when(span <= 0, F.col("first_out.timestamp")).otherwise(
        shift(ts, seconds_between(F.col("first_out.timestamp"), ts) * share)
    )
    return rows, F.array(_candidate(
        ORIGIN,
        F.col("own") & F.col("at_origin") & (confirmed | quiet),
        tp_no=F.lit(1),
        actual_time=F.when(confirmed, crossing).otherwise(ts),
        emit_time=F.when(confirmed, F.col("confirm.timestamp")).otherwise(shift(ts, cfg.origin_silence)),
        phase=F.when(confirmed, 0).otherwise(1),
        row_id=F.when(confirmed, F.col("confirm.id")).otherwise(F.lit(0)).cast("long"),
        day=F.col("origin_day"),
    ))


def _with_approaches(rows: DataFrame, cfg: DetectionConfig) -> tuple[DataFrame, Column]:
    """A terminus approach lasts as long as the trip keeps reporting: a longer silence ends the
    spell. Of each block's part of a spell its last fix carries the summary."""
    keys = ["trip_id", "terminus_day", "block"]
    series = Window.partitionBy(*keys).orderBy("timestamp", "id")
    spell = Window.partitionBy(*keys, "spell")
    ts = F.col("timestamp")
    rows = rows.withColumn(
        "last_ending", F.last(F.when(placed(), ts), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.col("own") & placed() & F.coalesce(
        seconds_between(ts, F.col("last_ending")) > cfg.terminus_silence, F.lit(True))
    own = F.col("own") & placed()
    arrived = own & (F.col("terminus_m") <= F.col("radius"))
    approach = own & ~arrived & (F.col("terminus_m") <= F.col("end_radius")) & F.col("approached")
    rows = rows.withColumns({
        "spell": F.sum(starts.cast("int")).over(series.rowsBetween(Window.unboundedPreceding, 0)),
        "arrived": F.coalesce(arrived, F.lit(False)), "approach": F.coalesce(approach, F.lit(False)),
    })
    closest = F.struct("terminus_m", "timestamp", "id", "latitude", "longitude", "bearing", "route_id", "n_tp")
    rows = rows.withColumns({
        "spell_closest": F.min(F.when(F.col("approach"), closest)).over(spell),
        "spell_arrived": F.max("arrived").over(spell),
        "spell_last": F.max(F.when(own, F.struct("timestamp", "id"))).over(spell),
    })
    part = F.struct(
        "block", "spell", F.col("spell_closest").alias("closest"), F.col("spell_arrived").alias("arrived"),
        F.col("spell_last.timestamp").alias("last"))
    return rows, F.array(_candidate(
        TERMINUS, own & (F.col("spell_last.id") == F.col("id")) & (F.col("spell_last.timestamp") == ts),
        day=F.col("terminus_day"), part=part))


def _first_spell(parts: Column, cfg: DetectionConfig, watermark: dt.datetime | None) -> Column:
    """The fallback of a trip's day, from the summaries of its spells in order of time.

    The first spell with an approach decides; an arrival up to its end rules the fallback out.
    """
    none = F.struct(
        F.lit(False).alias("over"), F.lit(None).cast(CLOSEST).alias("closest"),
        F.lit(False).alias("arrived"), F.lit(None).cast("timestamp").alias("last"))

    def add(so_far: Column, part: Column) -> Column:
        over = so_far["over"] | ((part["spell"] > 0) & so_far["closest"].isNotNull())
        return F.struct(
            over.alias("over"),
            F.when(over, so_far["closest"]).otherwise(F.least(so_far["closest"], part["closest"])).alias("closest"),
            F.when(over, so_far["arrived"]).otherwise(so_far["arrived"] | part["arrived"]).alias("arrived"),
            F.when(over, so_far["last"]).otherwise(part["last"]).alias("last"))

    def event(hit: Column) -> Column:
        best = hit["closest"]
        ended = best.isNotNull() & ~hit["arrived"]
        if watermark is not None:
            ended = ended & (shift(hit["last"], cfg.terminus_silence) <= instant(watermark))
        return _candidate(
            TERMINUS, ended, tp_no=best["n_tp"], actual_time=best["timestamp"], lat=best["latitude"], lon=best["longitude"],
            bearing=best["bearing"], route_id=best["route_id"], n_tp=best["n_tp"], fix_time=best["timestamp"],
            fix_id=best["id"], day=F.lit(None).cast("date"),
            emit_time=shift(hit["last"], cfg.terminus_silence), phase=F.lit(1), row_id=F.lit(0).cast("long"))

    return F.transform(F.array(F.aggregate(F.sort_array(parts), none, add)), event)[0]


def candidates(
    projected: DataFrame, cfg: DetectionConfig = DetectionConfig(),
    watermark: dt.datetime | None = None, methods: tuple[str, ...] = METHODS,
) -> DataFrame:
    """Possible events of the wanted rules, not yet checked against each other.

    With a watermark only silences that had passed by then are resolved; without
    one the end of the data resolves everything.

    One shuffle brings a trip's stretches of time together; departures and terminus fallbacks,
    of which a trip has one a day, are then picked by an aggregate over the few fixes that may
    be one and over one summary for each spell and stretch.
    """
    rows, found = projected.withColumn("day", F.lit(None).cast("date")), []
    if methods != (GEOFENCE,):
        rows = in_blocks(rows, cfg)
    own = F.col("own") if methods != (GEOFENCE,) else F.lit(True)
    if GEOFENCE in methods:
        found.append(F.array(_candidate(
            GEOFENCE, own & placed() & F.col("geofence_no").isNotNull(), tp_no=F.col("geofence_no"))))
    if SEGMENT in methods:
        rows, crossed = _with_crossings(rows, cfg)
        found.append(F.coalesce(crossed, F.array()))
    if ORIGIN in methods:
        rows, left = _with_departures(rows, cfg, watermark)
        found.append(left)
    if TERMINUS in methods:
        rows, spells = _with_approaches(rows, cfg)
        found.append(spells)
    told = rows.select("trip_id", F.explode(F.array_compact(F.concat(*found))).alias("c"))
    if ORIGIN in methods or TERMINUS in methods:
        once = F.col("c.method").isin(ORIGIN, TERMINUS)
        told = told.groupBy(
            "trip_id", "c.method", "c.day", F.when(~once, F.col("c.row_id")).alias("row"), F.when(~once, F.col("c.tp_no")).alias("no"),
        ).agg(F.min_by("c", F.struct("c.fix_time", "c.fix_id")).alias("c"), F.collect_list("c.part").alias("parts"))
        told = told.select("trip_id", F.when(
            F.col("c.method") == TERMINUS, _first_spell(F.col("parts"), cfg, watermark),
        ).otherwise(F.col("c")).alias("c")).filter(F.col("c").isNotNull())
    return told.select("trip_id", "c.*").drop("day", "part", "fix_time", "fix_id")


def with_stops(
    found: DataFrame, lines: TripLines, cfg: DetectionConfig = DetectionConfig(), untimed: str | None = None
) -> DataFrame:
    """Candidates with their stop, interpolated where crossed, on their service date,
    within the delay limit.

    Rows of the method ``untimed`` have no stop and stay.
    """
    stops = lines.numbered.select(
        "trip_id", "tp_no", "stop_sequence", "stop_id", "arrival_secs", F.col("dist_m").alias("tp_m")
    )
    rows = found.join(by_merge(stops), ["trip_id", "tp_no"], "left" if untimed else "inner")
    stays = F.col("method") == untimed if untimed else F.lit(False)
    if untimed:
        rows = rows.filter(stays | F.col("stop_id").isNotNull())
    origin, to = F.col("from"), F.col("to_proj")
    crossed = origin.isNotNull()
    share = (F.col("tp_m") - origin["proj"]) / (to - origin["proj"])
    moment = shift(origin["timestamp"], seconds_between(F.col("actual_time"), origin["timestamp"]) * share)
    rows = rows.filter(~crossed | ((origin["proj"] < F.col("tp_m")) & (F.col("tp_m") <= to))).withColumns(
        {
            "actual_time": F.when(crossed, moment).otherwise(F.col("actual_time")),
            "lat": F.when(crossed, origin["latitude"] + (F.col("lat") - origin["latitude"]) * share).otherwise(F.col("lat")),
            "lon": F.when(crossed, origin["longitude"] + (F.col("lon") - origin["longitude"]) * share).otherwise(F.col("lon")),
        }
    )
    day = service_day(F.col("actual_time"), F.col("arrival_secs"), cfg.zone)
    rows = rows.withColumn("_day", day).filter(stays | (F.abs("_day.delay") <= cfg.max_delay))
    return rows.select(
        "trip_id", "route_id", "stop_id", "stop_sequence",
        F.col("_day.scheduled_time").alias("scheduled_time"), "actual_time",
        F.col("_day.delay").alias("delay"),
        F.col("_day.service_date").alias("service_date"),
        F.col("lat").alias("actual_lat"), F.col("lon").alias("actual_lon"),
        F.col("bearing").alias("actual_bearing"), F.col("method").alias("detection_method"),
        (F.col("tp_no") == F.col("n_tp")).alias("is_last"), *ORDER,
    )


def activity(positions: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """First and last sighting of each trip per window-wide time bin."""
    width = cfg.alias_active_window * 1_000_000
    return (
        positions.filter(F.coalesce("trip_id", F.lit("")) != "")
        .groupBy("trip_id", F.floor(micros(F.col("timestamp")) / F.lit(width)).alias("bin"))
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )


def _bins(value: Column, reach: int, width: int) -> Column:
    low, high = F.floor((value - reach) / width), F.floor((value + reach) / width)
    return F.explode(F.sequence(low, high))


def _outermost(slots: DataFrame, seen: DataFrame, place: list[str]) -> DataFrame:
    """Sightings that can answer for a place, under the time ``bin`` of the events they answer to:
    of the two trips seen last in the bin before, and of the two seen first in that and the next.

    ``seen`` has one row for each trip and bin.
    """
    sighted = slots.select(*place, "trip_id").distinct().join(by_merge(seen), "trip_id").withColumnRenamed("trip_id", "s_trip")

    def two(order: Column, *bins: Column) -> DataFrame:
        first = Window.partitionBy(*place, "bin").orderBy(order)
        return (
            sighted.withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= 2).drop("_no")
            .withColumn("bin", F.explode(F.array(*bins)))
        )

    bin_ = F.col("bin")
    return two(F.col("last_seen").desc(), bin_ + 1).unionByName(two(F.col("first_seen").asc(), bin_, bin_ - 1))


def alias_guard(
    events: DataFrame, slots: DataFrame, seen: DataFrame, cfg: DetectionConfig = DetectionConfig()
) -> DataFrame:
    """Drop very late or early events that fall on another trip's slot at the same
    stop, unless such a trip was itself reported around then.

    Sightings count up to the moment the event became known, which is never before it
    happened. No event meets the trips due, of which one stop can have very many: slots of one
    place (route, stop, time of day) are one row, and a place's sightings of a time bin are
    those of the two trips seen last and the two seen first there. Of the bin before an event's
    only the last sighting counts, of its own and the next only the first, and the second
    trip answers where the first one is the event's own. Each suspicious event meets
    the places in reach and at most six sightings of each.
    """
    keys = ["trip_id", "route_id", "stop_id", "service_date", "actual_time", "emit_time"]
    place = ["route_id", "stop_id", "arrival_secs"]
    reach = cfg.alias_max_gap
    width = 2 * reach
    window = cfg.alias_active_window
    secs = wall_seconds(F.col("actual_time"), F.col("service_date"), cfg.zone)
    suspects = (
        events.alias("e").filter(suspicious_of("e", cfg)).select(*keys).distinct()
        .withColumn("_secs", secs)
        .withColumn("s_bin", F.floor(F.col("_secs") / width))
        .withColumn("bin", F.floor(micros(F.col("actual_time")) / F.lit(window * 1_000_000)))
    )
    due = slots.groupBy(*place).agg(F.min("trip_id").alias("_low"), F.max("trip_id").alias("_high"))
    rivals = (
        suspects.join(due.withColumn("s_bin", _bins(F.col("arrival_secs"), reach, width)), ["route_id", "stop_id", "s_bin"])
        .filter((F.col("_low") != F.col("trip_id")) | (F.col("_high") != F.col("trip_id")))
        .filter(F.abs(F.col("arrival_secs") - F.col("_secs")) <= reach)
        .select(*keys, "arrival_secs", "bin")
    )
    around = (
        (F.col("s_trip") != F.col("trip_id"))
        & (F.col("last_seen") >= shift(F.col("actual_time"), -window))
        & (F.col("first_seen") <= F.least("emit_time", shift(F.col("actual_time"), window)))
    )
    aliases = (
        rivals.join(_outermost(slots, seen, place), [*place, "bin"], "left")
        .groupBy(*keys).agg(F.max(F.coalesce(around, F.lit(False))).alias("out"))
        .filter(~F.col("out"))
    )
    # A trusted event may share a suspicious one's key (a stop served twice), so the delay
    # is part of the condition.
    e, a = events.alias("e"), aliases.alias("a")
    same = [F.col(f"e.{k}") == F.col(f"a.{k}") for k in keys]
    return e.join(a, [suspicious_of("e", cfg), *same], "left_anti")


def suspicious_of(table: str, cfg: DetectionConfig) -> Column:
    return F.coalesce(F.abs(F.col(f"{table}.delay")) >= cfg.alias_min_delay, F.lit(True))


def first_per_stop(events: DataFrame) -> DataFrame:
    """The first event of each (trip, stop sequence, service date)."""
    keys = ["trip_id", "stop_sequence", "service_date"]
    rest = [c for c in events.columns if c not in keys]
    return (
        events.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*ORDER)).alias("r"))
        .select(*keys, "r.*")
    )


def close_runs(events: DataFrame) -> DataFrame:
    """Drop what a run adds after its terminus event.

    Comes after ``first_per_stop``, so a run holds one row per stop at most.
    """
    run = Window.partitionBy("trip_id", "service_date")
    place = F.struct(*ORDER)
    closed = events.withColumn("_end", F.min(F.when(F.col("is_last"), place)).over(run))
    return closed.filter(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")


def as_events(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        "trip_id", "route_id", "stop_id", "stop_sequence", "scheduled_time", "actual_time",
        round_int(F.col("delay")).cast("int").alias("delay_seconds"), "service_date",
        F.col("actual_time").alias("timestamp"), "actual_lat", "actual_lon", "actual_bearing",
        "detection_method", *more,
    )


def detect_arrivals(
    positions: DataFrame, points: DataFrame, slots: DataFrame, routes: DataFrame | None = None,
    cfg: DetectionConfig = DetectionConfig(), watermark: dt.datetime | None = None,
) -> DataFrame:
    """Stop events of stored positions.

    ``points`` is ``timetable.detection_timetable``, ``slots`` is
    ``timetable.stop_slots``.
    """
    lines = trip_lines(points).stored()
    found = with_stops(candidates(project(positions, lines, routes, cfg), cfg, watermark), lines, cfg)
    guarded = alias_guard(found, slots, activity(positions, cfg), cfg)
    return as_events(close_runs(first_per_stop(guarded)))
