"""Arrival detection as a stream: the batch rules with expiring state.

Two stateful steps follow ``detect.project``, which computes all that a fix says by itself:

1. ``TripDetector``, keyed by trip, holds the previous fix and, per service day, the open origin
   and the open terminus approach. It gives the candidates and, for each stretch of time, when
   the trip was sighted.
2. ``RouteGuard``, keyed by route, holds the sightings of the route's trips of the last stretches
   and, per trip and service day, the stops that have an event and whether the run is over. It
   applies the alias guard, the first event of each stop and the closing of finished runs.

Neither step reads stored positions or events. Every entry has an end: those of a trip go with
a timer some days after its last fix, also when it never reports again; those of a route go
when newer fixes of the route come in, and routes are few.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tramline.config import DetectionConfig
from tramline.functions.times import from_micros, micros, wall_seconds
from tramline.operators import detect

SIGHTED = "sighted"
OUTPUT = (
    "trip_id string, route_id string, n_tp int, method string, tp_no int, at long, lat double,"
    " lon double, bearing double, emit long, phase int, row_id long, rank int,"
    " from_at long, from_lat double, from_lon double, from_proj double, to_proj double"
)
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
SECOND = 1_000_000
DAY = 86_400 * SECOND
KEEP_DAYS = 3

FIX_STATE = "t long, lat double, lon double, proj double, lateral double, passed int"
SEAT = "t long, id long, lat double, lon double, bearing double, route_id string, n_tp int"
ORIGIN_STATE = f"{SEAT}, origin_m double, out_t long, out_m double, denied boolean, done boolean"
ENDING_STATE = f"{SEAT}, terminus_m double, seen long, done boolean"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _missing(value) -> bool:
    return value is None or value != value


def _plain(value):
    """A value as state takes it: no NaN, no numpy types."""
    if _missing(value):
        return None
    return value.item() if hasattr(value, "item") else value


class DayStates:
    """A map state by service day, read once and written back where it changed."""

    def __init__(self, state, schema: str) -> None:
        self.state, self.names = state, _names(schema)
        self.days = {key[0]: dict(zip(self.names, value)) for key, value in state.iterator()}
        self.before = {day: dict(entry) for day, entry in self.days.items()}

    def drop_before(self, day: str) -> None:
        self.days = {d: entry for d, entry in self.days.items() if d >= day}

    def save(self) -> None:
        for day in self.before.keys() - self.days.keys():
            self.state.removeKey((day,))
        for day, entry in self.days.items():
            if entry != self.before.get(day):
                self.state.updateValue((day,), tuple(_plain(entry.get(n)) for n in self.names))


class TripDetector(StatefulProcessor):
    """Candidates and sightings of one trip, fix by fix in time order.

    A batch's rows are seen before the timers its watermark releases, so every fix
    first settles what had been silent for too long; timers serve trips that stay
    away, and end their state.
    """

    def __init__(self, cfg: DetectionConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fix = handle.getValueState("fix", FIX_STATE)
        self.origins = handle.getMapState("origins", "day string", ORIGIN_STATE)
        self.endings = handle.getMapState("endings", "day string", ENDING_STATE)

    def _event(self, trip: str, row: dict, method: str, **fields) -> dict:
        base = {
            "trip_id": trip, "route_id": row["route_id"], "n_tp": row["n_tp"], "method": method,
            "at": row["t"], "lat": row["lat"], "lon": row["lon"], "bearing": row["bearing"],
            "emit": row["t"], "phase": 0, "row_id": row["id"], "rank": detect.RANK.get(method, 0),
        }
        return {**dict.fromkeys(COLUMNS), **base, **fields}

    def _settle_origins(self, trip: str, origins: DayStates, now: int, out: list, closed: bool) -> None:
        """Resolve origins silent at ``now``; a timer counts the last instant too."""
        limit = self.cfg.origin_silence * SECOND
        for day, seat in list(origins.days.items()):
            quiet = now - seat["t"]
            if not seat["done"] and (quiet > limit or (closed and quiet >= limit)):
                if seat["denied"]:
                    del origins.days[day]
                    continue
                seat["done"] = True
                out.append(self._event(
                    trip, seat, detect.ORIGIN, tp_no=1, emit=seat["t"] + limit, phase=1, row_id=0,
                ))

    def _settle_endings(self, trip: str, endings: DayStates, now: int, out: list, closed: bool) -> None:
        limit = self.cfg.terminus_silence * SECOND
        for best in endings.days.values():
            if best["done"]:
                continue
            quiet = now - best["seen"]
            if quiet > limit or (closed and quiet >= limit):
                best["done"] = True
                out.append(self._event(
                    trip, best, detect.TERMINUS, tp_no=best["n_tp"], emit=best["seen"] + limit,
                    phase=1, row_id=0,
                ))

    def _origin(self, trip: str, origins: DayStates, row: dict, out: list) -> None:
        day = row["origin_day"]
        seat = origins.days.get(day)
        if seat is not None and seat["done"]:
            return
        if row["origin_m"] <= self.cfg.origin_radius:
            keep = ("t", "id", "lat", "lon", "bearing", "route_id", "n_tp", "origin_m")
            origins.days[day] = {**{k: row[k] for k in keep}, "out_t": None, "out_m": None, "denied": False, "done": False}
        elif seat is not None and row["past_origin"]:
            if seat["out_t"] is None:
                seat["out_t"], seat["out_m"] = row["t"], row["origin_m"]
            if not row["progressed"]:
                seat["denied"] = True
                return
            span = seat["out_m"] - seat["origin_m"]
            at = seat["out_t"]
            if span > 0:
                share = max(0.0, min(1.0, (self.cfg.origin_radius - seat["origin_m"]) / span))
                at = seat["t"] + round((seat["out_t"] - seat["t"]) * share)
            seat["done"] = True
            out.append(self._event(trip, seat, detect.ORIGIN, tp_no=1, at=at, emit=row["t"], row_id=row["id"]))

    def _ending(self, endings: DayStates, row: dict) -> None:
        day = row["terminus_day"]
        best = endings.days.get(day)
        if best is not None and best["done"]:
            return
        keep = ("t", "id", "lat", "lon", "bearing", "route_id", "n_tp", "terminus_m")
        if row["terminus_m"] <= row["radius"]:
            endings.days[day] = {**{k: row[k] for k in keep}, "seen": row["t"], "done": True}
            return
        if best is not None:
            best["seen"] = row["t"]
        if row["terminus_m"] <= row["end_radius"] and row["approached"]:
            if best is None or row["terminus_m"] < best["terminus_m"]:
                endings.days[day] = {**{k: row[k] for k in keep}, "seen": row["t"], "done": False}

    def _crossings(self, trip: str, prev: dict | None, row: dict, out: list) -> None:
        if prev is None or _missing(prev["lat"]):
            return
        gap = row["t"] - prev["t"]
        corridor = row["radius"] * self.cfg.corridor_factor
        if not 0 < gap <= self.cfg.segment_max_gap * SECOND:
            return
        if prev["lateral"] > corridor or row["lateral"] > corridor or row["proj"] <= prev["proj"]:
            return
        for no in range(max(prev["passed"] + 1, 2), row["passed"] + 1):
            out.append(self._event(
                trip, row, detect.SEGMENT, tp_no=no, from_at=prev["t"], from_lat=prev["lat"],
                from_lon=prev["lon"], from_proj=prev["proj"], to_proj=row["proj"],
            ))

    def _sightings(self, trip: str, fixes: pd.DataFrame) -> list[dict]:
        """First and last sighting in each stretch of time, as ``detect.activity`` has them."""
        bins = fixes["t"] // (self.cfg.alias_active_window * SECOND)
        return [
            {**dict.fromkeys(COLUMNS), "trip_id": trip, "route_id": part["route_id"].iloc[0], "method": SIGHTED,
             "at": int(part["t"].min()), "emit": int(part["t"].max()), "phase": 0, "row_id": 0, "rank": -1}
            for _, part in fixes.groupby(bins)
        ]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trip = key[0]
        prev = dict(zip(_names(FIX_STATE), self.fix.get())) if self.fix.exists() else None
        origins, endings = DayStates(self.origins, ORIGIN_STATE), DayStates(self.endings, ENDING_STATE)
        fixes = pd.concat(list(rows))
        # A trip with several leg rows meets each fix more than once: the nearest counts.
        fixes = fixes.sort_values(["t", "id", "lateral"]).drop_duplicates("id")
        out = self._sightings(trip, fixes)
        for row in fixes.to_dict("records"):
            # Nulls in the column turn its integers into floats.
            row["passed"] = None if _missing(row["passed"]) else int(row["passed"])
            self._settle_origins(trip, origins, row["t"], out, closed=False)
            if not _missing(row["lat"]) and not _missing(row["lon"]):
                self._settle_endings(trip, endings, row["t"], out, closed=False)
                self._ending(endings, row)
                self._origin(trip, origins, row, out)
                self._crossings(trip, prev, row, out)
                if not _missing(row["geofence_no"]):
                    out.append(self._event(trip, row, detect.GEOFENCE, tp_no=int(row["geofence_no"])))
            prev = {k: _plain(row[k]) for k in _names(FIX_STATE)}
        self.fix.update(tuple(prev[k] for k in _names(FIX_STATE)))
        self._end(origins, endings, prev["t"])
        yield pd.DataFrame(out, columns=COLUMNS)

    def _end(self, origins: DayStates, endings: DayStates, now: int) -> None:
        """Save what is young enough; timers for the next silence and for the end of the rest."""
        oldest = str(pd.Timestamp(now, unit="us").date() - pd.Timedelta(days=KEEP_DAYS))
        for states, last, limit in ((origins, "t", self.cfg.origin_silence), (endings, "seen", self.cfg.terminus_silence)):
            for entry in states.days.values():
                if not entry["done"]:
                    self.handle.registerTimer((entry[last] + limit * SECOND) // 1000 + 1)
            states.drop_before(oldest)
            states.save()
        self.handle.registerTimer((now // DAY + KEEP_DAYS + 1) * DAY // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        trip, now = key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000
        origins, endings = DayStates(self.origins, ORIGIN_STATE), DayStates(self.endings, ENDING_STATE)
        out: list[dict] = []
        self._settle_origins(trip, origins, now, out, closed=True)
        self._settle_endings(trip, endings, now, out, closed=True)
        last = self.fix.get()[0] if self.fix.exists() else None
        if last is None or last < now - KEEP_DAYS * DAY:
            self.fix.clear()
            origins.drop_before("~")
            endings.drop_before("~")
        origins.save()
        endings.save()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


EVENT = (
    "trip_id string, route_id string, stop_id string, stop_sequence int, scheduled_at long, at long,"
    " delay double, service_date string, actual_lat double, actual_lon double, actual_bearing double,"
    " detection_method string, is_last boolean, emit long, phase int, row_id long, rank int, tp_no int"
)
RUN_KEY, RUN_STATE = "day string, trip string", "stops array<int>, over boolean"
SEEN_KEY, SEEN_STATE = "bin long, trip string", "first long, last long"


class RouteGuard(StatefulProcessor):
    """Of a route's candidates, the events: guarded, the first of each stop, none after the terminus."""

    def __init__(self, cfg: DetectionConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", RUN_KEY, RUN_STATE)
        self.seen = handle.getMapState("seen", SEEN_KEY, SEEN_STATE)
        self.newest = handle.getValueState("newest", "bin long, day string")

    def _sighted(self, sightings: pd.DataFrame, width: int) -> None:
        for row in sightings.itertuples():
            key = (int(row.at // width), row.trip_id)
            first, last = int(row.at), int(row.emit)
            if self.seen.containsKey(key):
                a, b = self.seen.getValue(key)
                first, last = min(a, first), max(b, last)
            self.seen.updateValue(key, (first, last))

    def _alias(self, row, width: int) -> bool:
        """Whether the event falls on the slots of other trips, none of which was sighted around it."""
        rivals = [] if row.rivals is None else list(row.rivals)
        until = min(row.emit, row.at + width)
        for rival in rivals:
            for at in range(row.at // width - 1, row.at // width + 2):
                if self.seen.containsKey((int(at), rival)):
                    first, last = self.seen.getValue((int(at), rival))
                    if last >= row.at - width and first <= until:
                        return False
        return bool(rivals)

    def _prune(self, newest: int, width: int) -> None:
        """Once a stretch: sightings no event can ask for, and runs of days gone by."""
        held, oldest = newest // width, str(pd.Timestamp(newest, unit="us").date() - pd.Timedelta(days=KEEP_DAYS))
        if self.newest.exists() and self.newest.get()[0] >= held:
            return
        before = self.newest.get()[1] if self.newest.exists() else ""
        self.newest.update((int(held), oldest))
        # The oldest event is that of an approach whose trip went on reporting for a service day.
        last = (newest - DAY - 2 * width) // width
        for key in [k for k in self.seen.keys() if k[0] < last]:
            self.seen.removeKey(key)
        if oldest > before:
            for key in [k for k in self.runs.keys() if k[0] < oldest]:
                self.runs.removeKey(key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width = self.cfg.alias_active_window * SECOND
        table = pd.concat(list(rows))
        sighted = table["detection_method"] == SIGHTED
        self._sighted(table[sighted], width)
        events = table[~sighted].sort_values(["emit", "phase", "row_id", "rank", "tp_no"])
        kept, runs = [], {}
        for place, row in enumerate(events.itertuples()):
            if self._alias(row, width):
                continue
            run = (row.service_date, row.trip_id)
            if run not in runs:
                runs[run] = list(self.runs.getValue(run)) if self.runs.containsKey(run) else [[], False]
            stops, over = runs[run]
            if over or row.stop_sequence in stops:
                continue
            runs[run] = [[*stops, int(row.stop_sequence)], bool(row.is_last)]
            kept.append(place)
        for run, (stops, over) in runs.items():
            if stops:
                self.runs.updateValue(run, ([int(s) for s in stops], bool(over)))
        self._prune(int(table["emit"].max()), width)
        yield events.iloc[kept][_names(EVENT)]

    def close(self) -> None:
        pass


def stream_candidates(
    positions: DataFrame, lines: detect.TripLines, routes: DataFrame | None,
    cfg: DetectionConfig = DetectionConfig(), lateness: str = "1 minute",
) -> DataFrame:
    """Streaming twin of ``detect.candidates``, with sightings; ``timestamp`` is the event time."""
    fixes = detect.project(positions, lines, routes, cfg, chunked=False)
    days = {name: F.col(name).cast("string") for name in ("origin_day", "terminus_day")}
    rows = (
        fixes.withWatermark("timestamp", lateness)
        .withColumns(days)
        .withColumn("t", micros(F.col("timestamp")))
        .withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    )
    found = rows.groupBy("trip_id").transformWithStateInPandas(
        statefulProcessor=TripDetector(cfg), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime",
    )
    origin = F.struct(
        from_micros(F.col("from_at")).alias("timestamp"), F.col("from_lat").alias("latitude"),
        F.col("from_lon").alias("longitude"), F.col("from_proj").alias("proj"),
    )
    return found.select(
        "trip_id", "route_id", "n_tp", "method", "tp_no", from_micros(F.col("at")).alias("actual_time"),
        "lat", "lon", "bearing", from_micros(F.col("emit")).alias("emit_time"), "phase", "row_id", "rank",
        F.when(F.col("from_at").isNotNull(), origin).alias("from"), "to_proj",
    )


def rivals_of(slots: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Per route, stop and stretch of the day, the trips that are due there: a handful."""
    reach = cfg.alias_max_gap
    return (
        slots.select("route_id", "stop_id", F.struct(F.col("trip_id").alias("trip"), F.col("arrival_secs").alias("secs")).alias("due"),
                     detect._bins(F.col("arrival_secs"), reach, 2 * reach).alias("s_bin"))
        .groupBy("route_id", "stop_id", "s_bin").agg(F.collect_set("due").alias("due"))
    )


def stream_events(
    positions: DataFrame, lines: detect.TripLines, slots: DataFrame, routes: DataFrame | None = None,
    cfg: DetectionConfig = DetectionConfig(), lateness: str = "1 minute",
) -> DataFrame:
    """Streaming twin of ``detect.detect_arrivals``, to be written by append.

    ``slots`` is read once per batch, as are the timetable lines.
    """
    found = stream_candidates(positions, lines, routes, cfg, lateness)
    told = detect.with_stops(found, lines, cfg, untimed=SIGHTED)
    secs = wall_seconds(F.col("actual_time"), F.col("service_date"), cfg.zone)
    asked = (F.col("detection_method") != SIGHTED) & F.coalesce(F.abs("delay") >= cfg.alias_min_delay, F.lit(True))
    told = told.withColumn("_secs", F.when(asked, secs)).withColumn("s_bin", F.floor(F.col("_secs") / (2 * cfg.alias_max_gap)))
    told = told.join(rivals_of(slots, cfg), ["route_id", "stop_id", "s_bin"], "left").withColumn(
        "rivals", F.array_distinct(F.transform(F.filter("due", lambda d: (d["trip"] != F.col("trip_id")) & (
            F.abs(d["secs"] - F.col("_secs")) <= cfg.alias_max_gap)), lambda d: d["trip"])))
    # A trip is looked for under the route of its slots.
    own = slots.groupBy(F.col("trip_id").alias("s_trip")).agg(F.min("route_id").alias("s_route"))
    sighted = F.col("detection_method") == SIGHTED
    told = told.join(own, sighted & (F.col("trip_id") == F.col("s_trip")), "left").withColumn(
        "guard", F.coalesce("s_route", "route_id"))
    rows = told.select(
        "guard", "trip_id", "route_id", "stop_id", "stop_sequence", micros(F.col("scheduled_time")).alias("scheduled_at"),
        micros(F.col("actual_time")).alias("at"), F.col("delay").cast("double").alias("delay"),
        F.col("service_date").cast("string").alias("service_date"), "actual_lat", "actual_lon", "actual_bearing",
        "detection_method", "is_last", micros(F.col("emit_time")).alias("emit"), "phase", "row_id", "rank", "tp_no", "rivals",
    )
    events = rows.groupBy("guard").transformWithStateInPandas(
        statefulProcessor=RouteGuard(cfg), outputStructType=EVENT, outputMode="Append", timeMode="None")
    return detect.as_events(
        events.withColumns({
            "scheduled_time": from_micros(F.col("scheduled_at")), "actual_time": from_micros(F.col("at")),
            "service_date": F.col("service_date").cast("date")}), "is_last")


def write_events(path: str):
    """``foreachBatch`` append of events; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("service_date", "batch_id")
            .parquet(path)
        )

    return write
