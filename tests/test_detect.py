"""Batch and streaming detection against a plain loop, and single cases."""

import random
import re
from datetime import datetime, timedelta, timezone

import naive
import pytest

from tramline.config import DetectionConfig
from tramline.functions.times import micros
from tramline.operators import detect, timetable
from tramline.plans import catalog
from tramline.schemas import POSITIONS
from tramline.session import stored
from tramline.streaming.detect_stream import stream_events, write_events
from pyspark.sql import functions as F

UTC = timezone.utc
NOON = datetime(2026, 6, 20, 18, 0, tzinfo=UTC)  # 12:00 in Denver
CFG = DetectionConfig()
POINT = "trip_id string, stop_sequence int, stop_id string, arrival_secs int, stop_lat double, stop_lon double, dist_m double"
SLOT = "route_id string, stop_id string, arrival_secs int, trip_id string"


def line(trip, secs=43200, n=3, step=0.01, gap=300, lat=39.73, lon=-104.99):
    out, dist = [], 0.0
    for i in range(n):
        here = (lat + i * step, lon)
        if i:
            dist += naive.metres(lat + (i - 1) * step, lon, *here)
        out.append(dict(trip_id=trip, stop_sequence=i + 1, stop_id=f"S{i}", arrival_secs=secs + i * gap,
                        stop_lat=here[0], stop_lon=here[1], dist_m=dist))
    return out


def fix(i, trip, at, lat, lon=-104.99, route="R1", seq=None):
    return dict(id=i, trip_id=trip, route_id=route, latitude=lat, longitude=lon, bearing=None,
                current_stop_sequence=seq, timestamp=at)


def frames(spark, fixes, points, slots):
    rows = [(f["id"], f["trip_id"], f["route_id"], "V", "V", f["latitude"], f["longitude"], f["bearing"],
             f["current_stop_sequence"], None, None, None, f["timestamp"]) for f in fixes]
    return (
        spark.createDataFrame(rows, POSITIONS),
        spark.createDataFrame([tuple(p.values()) for p in points], POINT),
        spark.createDataFrame([tuple(s.values()) for s in slots], SLOT),
    )


def result(events):
    rows = events.withColumn("at", micros(F.col("actual_time"))).collect()
    return {
        (r.trip_id, r.stop_sequence, r.service_date): (
            r.detection_method, round(r.at / 1e6), round(r.actual_lat, 6), round(r.actual_lon, 6)
        )
        for r in rows
    }


def same(left, right):
    """Equal up to a second and a millionth of a degree."""
    assert left.keys() == right.keys()
    for key, (method, at, lat, lon) in left.items():
        other = right[key]
        assert method == other[0] and abs(at - other[1]) <= 1, (key, left[key], other)
        assert abs(lat - other[2]) < 2e-6 and abs(lon - other[3]) < 2e-6, key


def run(spark, fixes, points, slots=(), cfg=CFG, routes=None):
    positions, tp, sl = frames(spark, fixes, points, slots)
    return result(detect.detect_arrivals(positions, tp, sl, routes, cfg))


def ride(points, start, lats, seconds=30, trip="T1", route="R1", first=1):
    return [fix(first + i, trip, start + timedelta(seconds=seconds * i), lat, route=route) for i, lat in enumerate(lats)]


def test_ride_with_origin_segment_and_geofence(spark):
    points = line("T1")
    fixes = ride(points, NOON, [39.7300, 39.7301, 39.7325, 39.7370, 39.7420, 39.7465, 39.7499, 39.7500])
    got = run(spark, fixes, points)
    assert [got[k][0] for k in sorted(got)] == ["origin_departure", "segment", "geofence"]
    same(got, naive.detect(fixes, points, [], set(), CFG))


def test_terminus_fallback_only_after_silence_and_not_when_reached(spark):
    points = line("T1")
    short = ride(points, NOON, [39.7390, 39.7420, 39.7465, 39.7468])
    got = run(spark, short, points)
    assert "terminus_fallback" in {v[0] for v in got.values()}
    reached = short + [fix(90, "T1", NOON + timedelta(minutes=5), 39.7500)]
    assert "terminus_fallback" not in {v[0] for v in run(spark, reached, points).values()}


def test_yard_move_is_no_departure_and_quiet_origin_is(spark):
    points = line("T1")
    yard = [fix(1, "T1", NOON, 39.7300), fix(2, "T1", NOON + timedelta(seconds=30), 39.7280),
            fix(3, "T1", NOON + timedelta(seconds=60), 39.7270)]
    assert run(spark, yard, points) == {}
    quiet = [fix(1, "T1", NOON, 39.7300)]
    assert [v[0] for v in run(spark, quiet, points).values()] == ["origin_departure"]
    positions, tp, sl = frames(spark, quiet, points, [])
    early = detect.detect_arrivals(positions, tp, sl, None, CFG, watermark=NOON + timedelta(minutes=14))
    assert early.isEmpty()


def test_shuffling_between_gates_waits_for_the_feed_to_leave_the_origin(spark):
    points = line("T1")
    fixes = [fix(1, "T1", NOON, 39.7300), fix(2, "T1", NOON + timedelta(seconds=30), 39.7320, seq=1),
             fix(3, "T1", NOON + timedelta(seconds=60), 39.7330, seq=2)]
    same(run(spark, fixes, points), naive.detect(fixes, points, [], set(), CFG))


@pytest.mark.parametrize("other_reports", [True, False])
def test_alias_guard(spark, other_reports):
    points = line("T1") + line("T2", secs=43200 + 900)
    slots = [dict(route_id="R1", stop_id=p["stop_id"], arrival_secs=p["arrival_secs"], trip_id=p["trip_id"]) for p in points]
    late = NOON + timedelta(seconds=900 + 300)
    fixes = [fix(1, "T1", late, 39.7400)]
    if other_reports:
        fixes.append(fix(2, "T2", late - timedelta(minutes=20), None, None))
    got = {k for k in run(spark, fixes, points, slots) if k[0] == "T1"}
    assert bool(got) == other_reports
    assert got == {k for k in naive.detect(fixes, points, slots, set(), CFG) if k[0] == "T1"}


def test_a_sighting_after_the_event_does_not_vouch_for_the_alias(spark):
    points = line("T1") + line("T2", secs=43200 + 900)
    slots = [dict(route_id="R1", stop_id=p["stop_id"], arrival_secs=p["arrival_secs"], trip_id=p["trip_id"]) for p in points]
    late = NOON + timedelta(seconds=1200)
    fixes = [fix(1, "T1", late, 39.7400), fix(2, "T2", late + timedelta(minutes=5), None, None)]
    assert not {k for k in run(spark, fixes, points, slots) if k[0] == "T1"}


def random_world(seed, trips=6, fixes_per_trip=70):
    rng = random.Random(seed)
    points, slots, fixes = [], [], []
    n = 0
    for t in range(trips):
        trip, route = f"T{t}", f"R{t % 2}"
        # some trips cross local midnight, one has a single timepoint
        secs = rng.choice([43200, 82800, 86000, 300])
        pts = line(trip, secs=secs, n=1 if t == 5 else rng.choice([2, 3, 5]), gap=400)
        points += pts
        slots += [dict(route_id=route, stop_id=p["stop_id"], arrival_secs=p["arrival_secs"] + rng.choice([0, 30]), trip_id=trip) for p in pts]
        start = NOON + timedelta(seconds=secs - 43200 - 900 + rng.randrange(0, 1200))
        at, lat = start, 39.7290
        for _ in range(fixes_per_trip):
            n += 1
            at += timedelta(seconds=rng.choice([30, 30, 30, 30, 60, 290, 310, 1000]))
            lat += rng.choice([0, 0, 0.0003, 0.0015, 0.003, 0.006, -0.002])
            if rng.random() < 0.04:
                lat = 39.7300 + rng.choice([0, 0.02])
            lon = -104.99 + rng.choice([0, 0, 0.0004, 0.002, 0.006])
            gone = rng.random() < 0.04
            fixes.append(fix(n, trip, at, None if gone else lat, None if gone else lon, route,
                             rng.choice([None, None, 1, 2])))
    return fixes, points, slots


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tracks_match_the_loop(spark, seed):
    fixes, points, slots = random_world(seed)
    routes = spark.createDataFrame([("R0", "0"), ("R1", "3")], "route_id string, route_type string")
    got = run(spark, fixes, points, slots, routes=routes)
    want = naive.detect(fixes, points, slots, {"R0"}, CFG)
    assert len(want) > 5
    same(got, want)


def test_one_day_of_one_trip_with_a_third_of_all_fixes(spark, monkeypatch):
    """Its stretches of hours are windowed apart, and no window holds a whole day of a trip."""
    monkeypatch.setattr(detect, "TIME_BLOCK", 600)
    fixes, points, slots = random_world(6)
    n, at, lat, rng = 10_000, NOON - timedelta(hours=2), 39.7290, random.Random(60)
    for _ in range(420):
        n, at = n + 1, at + timedelta(seconds=rng.choice([10, 30, 60, 200, 950]))
        lat = 39.7300 if rng.random() < 0.1 else lat + rng.choice([0, 0.001, 0.003, -0.002])
        fixes.append(fix(n, "T0", at, lat, -104.99, "R0"))
    same(run(spark, fixes, points, slots), naive.detect(fixes, points, slots, set(), CFG))
    positions, tp, _ = frames(spark, fixes, points, slots)
    plan = detect.candidates(detect.project(positions, detect.trip_lines(tp), None, CFG), CFG)._jdf.queryExecution().optimizedPlan().toString()
    windows = [w for w in plan.split("\n") if "Window" in w and "timestamp" in w]
    assert windows and all("block" in w for w in windows)


def test_long_trips_are_met_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(detect, "LEGS_PER_ROW", 2)
    fixes, points, slots = random_world(4)
    same(run(spark, fixes, points, slots), naive.detect(fixes, points, slots, set(), CFG))


def streamed(spark, folder, parts, points, slots, cfg=CFG):
    """Events of one batch for each part, and the state rows of both steps after each batch."""
    positions, tp, sl = frames(spark, parts[0], points, slots)
    lines = detect.trip_lines(tp).stored()
    for i, part in enumerate(parts):
        # One file a batch; files are taken in the order of their times.
        batch, _, _ = frames(spark, part, points, [])
        batch.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(positions.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = (
        stream_events(stream, lines, stored(sl, "slots"), None, cfg, "1 second")
        .writeStream.foreachBatch(write_events(str(folder / "events")))
        .option("checkpointLocation", str(folder / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(400)
    assert query.exception() is None
    rows = [tuple(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    return spark.read.parquet(str(folder / "events")), rows


def test_stream_equals_batch(spark, tmp_path):
    fixes, points, slots = random_world(5)
    want = run(spark, fixes, points, slots)
    # The last file is far ahead so that timers fire.
    end = max(f["timestamp"] for f in fixes) + timedelta(days=1)
    ordered = sorted(fixes, key=lambda f: f["timestamp"])
    size = len(ordered) // 3 + 1
    parts = [ordered[j : j + size] for j in range(0, len(ordered), size)] + [[fix(10_000, "T0", end, None, None)]]
    events, _ = streamed(spark, tmp_path, parts, points, slots)
    same(result(events), want)


def test_state_stays_level_over_ten_days_of_new_trips(spark, tmp_path):
    """Trips that never report again leave no state behind; the events are those of the batch job."""
    fixes, points, slots, parts = [], [], [], []
    for day in range(10):
        trip = f"T{day}"
        own = line(trip)
        points += own
        slots += [dict(route_id="R1", stop_id=p["stop_id"], arrival_secs=p["arrival_secs"], trip_id=trip) for p in own]
        lats = [39.7300, 39.7301, 39.7325, 39.7370, 39.7420, 39.7465, 39.7490][: 7 if day % 2 else 5]
        parts.append(ride(own, NOON + timedelta(days=day), lats, trip=trip, first=100 * day))
        fixes += parts[-1]
    parts.append([fix(5000, "T9", NOON + timedelta(days=10), None, None)])
    want = run(spark, fixes, points, slots)
    events, rows = streamed(spark, tmp_path, parts, points, slots)
    same(result(events), want)
    assert len(want) > 20
    later = rows[5:]
    assert all(b[i] <= max(r[i] for r in rows[3:6]) for b in later for i in range(2)), rows


def plan_nodes(frame):
    """Name and rows out of every node that ran for ``frame``."""
    frame.collect()
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        rows = node.metrics().get("numOutputRows")
        found.append((name, rows.get().value() if rows.isDefined() else 0))
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


EVENT = ("n int, trip_id string, route_id string, stop_id string, service_date date, actual_time timestamp,"
         " emit_time timestamp, delay double")
SEEN = "trip_id string, bin bigint, first_seen timestamp, last_seen timestamp"


def guard_world(seed, trips=9, events=120):
    """Trips that share few stops and times, events around them, sightings before and after."""
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(trips)] + [None]
    slots = [("R", rng.choice(["A", "B"]), rng.choice([43200, 43260, 45000, 50000, None]), rng.choice(names)) for _ in range(14)]
    slots += slots[:3]
    day, rows = NOON.date(), []
    for n in range(events):
        at = NOON + timedelta(seconds=rng.choice([0, 60, 1800, 3600, 3601, 6800, 9000]))
        rows.append((n, rng.choice(names), rng.choice(["R", None]) if n % 9 == 0 else "R", rng.choice(["A", "B"]), day,
                     at, at + timedelta(seconds=rng.choice([0, 0, 30, 900])), rng.choice([None, 10.0, 5000.0, -5000.0])))
    sightings = [(rng.choice(names), NOON + timedelta(seconds=rng.randrange(-4000, 13000))) for _ in range(7)]
    return rows, slots, sightings


def guarded(rows, slots, sightings, cfg=CFG):
    """The guard as a plain loop."""
    window, kept = timedelta(seconds=cfg.alias_active_window), set()
    for n, trip, route, stop, day, at, emit, delay in rows:
        secs = (at - NOON).total_seconds() + 43200
        rivals = {s[3] for s in slots if trip and s[3] and s[3] != trip and s[0] == route and s[1] == stop
                  and s[2] is not None and abs(s[2] - secs) <= cfg.alias_max_gap}
        spans = {}
        for other, t in sightings:
            spans.setdefault((other, int(t.timestamp() // cfg.alias_active_window)), []).append(t)
        vouched = any(other in rivals and max(ts) >= at - window and min(ts) <= min(emit, at + window)
                      for (other, _), ts in spans.items())
        if not ((delay is None or abs(delay) >= cfg.alias_min_delay) and rivals and not vouched):
            kept.add(n)
    return kept


def guard_frames(spark, rows, slots, sightings):
    seen = spark.createDataFrame([(t, at) for t, at in sightings if t], "trip_id string, timestamp timestamp")
    return spark.createDataFrame(rows, EVENT), spark.createDataFrame(slots, SLOT), detect.activity(seen, CFG)


@pytest.mark.parametrize("seed", range(6))
def test_alias_guard_equals_a_plain_loop(spark, seed):
    world = guard_world(seed)
    left = {r.n for r in detect.alias_guard(*guard_frames(spark, *world), CFG).collect()}
    assert left == guarded(*world) and len(left) < len(world[0])


def test_alias_guard_does_not_pair_events_with_the_trips_due(spark):
    """Three hundred late events at one stop where three hundred trips are due at one time."""
    n = 300
    rows = [(i, f"T{i}", "R", "A", NOON.date(), NOON + timedelta(seconds=i), NOON + timedelta(seconds=i), 900.0) for i in range(n)]
    slots = [("R", "A", 43200, f"T{i}") for i in range(n)]
    sightings = [(f"T{i}", NOON + timedelta(seconds=i)) for i in range(n)]
    out = detect.alias_guard(*guard_frames(spark, rows, slots, sightings), CFG)
    # The first event's trip is the only one seen by then.
    assert {r.n for r in out.collect()} == guarded(rows, slots, sightings) == set(range(1, n))
    assert max(made for name, made in plan_nodes(out) if "Join" in name) <= 10 * n


def test_rows_of_trips_are_not_broadcast(spark):
    """A timetable read from files is far larger than they are."""
    fixes, points, slots = random_world(7)
    positions, tp, _ = frames(spark, fixes, points, slots)
    lines = detect.trip_lines(stored(timetable.with_distance(tp.drop("dist_m")).drop("hop_prev", "hop_next"), "timetable")).stored()
    found = detect.with_stops(detect.candidates(detect.project(positions, lines, None, CFG), CFG), lines, CFG)
    for frame in (timetable.with_distance(stored(tp, "points")), lines.legs, found):
        assert not [name for name, _ in plan_nodes(frame) if "Broadcast" in name]
    built = detect.trip_lines(stored(tp, "points"))
    assert not [name for frame in (built.numbered, built.legs) for name, _ in plan_nodes(frame) if "Broadcast" in name]


def test_segment_arrivals_broadcasts_only_nations_and_routes(spark, tmp_path, monkeypatch):
    """Also in the jobs that store its timetable: each task counts a broadcast table as its own memory."""
    at, rng, frames_run = datetime(2024, 1, 1), random.Random(5), []
    events = [(i, at + timedelta(hours=rng.uniform(0, 336)), i % 40, rng.choice(["click", "view"]), rng.uniform(0, 100),
               f'{{"k": {rng.randrange(100)}}}') for i in range(2000)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")

    def kept(df, name):
        frames_run.append(df)
        return stored(df, name)

    monkeypatch.setattr(catalog, "stored", kept)
    monkeypatch.setattr(detect, "stored", kept)
    frames_run.append(catalog.QUERIES["segment_arrivals"](spark, str(tmp_path)))
    assert len(frames_run) == 4 and frames_run[-1].count() > 0
    keys = set()
    for frame in frames_run:
        frame.collect()
        ran = frame._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        keys |= set(re.findall(r"Broadcast\w*Join \[(\w+)", ran))
        assert "BroadcastNestedLoopJoin" not in ran
    assert keys == {"n_nationkey", "route_id"}


def test_slots_are_made_distinct_before_the_join(spark):
    points = spark.createDataFrame(
        [("T1", "A", 10), ("T1", "A", 10), ("T1", None, 10), ("T1", "A", None), ("T2", "A", 10), (None, "A", 10), ("T9", "A", 10)],
        "trip_id string, stop_id string, arrival_secs int")
    trips = spark.createDataFrame(
        [("T1", "R1"), ("T1", "R1"), ("T1", None), ("T2", "R1"), (None, "R1"), ("T8", "R1")], "trip_id string, route_id string")
    out = timetable.stop_slots(points, trips)
    got = sorted([tuple(r) for r in out.collect()], key=repr)
    stops = [("A", 10), (None, 10), ("A", None)]
    assert got == sorted([(r, *s, "T1") for r in ("R1", None) for s in stops] + [("R1", "A", 10, "T2")], key=repr)
    names = [name for name, _ in plan_nodes(out)]
    assert not any("Aggregate" in name for name in names[: next(i for i, x in enumerate(names) if "Join" in x)])
