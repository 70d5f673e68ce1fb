import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.config import StuckConfig
from tramline.operators import blocks, filters, latest, nearest, rollups, shapes, sinks, timetable, upsert
from tramline.plans import alerts, board, explorer, games, network, reports, timeline
from tramline.schemas import POSITIONS, SCOREBOARD_POLL, UPDATE_ENTITY, VEHICLE_ENTITY
from tramline.sources import realtime_feed, ridership, static_feed
from tramline.streaming import ingest, rollup_stream

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 6, 20, 18, 0, tzinfo=UTC)


def position(i, minutes_ago=0, **fields):
    base = dict(id=i, trip_id=f"T{i}", route_id="R1", vehicle_id="V1", vehicle_label="L1", latitude=39.7392,
                longitude=-104.9903, bearing=0.0, current_stop_sequence=1, current_status=2, stop_id="S1",
                occupancy_status=None, timestamp=NOW - dt.timedelta(minutes=minutes_ago))
    return tuple({**base, **fields}.values())


def positions(spark, rows):
    return spark.createDataFrame(rows, POSITIONS)


def test_walk_over_many_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(100) if rng.random() < 0.7 else None) for k in "ab" for i in range(60) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = blocks.walk(df, ["k"], ["i"], blocks.range_block(F.col("i"), 7), F.col("v"), {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))})
    for key in "ab":
        series = sorted(r for r in rows if r[0] == key)
        found = {r.i: r for r in got.filter(F.col("k") == key).collect()}
        for j, (_, i, _v) in enumerate(series):
            before = [r[2] for r in series[:j] if r[2] is not None]
            after = [r[2] for r in series[j + 1 :] if r[2] is not None]
            assert found[i].prev_sample == (before[-1] if before else None)
            assert found[i].next_sample == (after[0] if after else None)
            assert found[i].n == j + 1 and found[i].s == sum(r[2] or 0 for r in series[: j + 1])


def test_rollups_merge_to_the_same_as_direct(spark):
    rng = random.Random(1)
    rows = [("R1", f"S{rng.randrange(3)}", NOW - dt.timedelta(minutes=rng.randrange(3000)), rng.randrange(-1200, 1200)) for _ in range(500)]
    events = spark.createDataFrame(rows, "route_id string, stop_id string, timestamp timestamp, delay_seconds int")
    merged = rollups.merge_rollups(rollups.ontime_hourly(events), ["route_id"]).first()
    delays = [r[3] for r in rows]
    assert merged.observations == 500 and merged.delay_sum == sum(delays)
    assert merged.on_time == sum(-300 <= d <= 300 for d in delays) and merged.late == sum(600 < d <= 900 for d in delays)


def test_refresh_replaces_recent_days_and_tail_answers_the_rest(spark, tmp_path):
    spec = rollups.ROLLUPS["trip_ontime_hourly"]
    rows = [("R1", "S", NOW - dt.timedelta(hours=h), 100) for h in range(200)]
    events = spark.createDataFrame(rows, "route_id string, stop_id string, timestamp timestamp, delay_seconds int")
    path = str(tmp_path / "r")
    rollups.write_rollup(spec.build(events), path)
    more = events.unionByName(spark.createDataFrame([("R1", "S", NOW - dt.timedelta(hours=5), -100)], events.schema))
    rollups.refresh_rollup(more, spec, path, NOW)
    edge = NOW - spec.end_offset
    whole = rollups.with_live_tail(spark.read.parquet(path), more, spec, edge)
    want = {(r.bucket, r.observations, r.delay_sum) for r in spec.build(more).collect()}
    assert {(r.bucket, r.observations, r.delay_sum) for r in whole.collect()} == want


def test_mocked_rollup_rows(spark):
    """Report arithmetic on the small rollups of the fixtures."""
    t = dt.datetime(2026, 6, 1, 12, tzinfo=UTC)
    columns = "route_id string, bucket timestamp, very_early long, early long, on_time long, slightly_late long, late long, very_late long, observations long, delay_sum long, delay_sumsq long"
    day = (dt.date(2026, 6, 1), dt.date(2026, 6, 1))
    one = spark.createDataFrame([("R1", t, 10, 20, 100, 15, 10, 5, 160, 48000, 50000000)], columns)
    bins = {r.key: r for r in reports.delay_distribution(one, *day).collect()}
    assert bins["on_time"].pct == 62.5 and bins["on_time"].total == 160 and bins["late"].avg_delay_seconds == 300.0
    two = spark.createDataFrame([("R1", t, 0, 10, 80, 0, 10, 0, 100, 3000, 0), ("R2", t, 0, 20, 40, 0, 40, 0, 100, 6000, 0)], columns)
    rows = {r.route_id: r for r in reports.ontime_by_route(two, *day).collect()}
    assert (rows[None].on_time_pct, rows[None].avg_delay_seconds) == (60.0, 45.0)
    assert [r.route_id for r in reports.scorecard(reports.ontime_by_route(two, *day)).collect()] == ["R1", "R2"]
    assert reports.ontime_by_route(two, *day, routes=["R2"]).count() == 2


def test_frequency(spark):
    rows = [position(i, minutes_ago=m, vehicle_id=f"V{i}") for m in (12, 2) for i in range(10 if m == 12 else 8)]
    rows += [position(99, minutes_ago=2, vehicle_id="X", route_id="R2")]
    routes = spark.createDataFrame([("R1", "15", "3"), ("R2", "A", "2")], "route_id string, route_short_name string, route_type string")
    got = {r.route_id: r for r in reports.frequency(positions(spark, rows), NOW, routes).collect()}
    assert (got["R1"].avg_headway_minutes, got["R1"].vehicle_count) == (10.0, 10)
    assert got["R2"].avg_headway_minutes == 0.0
    assert [r.label for r in reports.shortest_headways(reports.frequency(positions(spark, rows), NOW, routes)).collect()] == ["High"]


def test_scheduled_days():
    counts = reports.day_counts(dt.date(2026, 6, 1), dt.date(2026, 6, 10))
    assert counts == {"monday": 2, "tuesday": 2, "wednesday": 2, "thursday": 1, "friday": 1, "saturday": 1, "sunday": 1}


def test_occupancy_of_a_direction_without_trips_is_empty(spark):
    rollup = rollups.occupancy_hourly(positions(spark, [position(1, occupancy_status="FULL")]))
    days = (dt.date(2026, 6, 20), dt.date(2026, 6, 20))
    nobody = spark.createDataFrame([], "trip_id string")
    assert reports.occupancy_totals(rollup, *days, "R1").first().high == 1
    assert reports.occupancy_totals(rollup, *days, "R1", nobody).first().reported is False
    assert reports.occupancy_by_hour(rollup, *days, "R1", nobody).count() == 0


def test_route_scope(spark):
    routes = spark.createDataFrame([("A", "2"), ("15", "3"), ("16", "3")], "route_id string, route_type string")

    def ids(**named):
        scope = filters.route_scope(routes, **named)
        return None if scope is None else sorted(r.route_id for r in scope.collect())

    assert ids() is None and ids(modes="plane") is None and ids(modes="light_rail") is None
    assert ids(route_id="9", route_ids=" 15, A", modes="commuter_rail") == ["15", "9", "A"]
    assert ids(modes="bus") == ["15", "16"]


def test_window_forms(spark):
    t = [NOW + dt.timedelta(hours=h) for h in range(6)]
    legs = spark.createDataFrame([("in", t[2], t[3]), ("over", t[0], t[5]), ("starts", t[3], t[5])], "n string, a timestamp, b timestamp")

    def kept(strict):
        return {r.n for r in legs.filter(filters.within_window(F.col("a"), F.col("b"), t[1], t[4], strict)).collect()}

    assert kept(False) == {"in", "starts"} and kept(True) == {"in"}


def test_latest_rows(spark):
    rows = positions(spark, [position(1, 0.5), position(2, 0.1), position(3, 0.2, vehicle_id=None), position(4, 5)])
    assert {r.id for r in latest.latest_positions(rows, NOW).collect()} == {2, 3}
    updates = spark.createDataFrame(
        [(1, "T", "R", 5, None, NOW), (2, "T", "R", 7, 60, NOW), (3, "T", "R", 6, 30, NOW), (4, "U", "R", 1, None, NOW)],
        "id long, trip_id string, route_id string, stop_sequence int, arrival_delay int, timestamp timestamp")
    assert [(r.trip_id, r.delay_seconds) for r in latest.latest_feed_delays(updates, NOW).collect()] == [("T", 30)]


def stuck(spark, rows, endpoints=(), terminals=(), stop_rows=()):
    ends = spark.createDataFrame(list(endpoints), "trip_id string, first_stop_id string, last_stop_id string")
    term = spark.createDataFrame(list(terminals), "route_id string, stop_id string")
    stops = spark.createDataFrame(list(stop_rows), "stop_id string, stop_name string, stop_lat double, stop_lon double")
    routes = spark.createDataFrame([("R1", "15")], "route_id string, route_short_name string")
    return alerts.stuck_vehicles(positions(spark, rows), NOW, ends, term, stops, routes, StuckConfig()).collect()


def test_stuck_vehicles(spark):
    still = [position(i, minutes_ago=m, trip_id="T") for i, m in enumerate((20, 10, 1))]
    assert [r.minutes_stuck for r in stuck(spark, still)] == [20.0]
    assert not stuck(spark, still[:1]) and not stuck(spark, [position(1, 20, latitude=39.8), *still[1:]])
    parked = [position(i, minutes_ago=m, current_status=1) for i, m in enumerate((20, 1))]
    assert not stuck(spark, parked)
    nowhere = [position(i, minutes_ago=m, latitude=0.0, longitude=0.0) for i, m in enumerate((20, 1))]
    assert not stuck(spark, nowhere)
    place = [("E", "End", 39.7400, -104.9903)]
    assert not stuck(spark, still, endpoints=[("T", "E", "X")], stop_rows=place)
    assert not stuck(spark, still, terminals=[("R1", "S1")])
    # a trip with a timetable does not fall back to the route's ends
    assert stuck(spark, still, endpoints=[("T", None, None)], terminals=[("R1", "S1")])


def test_filters_on_trips_and_board(spark):
    trips = spark.createDataFrame(
        [("R1", "bus", "L1", "complete", None, 30.0, 100.0, 90.0), ("R2", "rail", None, "incomplete", "FULL", 60.0, None, None)],
        "route_id string, mode string, vehicle_label string, trip_status string, last_occupancy_status string, duration_minutes double, avg_delay_seconds double, on_time_pct double")

    def kept(**groups):
        return [r.route_id for r in filters.TripFilter(**groups).apply(trips).collect()]

    assert kept() == ["R1", "R2"] and kept(avg_delay=(None, 1e9)) == ["R1"]
    assert kept(occupancy=["UNKNOWN"]) == ["R1"] and kept(labels=[""]) == ["R2"] and kept(duration=(60.0, None)) == ["R2"]
    legs = spark.createDataFrame([("L1", "T1", NOW), ("L1", "T1", NOW - dt.timedelta(hours=3))], "vehicle_label string, trip_id string, end_time timestamp")
    live = spark.createDataFrame([("L1", "T1")], "vehicle_label string, trip_id string")
    assert filters.still_running(legs, live, NOW).count() == 1


def test_timeline_keeps_unscheduled_stops(spark):
    plan = spark.createDataFrame(
        [("T", 1, "A", "Stop A", 39.7, -105.0, 43200, None, True, "0", "0"), ("T", 2, "B", "Stop B", 39.8, -105.0, 43800, None, True, "0", "0")],
        "trip_id string, stop_sequence int, stop_id string, stop_name string, stop_lat double, stop_lon double, arrival_secs int, stop_headsign string, is_timepoint boolean, pickup_type string, drop_off_type string")
    events = spark.createDataFrame(
        [("T", 2, "B", NOW + dt.timedelta(minutes=10), NOW + dt.timedelta(minutes=12), 120, 1.0, 2.0, None, "segment"),
         ("T", 9, "C", NOW, NOW, 0, 1.0, 2.0, None, "geofence")],
        "trip_id string, stop_sequence int, stop_id string, scheduled_time timestamp, actual_time timestamp, delay_seconds int, actual_lat double, actual_lon double, actual_bearing double, detection_method string")
    track = positions(spark, [position(1, -11, trip_id="T", occupancy_status="FULL"), position(2, 0, trip_id="T", occupancy_status="EMPTY")])
    stops = spark.createDataFrame([("C", "Stop C", 1.0, 2.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    origins = spark.createDataFrame([("T", 1)], "trip_id string, stop_sequence int")
    rows = {r.stop_sequence: r for r in timeline.trip_timeline(plan, events, track, origins, stops).collect()}
    assert rows[1].scheduled_time == rows[2].scheduled_time - dt.timedelta(minutes=10) and not rows[1].observed
    assert rows[2].occupancy_status == "FULL" and rows[9].stop_name == "Stop C" and rows[9].is_timepoint
    totals = timeline.timeline_totals(timeline.trip_timeline(plan, events, track, origins, stops)).first()
    assert (totals.scheduled_stop_count, totals.observed_stop_count, totals.on_time_pct) == (3, 2, 100.0)


def test_position_on_a_track_clamps_and_interpolates(spark):
    track = positions(spark, [position(1, 10, trip_id="T", latitude=1.0, longitude=0.0), position(2, 0, trip_id="T", latitude=2.0, longitude=0.0, bearing=7.0)])
    at = [NOW - dt.timedelta(minutes=m) for m in (20, 5, 0, -5)]
    targets = spark.createDataFrame([("T", i, a) for i, a in enumerate(at)], "trip_id string, n int, at timestamp")
    rows = nearest.position_at(targets, track, ["trip_id"], "at", ["n"]).orderBy("n").collect()
    assert [r.at_lat for r in rows] == [1.0, 1.5, 2.0, 2.0] and rows[1].at_bearing == 0.0 and rows[3].at_bearing == 7.0


FEED = {
    "routes": "route_id,route_short_name,route_long_name,route_type,route_color,agency_id\nR1,15,Fifteen,3,AA,RTD\n101C,old,old,3,BB,RTD\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,stop_desc\nA,Alpha,39.70,-105.0,\nB,Beta Alpha,39.71,-105.0,\nZ,Zero,,,\nC,Gamma,39.7105,-105.0,\nD,Delta,39.75,-105.0,\n",
    "trips": "route_id,service_id,trip_id,trip_headsign,direction_id,shape_id\nR1,WK,T1,North,0,SH\nR1,WK,T2,South,1,\nR1,SA,T3,North,0,SH\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWK,1,1,1,1,1,0,0,x,y\nSA,0,0,0,0,0,1,0,x,y\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type,timepoint\n"
    "T1,08:00:00,08:00:30,A,1,,,,1\nT1,08:05:00,08:05:00,B,2,,1,0,1\nT1,08:06:00,08:06:00,C,3,,,,1\nT1,24:10:00,24:10:00,D,4,,,,1\n"
    "T2,09:00:00,,D,1,,,,1\nT2,09:30:00,09:30:00,A,2,,,,0\nT3,bad,bad,A,1,,,,1\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nSH,39.70,-105.0,1\nSH,39.72,-105.0,2\nSH,39.75,-105.0,3\nSH,x,-105.0,4\n",
}


@pytest.fixture()
def feed(tmp_path):
    for name, text in FEED.items():
        folder = tmp_path / "op_motorbus"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.txt").write_text(text, encoding="utf-8-sig" if name == "shapes" else "utf-8")
    late = tmp_path / "pur_motorbus"
    late.mkdir()
    (late / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\nA,Alpha New,39.70,-105.0\n")
    return str(tmp_path)


def test_static_feed(spark, feed):
    routes = {r.route_id: r for r in static_feed.routes(spark, feed).collect()}
    assert routes["101C"].route_short_name == "C" and routes["R1"].route_short_name == "15" and "101T" in routes
    stops = static_feed.stops(spark, feed)
    assert {r.stop_id: r.stop_name for r in stops.collect()}["A"] == "Alpha New"
    directory = static_feed.stop_directory(spark, feed)
    assert {r.stop_id: r.stop_name for r in directory.collect()}["A"] == "Alpha"
    assert [r.stop_id for r in network.search_stops(directory, "ALPHA").collect()] == ["A", "B"]
    times, trips, calendar = (getattr(static_feed, n)(spark, feed) for n in ("stop_times", "trips", "calendar"))
    origins = {r.trip_id: r.departure_secs for r in timetable.origin_departures(times).collect()}
    assert origins == {"T1": 28830, "T2": 32400}
    summary = timetable.schedule_summary(trips, calendar, timetable.origin_departures(times)).first()
    assert (summary.weekday_trips, summary.saturday_trips, summary.span_start, summary.span_end) == (2, 1, "08:00", "09:00")
    points = timetable.detection_timetable(times, stops)
    assert [r.stop_id for r in points.filter("trip_id = 'T1'").orderBy("stop_sequence").collect()] == ["A", "D"]
    assert [r.stop_id for r in timetable.stop_list(times, stops, "T1").collect()] == ["A", "B", "C", "D"]
    ends = {r.trip_id: (r.first_stop_id, r.last_stop_id) for r in timetable.trip_endpoints(times).collect()}
    assert ends["T2"] == ("D", "A")
    served = timetable.stop_routes(timetable.route_stops(times, trips, stops), static_feed.routes(spark, feed))
    assert {r.stop_id for r in served.collect()} == {"A", "B", "C", "D"}
    assert timetable.route_directions(trips).filter("direction_id = '0'").first().headsign == "North"
    assert static_feed.shape_points(spark, feed).count() == 3


def test_ridership_load(spark, tmp_path):
    path = tmp_path / "ntd_2026.csv"
    path.write_text("Route,Period,Riders,Avg_Weekday\nR1,2026-04,\"1,234\",50\nR1,Apr 2026,2000,\n,2026-04,5,\nR2,soon,5,\nR2,05/2026,7.5,\n")
    load = ridership.read_ridership(spark, str(path))
    stored = spark.createDataFrame([("R2", dt.date(2026, 5, 1), 1, 9, "old"), ("R3", dt.date(2026, 5, 1), 3, None, "old")], "route_id string, month date, boardings int, avg_weekday_boardings int, source string")
    merged = upsert.upsert_ridership(stored, load)
    rows = {r.route_id: r for r in merged.collect()}
    assert (rows["R1"].boardings, rows["R1"].source, rows["R1"].outcome) == (2000, "ntd_2026", "inserted")
    assert (rows["R2"].boardings, rows["R2"].avg_weekday_boardings, rows["R2"].outcome) == (8, None, "updated")
    assert tuple(upsert.outcome_counts(merged).first()) == (1, 1)
    bare = tmp_path / "bare.csv"
    bare.write_text("route,when\nR1,2026-04\n")
    with pytest.raises(ValueError):
        ridership.read_ridership(spark, str(bare))


def test_exports_layout_and_retention(spark, tmp_path):
    rows = positions(spark, [position(i, minutes_ago=i * 1000, route_id=f"R{i % 2}") for i in range(6)])
    page = sinks.export_rows(rows, NOW - dt.timedelta(days=9), NOW, limit=4)
    assert page.columns == sinks.EXPORT_COLUMNS and page.count() == 4
    sinks.write_csv(page, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sinks.EXPORT_COLUMNS and back.count() == 4
    sinks.write_json(page, str(tmp_path / "json"))
    assert "occupancy_status" in spark.read.text(str(tmp_path / "json")).first()[0]
    sinks.write_cold(rows, str(tmp_path / "cold"))
    cold = spark.read.parquet(str(tmp_path / "cold"))
    assert cold.count() == 6
    assert sinks.retained(cold, NOW, days=2).count() == 3
    sinks.write_by_mode(rows.withColumn("mode", F.lit("bus")), str(tmp_path / "mode"))
    assert spark.read.json(str(tmp_path / "mode")).count() == 6


def test_rebuild_guard(spark, tmp_path):
    def events(n, start):
        return spark.createDataFrame([(f"T{i}", NOW + dt.timedelta(minutes=start + i)) for i in range(n)], "trip_id string, timestamp timestamp")

    live = events(10, 0)
    with pytest.raises(sinks.RebuildRefused):
        sinks.rebuild_events(events(0, 0), live, str(tmp_path))
    with pytest.raises(sinks.RebuildRefused):
        sinks.rebuild_events(events(1, 9), live, str(tmp_path))
    sinks.rebuild_events(events(3, 2), live, str(tmp_path))
    # three staged up to minute 4, five live after it
    assert sinks.current_events(spark, str(tmp_path)).count() == 8
    sinks.rebuild_events(events(1, 9), live, str(tmp_path), force=True)
    assert sinks.current_events(spark, str(tmp_path)).count() == 1


def test_feed_entities(spark):
    vehicle = '{"entity_id":"1","poll_time":"2026-06-20T18:00:00Z","vehicle":{"trip":{"trip_id":"T","route_id":"R"},"position":{"latitude":1.0,"longitude":2.0}}}'
    df = spark.read.schema(VEHICLE_ENTITY).json(spark.sparkContext.parallelize([vehicle, '{"entity_id":"2"}']))
    row = realtime_feed.vehicle_positions(df).collect()
    assert len(row) == 1 and row[0].occupancy_status == "UNKNOWN" and row[0].vehicle_id is None and row[0].bearing is None
    update = '{"entity_id":"1","poll_time":"2026-06-20T18:00:00Z","trip_update":{"trip":{"trip_id":"T","route_id":"R"},"timestamp":0,"stop_time_update":[{"stop_id":"","stop_sequence":0,"arrival":{}},{"stop_id":"S","stop_sequence":4}]}}'
    rows = realtime_feed.trip_updates(spark.read.schema(UPDATE_ENTITY).json(spark.sparkContext.parallelize([update]))).collect()
    assert [(r.stop_id, r.stop_sequence, r.arrival_delay) for r in rows] == [(None, None, 0), ("S", 4, None)]


def game(state, hour, score=(3, 2), home="Colorado Rockies"):
    side = '{"homeAway":"%s","score":"%s","team":{"displayName":"%s"}}'
    return '{"poll_time":"2026-06-20T%02d:00:00Z","league":"MLB","day_order":0,"events":[{"id":"g","competitions":[{"date":"2026-06-20T16:00Z","status":{"type":{"state":"%s"}},"competitors":[%s,%s]}]}]}' % (
        hour, state, side % ("home", score[0], home), side % ("away", score[1], "Padres"))


def test_games(spark):
    def polls(*texts):
        return spark.read.schema(SCOREBOARD_POLL).json(spark.sparkContext.parallelize(list(texts)))

    watched = games.games_history(polls(game("pre", 15), game("in", 17), game("post", 20), game("post", 21))).first()
    assert watched.result == "win" and watched.end.hour == 20
    unseen = games.games_history(polls(game("post", 20))).first()
    assert unseen.end.hour == 19  # 16:00 plus the usual three hours
    assert games.games_history(polls(game("in", 17, home="Padres"))).count() == 0
    board_rows = games.with_end_times(games.home_games(games.poll_events(polls(game("in", 17), game("post", 20))), games.clubs(spark)))
    assert games.board_at(board_rows).count() == 1
    assert games.board_at(board_rows, dt.datetime(2026, 6, 20, 23, tzinfo=UTC)).count() == 0


def test_shapes(spark):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(0, 0.001, size=(400, 2)), axis=0) + [39.7, -105.0]
    rows = [("A", i, float(a), float(b)) for i, (a, b) in enumerate(walk)] + [("B", 1, 1.0, 1.0), ("B", 2, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "shape_id string, seq int, lat double, lon double")
    want = {i for i, keep in enumerate(shapes.keep_mask(walk, 0.002)) if keep}
    for chunk in (100_000, 50):
        kept = shapes.simplify_shapes(points, 0.002, chunk).collect()
        assert {r.seq for r in kept if r.shape_id == "A"} == want and len([r for r in kept if r.shape_id == "B"]) == 2
    lines = points.withColumn("route_id", F.lit("R"))
    assert shapes.nearest_variant(lines, "R", (1.0, 1.5)).first().shape_id == "B"
    assert shapes.as_polylines(points).filter("shape_id = 'B'").first().points[1].lon == 2.0


def test_streams(spark, tmp_path):
    rows = [("R1", NOW + dt.timedelta(minutes=m), d) for m, d in ((0, 10), (5, 400), (70, -400), (200, 0))]
    events = spark.createDataFrame(rows, "route_id string, timestamp timestamp, delay_seconds int")
    for part in range(2):
        events.coalesce(1).filter(F.col("delay_seconds") % 4 == 0 if part else F.col("delay_seconds") % 4 != 0).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        rollup_stream.hourly_stream(stream, "1 day").writeStream.outputMode("update")
        .foreachBatch(rollup_stream.write_versions(str(tmp_path / "roll")))
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = rollup_stream.newest_versions(spark.read.parquet(str(tmp_path / "roll")))
    want = {(r.bucket, r.observations, r.on_time) for r in rollups.ontime_hourly(events).collect()}
    assert {(r.bucket, r.observations, r.on_time) for r in got.collect()} == want
    facts = ingest.append_facts(str(tmp_path / "facts"))
    for _ in range(2):
        facts(events, 7)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 4


def test_board_facets_and_search(spark):
    rows = positions(spark, [position(1, 0, vehicle_id="V1"), position(2, 0, vehicle_id="V2", vehicle_label=None, route_id="R2", latitude=None)])
    routes = spark.createDataFrame([("R1", "15", "Fifteen", "AA", "3")], "route_id string, route_short_name string, route_long_name string, route_color string, route_type string")
    updates = spark.createDataFrame([(1, "T1", "R1", 1, 400, NOW)], "id long, trip_id string, route_id string, stop_sequence int, arrival_delay int, timestamp timestamp")
    stops = spark.createDataFrame([("S1", "Stop")], "stop_id string, stop_name string")
    live = board.live_board(rows, updates, routes, stops, NOW)
    row = live.collect()
    assert len(row) == 1 and row[0].is_late and row[0].headway_minutes == 0.0
    stuck_table = spark.createDataFrame([("L1", None)], "vehicle_label string, vehicle_id string")
    banded = board.with_bands(live, stuck_table)
    facets = {(r.facet, r.value): r.n for r in board.board_facets(banded).collect()}
    assert facets[("mode", "bus")] == 1 and facets[("stuck", "stuck")] == 1 and facets[("punctuality", "early")] == 0
    assert filters.LiveFilter(stuck_only=True).apply(banded).count() == 1
    assert board.active_routes(banded, "l1").count() == 1 and board.active_routes(banded, "zz").count() == 0
    assert board.at_stop(banded, "S1").count() == 1


def test_ridership_folder_reads_each_header(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("route,month,boardings\nR1,2026-04,10\nR3,2026-04,NaN\nR4,2026-04,3000000000\n")
    (tmp_path / "f" / "b.csv").write_text("\ufeffRiders,note,Period,LINE\n20,\"x,y\",2026-05,R2\n")
    rows = {r.route_id: r for r in ridership.read_ridership(spark, str(tmp_path / "f")).collect()}
    assert {k: (r.month, r.boardings, r.source) for k, r in rows.items()} == {
        "R1": (dt.date(2026, 4, 1), 10, "a"), "R2": (dt.date(2026, 5, 1), 20, "b"), "R4": (dt.date(2026, 4, 1), 3_000_000_000, "a")}


def test_refresh_drops_days_without_rows(spark, tmp_path):
    spec = rollups.ROLLUPS["trip_ontime_hourly"]
    rows = [("R1", "S", NOW - dt.timedelta(hours=h), 100) for h in range(120)]
    events = spark.createDataFrame(rows, "route_id string, stop_id string, timestamp timestamp, delay_seconds int")
    path, gone = str(tmp_path / "r"), (NOW - dt.timedelta(days=2)).date()
    rollups.write_rollup(spec.build(events), path)
    rollups.refresh_rollup(events.filter(F.to_date("timestamp") != gone), spec, path, NOW)
    days = {r[0] for r in spark.read.parquet(path).select("bucket_date").distinct().collect()}
    assert gone not in days and gone - dt.timedelta(days=1) in days and gone - dt.timedelta(days=2) in days


def test_exports_are_whole_by_default(spark):
    rows = positions(spark, [position(i % 7, minutes_ago=i % 1000) for i in range(5_100)])
    assert sinks.export_rows(rows, NOW - dt.timedelta(days=9), NOW).count() == 5_100


def test_page_delays_stay_within_the_page(spark):
    """A trip id recurs every day; another day's delay is not this page's."""
    day = dt.timedelta(days=1)
    page = spark.createDataFrame(
        [("T1", "R1", NOW - day, NOW - day + dt.timedelta(hours=1)), ("T2", "R1", NOW - day, NOW - day)],
        "trip_id string, route_id string, start_time timestamp, end_time timestamp")
    updates = spark.createDataFrame(
        [(1, "T1", "R1", 60, NOW - day), (2, "T1", "R1", 999, NOW), (3, "T1", "R1", 70, NOW - day + dt.timedelta(minutes=64)),
         (4, "T1", "R2", 500, NOW - day + dt.timedelta(minutes=65)), (5, "T2", "R1", 80, NOW - day - dt.timedelta(minutes=6))],
        "id bigint, trip_id string, route_id string, arrival_delay int, timestamp timestamp")
    got = explorer.page_delays(page, updates, NOW - 2 * day, NOW).collect()
    assert {r.trip_id: r.last_delay_seconds for r in got} == {"T1": 70, "T2": None}


def test_rebuild_judges_what_it_wrote(spark, tmp_path):
    schema = "id bigint, timestamp timestamp"
    live = spark.createDataFrame([(i, NOW - dt.timedelta(hours=i)) for i in range(10)], schema)
    few = spark.createDataFrame([(1, NOW)], schema)
    with pytest.raises(sinks.RebuildRefused):
        sinks.rebuild_events(few, live, str(tmp_path / "v"))
    sinks.rebuild_events(live.filter("id > 2"), live, str(tmp_path / "v"))
    sinks.rebuild_events(live.filter("id > 4"), live, str(tmp_path / "v"), force=True)
    assert {r.id for r in sinks.current_events(spark, str(tmp_path / "v")).collect()} == set(range(10))


def test_distances_along_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(timetable, "SEQUENCE_BLOCK", 4)
    rng = random.Random(12)
    rows = []
    for trip in ("A", "B", "C"):
        seqs = sorted(rng.sample(range(60), 1 if trip == "C" else 23))
        rows += [(trip, s, 39.7 + rng.random() / 50, -104.9 + rng.random() / 50) for s in seqs]
    df = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop_lat double, stop_lon double")
    got = {(r.trip_id, r.stop_sequence): r for r in timetable.with_distance(df).collect()}
    assert len(got) == len(rows)

    def metres(a, b):
        import math
        f, g = math.radians(a[2]), math.radians(b[2])
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    for trip in ("A", "B", "C"):
        own, total = [r for r in rows if r[0] == trip], 0.0
        for i, row in enumerate(own):
            told = got[row[:2]]
            before = metres(own[i - 1], row) if i else None
            after = metres(row, own[i + 1]) if i + 1 < len(own) else None
            total += before or 0.0
            assert told.hop_prev == (pytest.approx(before) if i else None)
            assert told.hop_next == (pytest.approx(after) if after is not None else None)
            assert told.dist_m == pytest.approx(total)


def test_terminals_by_cell_equal_all_distances(spark):
    """Also across the date line and around a pole."""
    import math
    rng = random.Random(13)
    spots = [(39.7, -105.0), (10.0, 179.999), (-20.0, -179.9995), (89.9985, 20.0), (-89.9999, -100.0), (0.001, 0.001)]
    stops, vehicles, n = [], [], 0
    for lat, lon in spots:
        for _ in range(25):
            n += 1
            near = lambda v, w=0.006: v + rng.uniform(-w, w)
            wrap = lambda v: (v + 180) % 360 - 180
            wide = 0.006 / max(0.02, math.cos(math.radians(lat)))
            stops.append((f"S{n}", max(-90.0, min(90.0, near(lat))), wrap(near(lon, wide))))
            vehicles.append((f"V{n}", "T", f"R{n % 2}", max(-90.0, min(90.0, near(lat))), wrap(near(lon, wide)), f"S{n}" if n % 50 == 0 else None))
    terminals = [(f"R{i % 2}", s[0]) for i, s in enumerate(stops)]
    got = {r.vehicle for r in alerts.at_terminal(
        spark.createDataFrame(vehicles, "vehicle string, trip_id string, route_id string, latitude double, longitude double, stop_id string"),
        spark.createDataFrame([], "trip_id string, first_stop_id string, last_stop_id string"),
        spark.createDataFrame(terminals, "route_id string, stop_id string"),
        spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double"), 300.0).collect()}

    def metres(a, b, c, d):
        f, g = math.radians(a), math.radians(c)
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))

    where = {s[0]: s[1:] for s in stops}
    want = {v[0] for v in vehicles for r, t in terminals if r == v[2] and (
        v[5] == t or (0.0 not in where[t] and metres(v[3], v[4], *where[t]) < 300))}
    assert got == want and 10 < len(want) < len(vehicles)


def test_windows_of_a_stream_equal_the_stored_rows(spark, tmp_path):
    from tramline.streaming import windows
    rng = random.Random(14)
    rows = [position(i, rng.randrange(0, 400), trip_id=f"T{rng.randrange(4)}", vehicle_id=f"V{rng.randrange(5)}",
                     route_id=f"R{rng.randrange(2)}") for i in range(150)]
    rows.sort(key=lambda r: r[-1])
    last = [position(999, -3000)]
    for part in (rows[:70], rows[70:], last, [position(1000, -3001)]):
        positions(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored_rows = spark.read.parquet(str(tmp_path / "in"))
    for build in (windows.active_in_window, windows.latest_in_window, windows.trip_sessions):
        stream = spark.readStream.schema(stored_rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / build.__name__)).option(
            "checkpointLocation", str(tmp_path / f"c-{build.__name__}")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        key = "until" if build is not windows.trip_sessions else "last_seen"
        done = F.col(key) < F.lit(NOW + dt.timedelta(minutes=2000))
        shown = lambda df: sorted(map(str, df.filter(done).collect()))
        got, want = shown(spark.read.parquet(str(tmp_path / build.__name__))), shown(build(stored_rows))
        assert got == want and len(want) > 10


def test_a_poll_landed_twice_counts_once(spark, tmp_path):
    polls = [[position(i, 10 - p, vehicle_id=f"V{i}") for i in range(5)] for p in range(3)]
    for part in (polls[0], polls[1], polls[1], polls[2], polls[0]):
        positions(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = ingest.facts_once(stream, ["vehicle_id", "latitude", "longitude", "timestamp"], lateness="30 minutes")
    query = once.writeStream.foreachBatch(ingest.append_poll(str(tmp_path / "out"), {
        "positions": lambda b: b, "labels": lambda b: b.select("route_id", "vehicle_label", "timestamp")})).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    for table in ("positions", "labels"):
        assert ingest.committed(spark, str(tmp_path / "out"), table).count() == 15
    assert ingest.commits(spark, str(tmp_path / "nothing")).isEmpty()


def test_seek_reads_behind_the_key_only(spark):
    rows = positions(spark, [position(i, i // 3) for i in range(100)])
    keys, after, seen = ["timestamp", "id"], None, []
    while True:
        page = explorer.seek(rows, keys, after, 7)
        got = page.collect()
        if not got:
            break
        seen += [r.id for r in got]
        after = explorer.last_key(page, keys)
    want = sorted(range(100), key=lambda i: (i // 3, -i))
    assert seen == want


def test_decimal_mean_rounds_half_to_even(spark):
    from decimal import ROUND_HALF_EVEN, Decimal
    from tramline.functions.numbers import mean_half_even
    pairs = [(1, 4), (3, 4), (-1, 4), (-3, 4), (5, 20), (15, 100), (25, 100), (0, 3), (-7, 3), (10**12 + 1, 8)]
    rows = spark.createDataFrame(pairs + [(0, 0)], "s long, n long").select("s", "n", mean_half_even(F.col("s"), F.col("n")).alias("m")).collect()
    for r in rows:
        assert r.m == (None if r.n == 0 else float((Decimal(r.s) / r.n).quantize(Decimal("0.1"), ROUND_HALF_EVEN)))
