"""Arrival detection as one loop over sorted fixes, to check the Spark job against."""

import math
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

UTC = timezone.utc


def metres(lat1, lon1, lat2, lon2):
    a = (
        math.sin(math.radians(lat2 - lat1) / 2) ** 2
        + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))
        * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * 6371000.0 * math.asin(math.sqrt(a))


def nearest_schedule(when, secs, zone):
    """(delay, date, instant) on the nearer of today and yesterday."""
    tz = ZoneInfo(zone)
    today = when.astimezone(tz).date()
    options = []
    for date in (today, today - timedelta(days=1)):
        midnight = datetime(date.year, date.month, date.day, tzinfo=tz)
        at = (midnight + timedelta(seconds=secs)).astimezone(UTC)
        options.append(((when - at).total_seconds(), date, at))
    return min(options, key=lambda o: abs(o[0]))


def locate(fix, line):
    """(route distance, distance off the route) of a fix."""
    spots = [(p["stop_lat"], p["stop_lon"], p["dist_m"]) for p in line]
    if len(spots) == 1:
        return spots[0][2], metres(fix["latitude"], fix["longitude"], *spots[0][:2])
    best = None
    for (alat, alon, ad), (blat, blon, bd) in zip(spots, spots[1:]):
        square = (blat - alat) ** 2 + (blon - alon) ** 2
        share = 0.0
        if square > 1e-18:
            dot = (fix["longitude"] - alon) * (blon - alon) + (fix["latitude"] - alat) * (blat - alat)
            share = min(1.0, max(0.0, dot / square))
        off = metres(fix["latitude"], fix["longitude"], alat + share * (blat - alat), alon + share * (blon - alon))
        if best is None or off < best[1]:
            best = (bd if share >= 1 else ad + share * (bd - ad), off)
    return best


def detect(fixes, points, slots, rail_routes, cfg):
    lines = defaultdict(list)
    for p in sorted(points, key=lambda p: p["stop_sequence"]):
        lines[p["trip_id"]].append(p)
    sightings = defaultdict(list)
    by_trip = defaultdict(list)
    for f in sorted(fixes, key=lambda f: (f["timestamp"], f["id"])):
        if f["trip_id"]:
            sightings[f["trip_id"]].append(f["timestamp"])
            by_trip[f["trip_id"]].append(f)

    found = []
    for trip, track in by_trip.items():
        if trip in lines:
            found += one_trip(trip, track, lines[trip], rail_routes, cfg)

    events = []
    for c in found:
        stop = c["stop"]
        delay, date, at = nearest_schedule(c["actual"], stop["arrival_secs"], cfg.zone)
        if abs(delay) > cfg.max_delay:
            continue
        if abs(delay) >= cfg.alias_min_delay:
            wall = c["actual"].astimezone(ZoneInfo(cfg.zone)).replace(tzinfo=None)
            secs = (wall - datetime(date.year, date.month, date.day)).total_seconds()
            others = {
                s["trip_id"] for s in slots
                if (s["route_id"], s["stop_id"]) == (c["route_id"], stop["stop_id"])
                and s["trip_id"] != trip_of(c) and abs(s["arrival_secs"] - secs) <= cfg.alias_max_gap
            }
            window = timedelta(seconds=cfg.alias_active_window)
            until = min(c["emit"], c["actual"] + window)
            if others and not any(
                c["actual"] - window <= t <= until for o in others for t in sightings[o]
            ):
                continue
        events.append({**c, "delay": delay, "date": date, "scheduled": at})

    events.sort(key=lambda e: (e["emit"], e["phase"], e["row"], e["rank"], e["stop"]["stop_sequence"]))
    seen, closed, out = set(), set(), []
    for e in events:
        run = (e["trip_id"], e["date"])
        key = (*run, e["stop"]["stop_sequence"])
        if run in closed or key in seen:
            continue
        seen.add(key)
        out.append(e)
        if e["stop"]["stop_sequence"] == lines[e["trip_id"]][-1]["stop_sequence"]:
            closed.add(run)
    return {
        (e["trip_id"], e["stop"]["stop_sequence"], e["date"]): (
            e["method"], round(e["actual"].timestamp()), round(e["lat"], 6), round(e["lon"], 6),
        )
        for e in out
    }


def trip_of(candidate):
    return candidate["trip_id"]


def one_trip(trip, track, line, rail_routes, cfg):
    out = []
    seats, left = {}, set()
    endings, ended = {}, set()
    prev = None
    first, last = line[0], line[-1]
    quiet_origin = timedelta(seconds=cfg.origin_silence)
    quiet_end = timedelta(seconds=cfg.terminus_silence)

    def add(method, fix, stop, actual, emit, phase, row, rank, lat=None, lon=None):
        out.append({
            "trip_id": trip, "route_id": fix["route_id"], "method": method, "stop": stop,
            "actual": actual, "emit": emit, "phase": phase, "row": row, "rank": rank,
            "lat": fix["latitude"] if lat is None else lat,
            "lon": fix["longitude"] if lon is None else lon,
        })

    def drop_quiet(now):
        for day, seat in list(seats.items()):
            if now is None or now - seat["fix"]["timestamp"] > quiet_origin:
                del seats[day]
                if not seat["denied"]:
                    left.add(day)
                    t = seat["fix"]["timestamp"]
                    add("origin_departure", seat["fix"], first, t, t + quiet_origin, 1, 0, 0)

    def drop_ended(now):
        for day, e in list(endings.items()):
            if now is None or now - e["seen"] > quiet_end:
                del endings[day]
                ended.add(day)
                add("terminus_fallback", e["fix"], last, e["fix"]["timestamp"], e["seen"] + quiet_end, 1, 0, 3)

    for fix in track:
        now = fix["timestamp"]
        drop_quiet(now)
        if fix["latitude"] is None or fix["longitude"] is None:
            prev = None
            continue
        drop_ended(now)
        rail = fix["route_id"] in rail_routes
        radius = cfg.radius_rail if rail else cfg.radius
        dist, off = locate(fix, line)

        # the far end
        day = nearest_schedule(now, last["arrival_secs"], cfg.zone)[1]
        if day not in ended:
            to_end = metres(fix["latitude"], fix["longitude"], last["stop_lat"], last["stop_lon"])
            reach = cfg.terminus_radius_rail if rail else cfg.terminus_radius
            if len(line) > 1:
                reach = min(reach, (last["dist_m"] - line[-2]["dist_m"]) / 2)
            if to_end <= radius:
                ended.add(day)
                endings.pop(day, None)
            else:
                if day in endings:
                    endings[day]["seen"] = now
                if to_end <= reach and (len(line) < 2 or dist >= line[-2]["dist_m"]):
                    if day not in endings or to_end < endings[day]["dist"]:
                        endings[day] = {"fix": fix, "dist": to_end, "seen": now}

        # the origin
        day = nearest_schedule(now, first["arrival_secs"], cfg.zone)[1]
        away = metres(fix["latitude"], fix["longitude"], first["stop_lat"], first["stop_lon"])
        if day not in left:
            if away <= cfg.origin_radius:
                seats[day] = {"fix": fix, "dist": away, "denied": False, "out": None}
            elif day in seats and (
                fix["current_stop_sequence"] is None or fix["current_stop_sequence"] > first["stop_sequence"]
            ):
                seat = seats[day]
                seat["out"] = seat["out"] or (now, away)
                if len(line) < 2 or dist - first["dist_m"] >= cfg.origin_radius * 0.5:
                    t_in, (t_out, d_out) = seat["fix"]["timestamp"], seat["out"]
                    actual = t_out
                    if d_out > seat["dist"]:
                        share = (cfg.origin_radius - seat["dist"]) / (d_out - seat["dist"])
                        actual = t_in + (t_out - t_in) * max(0.0, min(1.0, share))
                    del seats[day]
                    left.add(day)
                    add("origin_departure", seat["fix"], first, actual, now, 0, fix["id"], 0)
                else:
                    seat["denied"] = True

        # stops passed since the previous fix
        if prev is not None:
            before, p_dist, p_off = prev
            gap = (now - before["timestamp"]).total_seconds()
            wide = radius * cfg.corridor_factor
            if 0 < gap <= cfg.segment_max_gap and p_off <= wide and off <= wide and dist > p_dist:
                for stop in line[1:]:
                    if p_dist < stop["dist_m"] <= dist:
                        share = (stop["dist_m"] - p_dist) / (dist - p_dist)
                        add(
                            "segment", fix, stop, before["timestamp"] + (now - before["timestamp"]) * share,
                            now, 0, fix["id"], 1,
                            before["latitude"] + (fix["latitude"] - before["latitude"]) * share,
                            before["longitude"] + (fix["longitude"] - before["longitude"]) * share,
                        )
        prev = (fix, dist, off)

        # at a stop
        if len(line) > 1 and off <= radius:
            stop = min(line[1:], key=lambda s: abs(dist - s["dist_m"]))
            if abs(dist - stop["dist_m"]) <= radius:
                add("geofence", fix, stop, now, now, 0, fix["id"], 2)
    drop_quiet(None)
    drop_ended(None)
    return out
