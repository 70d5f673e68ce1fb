"""Route shapes: points in order, simplified polylines, the variant nearest to a vehicle."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.session import stored

EPSILON_DEG = 0.00005
CHUNK_POINTS = 100_000


def keep_mask(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points of one polyline stay (Ramer-Douglas-Peucker, planar)."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(points) - 1)]
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        offset = points[a + 1 : b] - points[a]
        chord = points[b] - points[a]
        square = float(chord @ chord)
        if square == 0:
            far = (offset**2).sum(axis=1)
        else:
            far = (offset[:, 0] * chord[1] - offset[:, 1] * chord[0]) ** 2 / square
        worst = int(far.argmax())
        if far[worst] > epsilon * epsilon:
            split = a + 1 + worst
            keep[split] = True
            open_spans += [(a, split), (split, b)]
    return keep


def _distance_sq() -> Column:
    """Squared planar distance of (lat, lon) to the line through the span's ends."""
    dx, dy = F.col("lat1") - F.col("lat0"), F.col("lon1") - F.col("lon0")
    px, py = F.col("lat") - F.col("lat0"), F.col("lon") - F.col("lon0")
    square = dx * dx + dy * dy
    cross = px * dy - py * dx
    return F.when(square == 0, px * px + py * py).otherwise(cross * cross / square)


def _cut(spans: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """One round over open spans: their halves, and the two ends of those that stay straight.

    The rule cuts a polyline at its farthest point, the first of equals, and goes on with both
    halves, so halves are independent. The cut point belongs to both.
    """
    end = F.struct("seq", "lat", "lon")
    ends = spans.groupBy("shape_id", "span").agg(F.min(end).alias("a"), F.max(end).alias("b")).select(
        "shape_id", "span", F.col("a.seq").alias("seq0"), F.col("a.lat").alias("lat0"), F.col("a.lon").alias("lon0"),
        F.col("b.seq").alias("seq1"), F.col("b.lat").alias("lat1"), F.col("b.lon").alias("lon1"))
    inner = spans.join(ends, ["shape_id", "span"]).filter((F.col("seq") > F.col("seq0")) & (F.col("seq") < F.col("seq1")))
    worst = inner.groupBy("shape_id", "span").agg(
        F.max(F.struct(_distance_sq().alias("d"), (-F.col("seq")).alias("s"))).alias("w")
    ).select("shape_id", "span", (-F.col("w.s")).alias("cut"), (F.col("w.d") > epsilon * epsilon).alias("splits"))
    halves = F.when(F.col("seq") < F.col("cut"), F.array("span")).when(
        F.col("seq") > F.col("cut"), F.array("cut")).otherwise(F.array("span", "cut"))
    cut = spans.join(worst.filter("splits"), ["shape_id", "span"]).select(
        "shape_id", "seq", "lat", "lon", F.explode(halves).alias("span"))
    straight = ends.join(worst.filter("not splits"), ["shape_id", "span"]).select("shape_id", F.explode(F.array(
        F.struct(F.col("seq0").alias("seq"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon")),
        F.struct(F.col("seq1").alias("seq"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")))).alias("p")).select(
        "shape_id", "p.*")
    return cut, straight


def simplify_shapes(points: DataFrame, epsilon: float = EPSILON_DEG, chunk: int = CHUNK_POINTS) -> DataFrame:
    """Points that remain of each shape: shape_id, seq, lat, lon.

    ``points`` has unique (shape_id, seq). Spans of up to ``chunk`` points, the memory of a
    task, are simplified each in one task. Longer ones are a frontier: a round cuts each of them
    once and hands on their halves only, so a span is written in no round after the one it is
    short enough in. A shape of n points has n - chunk rounds at most, and about
    log2(n / chunk) where cuts fall near the middle.
    """
    kind = points.schema["shape_id"].dataType.simpleString()
    schema = f"shape_id {kind}, seq long, lat double, lon double"

    def simplify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        if len(frame) > 2:
            frame = frame[keep_mask(frame[["lat", "lon"]].to_numpy(), epsilon)]
        return frame[["shape_id", "seq", "lat", "lon"]]

    spans = points.select("shape_id", F.col("seq").cast("long").alias("seq"), "lat", "lon", F.lit(0).cast("long").alias("span"))
    found = []
    while True:
        long = spans.groupBy("shape_id", "span").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("shape_id", "span")
        last = long.isEmpty()
        short = spans if last else spans.join(long, ["shape_id", "span"], "left_anti")
        found.append(short.groupBy("shape_id", "span").applyInPandas(simplify, schema))
        if last:
            break
        spans, straight = _cut(spans.join(long, ["shape_id", "span"], "left_semi"), epsilon)
        spans = stored(spans, "spans")
        found.append(straight)
    kept = found[0]
    for more in found[1:]:
        kept = kept.unionByName(more)
    return kept.distinct()


def shapes_of_routes(trips: DataFrame, points: DataFrame, folders: DataFrame, routes: DataFrame) -> DataFrame:
    """Points of the shapes the routes' trips use, from the folder of the last such trip.

    ``folders`` has (trip_id, shape_id, folder_rank).
    """
    used = (
        folders.filter(F.coalesce("shape_id", F.lit("")) != "")
        .join(trips.select("trip_id", "route_id"), "trip_id")
        .join(routes.select("route_id"), "route_id", "left_semi")
    )
    owner = used.groupBy("shape_id").agg(F.max("folder_rank").alias("folder_rank"))
    mine = points.join(owner, ["shape_id", "folder_rank"], "left_semi")
    pairs = used.select("route_id", "shape_id").distinct()
    return pairs.join(mine.select("shape_id", "seq", "lat", "lon"), "shape_id")


def nearest_variant(
    route_points: DataFrame, route_id: str, at: tuple[float, float] | None
) -> DataFrame:
    """The shape of a route with the point closest to a place, in squared degrees.

    One aggregate over the route's points; without a place the first shape.
    """
    rows = route_points.filter(F.col("route_id") == route_id)
    if at is None:
        return rows.agg(F.min("shape_id").alias("shape_id"))
    d = F.pow(F.col("lat") - F.lit(at[0]), 2) + F.pow(F.col("lon") - F.lit(at[1]), 2)
    return rows.agg(F.min_by("shape_id", F.struct(d, F.col("shape_id"))).alias("shape_id"))


def as_polylines(points: DataFrame, chunk: int = CHUNK_POINTS) -> DataFrame:
    """Points gathered into arrays of at most ``chunk`` sequence numbers per row."""
    part = F.floor(F.col("seq") / chunk).alias("part")
    return points.groupBy("shape_id", part).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))),
            lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")),
        ).alias("points")
    )
