"""Distances, bearings and projections on WGS84 degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import EARTH_RADIUS_M


def haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The half-chord term of the haversine; it orders points as the distance does."""
    dphi = F.sin(F.radians(lat2 - lat1) / 2)
    dlam = F.sin(F.radians(lon2 - lon1) / 2)
    return dphi * dphi + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlam * dlam


def metres_of_term(term: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(term))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    return metres_of_term(haversine_term(lat1, lon1, lat2, lon2))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second; null when they coincide."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlam = F.radians(lon2 - lon1)
    y = F.sin(dlam) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlam)
    angle = F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))
    return F.when(~((lat1 == lat2) & (lon1 == lon2)), angle)


def same_place(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, tolerance: float = 0.0002
) -> Column:
    """Both coordinates within the tolerance; any null means no."""
    near = (F.abs(lat1 - lat2) < tolerance) & (F.abs(lon1 - lon2) < tolerance)
    return F.coalesce(near, F.lit(False))


def valid_gps(lat: Column, lon: Column, zero: float = 0.001) -> Column:
    """Present and not the tracker's 0,0 default."""
    return (
        lat.isNotNull() & lon.isNotNull() & ~((F.abs(lat) < zero) & (F.abs(lon) < zero))
    )


def outside_disc(lat: Column, lon: Column, centre: tuple[float, float], radius_deg: float) -> Column:
    """Not within a planar disc given in degrees."""
    dlat, dlon = lat - F.lit(centre[0]), lon - F.lit(centre[1])
    return ~(dlat * dlat + dlon * dlon < F.lit(radius_deg * radius_deg))


def leg(lat_a: Column, lon_a: Column, dist_a: Column, lat_b: Column, lon_b: Column, dist_b: Column) -> Column:
    """A straight leg as start, direction and inverse squared length, all in degrees."""
    dlat, dlon = lat_b - lat_a, lon_b - lon_a
    square = dlat * dlat + dlon * dlon
    return F.struct(
        lat_a.alias("lat"), lon_a.alias("lon"), dlat.alias("dlat"), dlon.alias("dlon"),
        F.when(square > 1e-18, 1 / square).otherwise(F.lit(0.0)).alias("inverse"),
        dist_a.alias("dist"), dist_b.alias("end_dist"),
    )


def along_leg(lat: Column, lon: Column, on: Column) -> Column:
    """Share of a leg at which a point projects, clamped to [0, 1].

    Planar in degrees, without latitude scaling.
    """
    share = ((lon - on["lon"]) * on["dlon"] + (lat - on["lat"]) * on["dlat"]) * on["inverse"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def leg_terms(lat: Column, lon: Column, cos_lat: Column, legs: Column) -> Column:
    """Half-chord term of the distance to each leg of an array.

    Lambdas are interpreted, so the share is bound once per leg and the cosine of
    the point's latitude comes in as a column.
    """

    def term(on: Column, share: Column) -> Column:
        clat = on["lat"] + share * on["dlat"]
        dphi = F.sin(F.radians(clat - lat) / 2)
        dlam = F.sin(F.radians(on["lon"] + share * on["dlon"] - lon) / 2)
        return F.pow(dphi, 2.0) + cos_lat * F.cos(F.radians(clat)) * F.pow(dlam, 2.0)

    return F.transform(
        legs,
        lambda on: F.transform(F.array(along_leg(lat, lon, on)), lambda share: term(on, share))[0],
    )
