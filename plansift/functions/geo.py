"""Distances and coordinates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansift.functions import checked

POI_RADIUS, ROUTE_RADIUS, SPEED = 6371.0, 6371.0088, 40.0


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return s * s + F.cos(a) * F.cos(b) * t * t


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = POI_RADIUS) -> Column:
    """Kilometres, rounded to 2."""
    return F.round(2 * F.lit(radius) * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lng1, lat2, lng2)))), 2)


def route_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Straight-line kilometres of a route, by the two-argument arc tangent."""
    h = F.least(F.lit(1.0), _half_chord(lat1, lng1, lat2, lng2))
    return F.round(F.lit(ROUTE_RADIUS) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)), 2)


def route_minutes(km: Column, speed: float = SPEED) -> Column:
    return F.when(km == 0, F.lit(0.0)).otherwise(F.round(km.cast("decimal(18,2)") * F.lit(60 / speed).cast("decimal(10,4)"), 2).cast("double"))


def coordinate(c: Column, limit: float) -> Column:
    """A latitude (limit 90) or longitude (180) from text or number; null if out of range or no number."""
    v = c.try_cast("double")
    return F.when(v.between(-limit, limit), v)


def coordinate_checked(c: Column, limit: float) -> Column:
    """As coordinate(), checked. Reasons: not_a_number, out_of_range."""
    return checked.number(c, "double", -limit, limit)


def coordinate_key(lat: Column, lng: Column, decimals: int) -> Column:
    """Coordinates as part of a cache key."""
    return F.format_string(f"%.{decimals}f,%.{decimals}f", lat, lng)
