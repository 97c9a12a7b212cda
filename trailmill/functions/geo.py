"""Geometry scalars as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Fastest believable speed by kind, metres a second; all others as for rides.
FOOT_GATE, RIDE_GATE = 12.5, 30.0
COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_M) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # least() would pass over a null


def speed(m: Column, seconds: Column) -> Column:
    """Implied speed: without time, infinite for any distance and 0 for none; null before the first point."""
    return F.when(seconds > 0, m / seconds).when(m > 0, F.lit(float("inf"))).when(m.isNotNull(), 0.0)


def speed_gate(kind: Column) -> Column:
    return F.when(kind.isin("run", "walk", "hike", "strength"), FOOT_GATE).otherwise(RIDE_GATE)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def interpolate(lat1: Column, lng1: Column, lat2: Column, lng2: Column, f: Column) -> tuple[Column, Column]:
    """Great-circle point a share f of the way; equal ends give the first."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lng1, lat2, lng2))
    d = metres(lat1, lng1, lat2, lng2) / EARTH_M
    s1, s2 = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
    x = s1 * F.cos(a1) * F.cos(o1) + s2 * F.cos(a2) * F.cos(o2)
    y = s1 * F.cos(a1) * F.sin(o1) + s2 * F.cos(a2) * F.sin(o2)
    z = s1 * F.sin(a1) + s2 * F.sin(a2)
    lat = F.when(F.sin(d) == 0, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    return lat, F.when(F.sin(d) == 0, lng1).otherwise(F.degrees(F.atan2(y, x)))


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Web mercator on the unit square."""
    return (lng + 180) / 360, F.lit(0.5) - F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) / (2 * 3.141592653589793)
