"""Distances and directions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_MILES = 3958.7613
MILE_METRES = 1609.344
OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles between two points."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y, x = F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def octant(degrees: Column) -> Column:
    """Octant of a bearing; an upper edge (22.5, 67.5, ...) belongs to the octant below it."""
    out = F.lit("N")
    for k in range(7, 0, -1):
        out = F.when((degrees > 45 * k - 22.5) & (degrees <= 45 * k + 22.5), F.lit(OCTANTS[k])).otherwise(out)
    return out


def octant_centre(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for k, o in enumerate(OCTANTS) for v in (o, 45.0 * k)]), name)


def turn(degrees: Column, centre: Column) -> Column:
    """Absolute angle between two bearings."""
    return F.abs(F.pmod(degrees - centre + 180.0, F.lit(360.0)) - 180.0)
