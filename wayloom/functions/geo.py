"""Geometry as native column expressions: no UDF ever sees a coordinate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
METERS_PER_DEGREE = 111_320.0


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres between two points in degrees; null if a coordinate is."""
    lat1, lng1, lat2, lng2 = map(c, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least(1.0, a) would pass over a null


def metres(lat1, lng1, lat2, lng2) -> Column:
    """The same as an int, halves to even."""
    return F.rint(haversine(lat1, lng1, lat2, lng2)).cast("int")


def mercator_x(lng) -> Column:
    return F.radians(c(lng)) * MERCATOR_M


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(c(lat)) / 2)) * MERCATOR_M


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Planar bearing in degrees, as a map marker turns."""
    return F.degrees(F.atan2(c(lng2) - c(lng1), c(lat2) - c(lat1)))


def fraction_on_segment(px, py, x1, y1, x2, y2) -> Column:
    """Where the point's projection falls on the segment, 0 to 1; 0 on a segment without length."""
    px, py, x1, y1, x2, y2 = map(c, (px, py, x1, y1, x2, y2))
    square = F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)
    t = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / square
    return F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)


def walk_network_penalty(status, straight, network) -> Column:
    """Score points for a walk that the street network makes longer than the straight line."""
    status, straight, network = c(status), F.greatest(F.lit(0.0), c(straight).cast("double")), c(network).cast("double")
    net = F.greatest(F.lit(0.0), F.coalesce(network, straight))
    ratio = F.when(straight > 0, net / straight).otherwise(1.0)
    half_up = lambda x: F.floor(x + 0.5)
    detour = F.when((ratio > 2.2) & (net >= 700), F.least(F.lit(18.0), (ratio - 2.2) * 4)).otherwise(0.0)
    far = F.when(net > 2500, (net - 2500) / 350).otherwise(0.0) + F.when(net > 5000, 25.0).otherwise(0.0)
    found = F.greatest(F.lit(0), half_up(F.greatest(F.lit(0.0), net - straight) / 70 + detour + far))
    lost = F.when(straight < 350, F.greatest(F.lit(3), half_up(straight / 80))).otherwise(half_up(8 + straight / 120))
    return F.when(status == "unavailable", 0).when(status == "no_route", lost).otherwise(found).cast("int")
