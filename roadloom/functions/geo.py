"""Great-circle geometry and grid cells as Column expressions. Coordinates are degrees, distances metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Cells are a hundredth of a degree wide.
CELLS_A_DEGREE = 100


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance between two points."""
    p, q = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return (angle + 360) % 360


def destination(lat: Column, lon: Column, towards: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lon) of the point that lies so far in a direction."""
    p, b, d = F.radians(lat), F.radians(towards), metres / EARTH_M
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), (lon + F.degrees(turn) + 540) % 360 - 180


def cell(degrees: Column) -> Column:
    """The cell of a latitude or longitude: the nearest hundredth, in single precision, halves away from zero."""
    return F.round(degrees.cast("float") * F.lit(float(CELLS_A_DEGREE)).cast("float")).cast("int")


def wrap(at: Column, limit: int) -> Column:
    """A cell number brought back into -limit .. limit across the antimeridian."""
    return F.when(at > limit, at - 2 * limit).when(at < -limit, at + 2 * limit).otherwise(at)


def ring(rings: int) -> Column:
    """Array of (dlat, dlon, ring): the offsets of all cells up to ``rings`` away, as squares around a cell."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(i.alias("dlat"), j.alias("dlon"), F.greatest(F.abs(i), F.abs(j)).alias("ring")))))


def heading_priority(next_bearing: Column, fork_bearing: Column) -> Column:
    """255 if a fork leads straight to what comes next, down to 0 if it leads away."""
    turn = F.abs(next_bearing - fork_bearing)
    return (255 - F.round(F.least(turn, 360 - turn) * (255.0 / 180.0))).cast("int")


def polygon_area(ring_points: list[tuple[float, float]]) -> float:
    """Square metres inside a ring of (lat, lon), on the sphere."""
    total = 0.0
    for (lat1, lon1), (lat2, lon2) in zip(ring_points, ring_points[1:] + ring_points[:1], strict=True):
        total += math.radians(lon2 - lon1) * (2 + math.sin(math.radians(lat1)) + math.sin(math.radians(lat2)))
    return abs(total) * EARTH_M**2 / 2
