"""Distances, projections and areas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
LON_M = 111320.0
LAT_M = 111132.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    rad = math.pi / 180.0
    a = F.pow(F.sin((lat2 - lat1) * rad / 2.0), F.lit(2.0)) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2.0), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def meters_per_degree(lat: Column) -> tuple[Column, Column]:
    """(along a parallel, at least 1; along a meridian)."""
    return F.greatest(F.lit(1.0), F.lit(LON_M) * F.cos(lat * math.pi / 180.0)), F.lit(LAT_M)


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(x, y, share of the way from a to b) of the nearest point of a segment, in a plane scaled at the point."""
    mx, my = meters_per_degree(py)
    dx, dy = (bx - ax) * mx, (by - ay) * my
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * mx * dx + (py - ay) * my * dy) / square))).otherwise(F.lit(0.0))
    return ax + (bx - ax) * t, ay + (by - ay) * t, t


def ring_area(coords: Column) -> Column:
    """Signed planar area (counter-clockwise positive) of an array of (x, y); closing it isn't needed."""
    following = F.concat(F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 1, 1))
    return F.aggregate(F.zip_with(coords, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v) / 2.0


def quantize(deg: Column) -> Column:
    """Micro-degrees."""
    return F.round(deg * 1e6).cast("bigint")
