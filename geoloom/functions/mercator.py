"""Web-Mercator tile arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
MAX_LAT = 85.05112877980659
EDGE = math.pi * R
MAX_ZOOM = 24
#: Share of a tile by which its neighbourhood grows on each side when features are picked for it.
TILE_MARGIN = 0.1


def to_meters(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees; latitudes beyond the projection are held at its edge."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    return lon * EDGE / 180.0, F.log(F.tan((held + 90.0) * math.pi / 360.0)) * R


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    return x / EDGE * 180.0, F.atan(F.sinh(y / R)) * 180.0 / math.pi


def tiles_at(z: Column) -> Column:
    """2^z as BIGINT."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int"))


def tile_fraction(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Tile coordinates with fractions."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    phi = held * math.pi / 180.0
    n = tiles_at(z).cast("double")
    return (lon + 180.0) / 360.0 * n, (1.0 - F.asinh(F.tan(phi)) / math.pi) / 2.0 * n


def clamp_tile(v: Column, z: Column) -> Column:
    return F.least(F.greatest(F.floor(v).cast("bigint"), F.lit(0).cast("bigint")), tiles_at(z) - 1)


def tile_of(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Tile (x, y) of a point at zoom z."""
    x, y = tile_fraction(lon, lat, z)
    return clamp_tile(x, z), clamp_tile(y, z)


def bounds_3857(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(minx, miny, maxx, maxy) in metres."""
    size = F.lit(2 * EDGE) / tiles_at(z).cast("double")
    minx, maxy = x * size - EDGE, F.lit(EDGE) - y * size
    return minx, maxy - size, minx + size, maxy


def bounds_4326(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees."""
    minx, miny, maxx, maxy = bounds_3857(z, x, y)
    west, south = to_degrees(minx, miny)
    east, north = to_degrees(maxx, maxy)
    return west, south, east, north


def flip_y(z: Column, y: Column) -> Column:
    """Row between the XYZ and TMS schemes."""
    return tiles_at(z) - 1 - y


def tile_valid(z: Column, x: Column, y: Column) -> Column:
    ok = z.between(0, MAX_ZOOM)
    n = tiles_at(F.least(F.greatest(z, F.lit(0)), F.lit(MAX_ZOOM)))
    return ok & (x >= 0) & (y >= 0) & (x < n) & (y < n)
