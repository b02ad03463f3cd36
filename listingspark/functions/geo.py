"""Distances on the sphere and grid cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
#: Degrees of latitude of a grid cell; about 550 m.
CELL = 0.005


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(h))


def cell(degrees: Column, size: float = CELL) -> Column:
    return F.floor(degrees / size)


def neighbours(c: Column, reach: int = 1) -> Column:
    return F.sequence(c - reach, c + reach)


def on_sphere(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere as x, y, z; nearer on the globe is nearer in space."""
    y, x = F.radians(lat), F.radians(lng)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def cube(x: str, y: str, z: str, level: int) -> Column:
    """Number of the cube that holds a point on the unit sphere, of 4^level to a side (level 10 at most)."""
    side = 4**level
    at = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.col(c) + 1) * (side / 2)), F.lit(side - 1))).cast("long")
    return (at(x) * side + at(y)) * side + at(z)
