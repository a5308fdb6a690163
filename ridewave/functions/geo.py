"""Distances, bearings and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance in metres, fine for a kilometre."""
    y = (lat2 - lat1) * (EARTH * math.pi / 180)
    x = (lon2 - lon1) * (EARTH * math.pi / 180) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Clockwise degrees from north on the local plane."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)) + 360, F.lit(360.0))


def cells_around(lat: Column, lon: Column, metres: float, widest_lat: float = 70.0) -> Column:
    """The nine grid cells around a point; a cell is at least ``metres`` wide up to ``widest_lat``."""
    row, column = cell(lat, lon, metres, widest_lat)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(
        (row + i).alias("row"), (column + j).alias("col")))))


def cell(lat: Column, lon: Column, metres: float, widest_lat: float = 70.0) -> tuple[Column, Column]:
    size = metres / 111000.0
    wide = size / math.cos(math.radians(widest_lat))
    return F.floor(lat / size).cast("bigint"), F.floor(lon / wide).cast("bigint")
