"""Distances and other geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.config import EARTH_KM, KM_A_DEGREE


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def circle(lat: Column, lng: Column, radius_km: Column, n: int = 48) -> Column:
    """n points (i, lat, lng) around a centre."""
    step = lambda i: F.lit(2.0) * F.pi() * i / F.lit(float(n))
    up, side = radius_km / KM_A_DEGREE, radius_km / (F.lit(KM_A_DEGREE) * F.cos(F.radians(lat)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (lat + up * F.cos(step(i))).alias("lat"), (lng + side * F.sin(step(i))).alias("lng")))


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting: whether a point is inside a polygon, an array of structs (x, y)."""
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, F.pmod(i - 1 + n, n))
        apart = (a["y"] > y) != (b["y"] > y)
        return F.when(apart, F.when(x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"], 1).otherwise(0)).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i))
    return (n > 0) & (hits % 2 == 1)
