"""Areas of a day on a map: hull, smoothing, fitting around the stops; GeoJSON for any renderer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.config import KM_A_DEGREE

# Growth factors tried in turn, the margin around stops, the least radius, smoothing rounds.
FACTORS, MARGIN_KM, LEAST_RADIUS_KM, SMOOTHING = (1.15, 1.3, 1.45, 1.6, 1.8, 2.0, 2.3, 2.7, 3.2), 0.35, 0.4, 3


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of distinct points, counter-clockwise from the least; collinear points are left out; two or fewer stay as they are."""
    points = np.unique(points, axis=0)
    if len(points) <= 2:
        return points

    def chain(ordered):
        found: list[np.ndarray] = []
        for p in ordered:
            while len(found) > 1 and np.cross(np.append(found[-1] - found[-2], 0), np.append(p - found[-2], 0))[2] <= 0:
                found.pop()
            found.append(p)
        return found[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def smooth(polygon: np.ndarray, rounds: int = SMOOTHING) -> np.ndarray:
    """Corner cutting: each edge gives its points at a quarter and three quarters."""
    for _ in range(rounds):
        after = np.roll(polygon, -1, axis=0)
        polygon = np.stack([0.75 * polygon + 0.25 * after, 0.25 * polygon + 0.75 * after], axis=1).reshape(-1, 2)
    return polygon


def local(points: np.ndarray, lat0: float) -> np.ndarray:
    """(lat, lng) to km east and north."""
    return np.stack([points[:, 1] * KM_A_DEGREE * np.cos(np.radians(lat0)), points[:, 0] * KM_A_DEGREE], axis=1)


def inside(points: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Ray casting for each point."""
    a, b = polygon, np.roll(polygon, 1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    apart = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (apart & left).sum(axis=1) % 2 == 1


def boundary_km(points: np.ndarray, polygon: np.ndarray) -> float:
    """The least distance of a point to an edge, in local km."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    d = b - a
    length = np.maximum((d**2).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(-1) / length, 0, 1)
    return float(np.sqrt(((points[:, None] - (a + t[..., None] * d)) ** 2).sum(-1)).min())


def circle(centre: np.ndarray, radius_km: float, n: int = 48) -> np.ndarray:
    angle = 2 * np.pi * np.arange(n) / n
    return np.stack([centre[0] + radius_km / KM_A_DEGREE * np.cos(angle), centre[1] + radius_km / (KM_A_DEGREE * np.cos(np.radians(centre[0]))) * np.sin(angle)], axis=1)


def fit(points: np.ndarray) -> np.ndarray:
    """An area around the stops: hull, or a circle for fewer than three, grown until all are well inside, then smoothed."""
    centre = points.mean(0)
    base = hull(points)
    if len(base) < 3:
        away = np.sqrt((local(points - centre, centre[0]) ** 2).sum(1).max())
        base = circle(centre, max(float(away), LEAST_RADIUS_KM))
    else:
        base = smooth(base)
    at = local(points, centre[0])
    for factor in FACTORS:
        grown = centre + (base - centre) * factor
        ring = local(grown, centre[0])
        if inside(at, ring).all() and boundary_km(at, ring) >= MARGIN_KM:
            break
    return grown


_SHAPES = {"hull": hull, "smooth": lambda p: smooth(hull(p)) if len(hull(p)) > 2 else hull(p), "area": fit}


def day_shapes(stops: DataFrame, shape: str = "area") -> DataFrame:
    """request_id, day, vertex, lat, lng: a polygon around the stops (request_id, day, lat, lng) of each day."""
    make = _SHAPES[shape]
    kind = dict(stops.dtypes)["request_id"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ring = make(rows[["lat", "lng"]].to_numpy(float))
        return pd.DataFrame({"request_id": rows["request_id"].iloc[0], "day": rows["day"].iloc[0], "vertex": np.arange(len(ring), dtype="int32"), "lat": ring[:, 0], "lng": ring[:, 1]})

    return stops.select("request_id", F.col("day").cast("int").alias("day"), "lat", "lng").groupBy("request_id", "day").applyInPandas(work, f"request_id {kind}, day int, vertex int, lat double, lng double")


def day_centroids(stops: DataFrame) -> DataFrame:
    return stops.groupBy("request_id", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def label_points(shapes: DataFrame) -> DataFrame:
    """The vertex farthest to the north-west of each day's polygon, for its label."""
    return shapes.groupBy("request_id", "day").agg(F.max_by(F.struct("lat", "lng"), F.struct(F.col("lat") - F.col("lng"), -F.col("vertex"))).alias("at")).select("request_id", "day", "at.lat", "at.lng")


def geojson(shapes: DataFrame) -> DataFrame:
    """request_id, day, geometry: each day's polygon as a GeoJSON text."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct("vertex", "lng", "lat"))), lambda v: F.array(v["lng"], v["lat"]))
    rings = shapes.groupBy("request_id", "day").agg(ring.alias("ring"))
    closed = F.concat("ring", F.slice("ring", F.lit(1), F.lit(1)))
    return rings.select("request_id", "day", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))).alias("geometry"))
