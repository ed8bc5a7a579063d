"""Splitting the places of a request into geographically compact days.

Requests are independent, so Spark deals them out by request_id and each group (at most some
hundred recalled places) is worked on with numpy: clusters of bounded size and diameter, single
points absorbed, clusters dealt to days, days corrected and filled. Same input, same seed, same
result; the order of a group is that of its ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.config import EARTH_KM, Spatial
from placeloom.functions.geo import haversine
from placeloom.functions.text import valid_coordinate
from placeloom.operators.blocks import against, if_few
from placeloom.session import written

Cluster = list[int]


def km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points (lat, lng), broadcast."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def kmeans(points: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several seeded runs of Lloyd's algorithm with spread starting centres."""
    random, best, least = np.random.default_rng(seed), np.zeros(len(points), int), np.inf
    for _ in range(starts):
        centres = points[[random.integers(len(points))]]
        while len(centres) < k:
            gap = ((points[:, None] - centres[None]) ** 2).sum(-1).min(1)
            if gap.sum() <= 0:
                break
            centres = np.vstack([centres, points[random.choice(len(points), p=gap / gap.sum())]])
        labels = np.full(len(points), -1)
        for _ in range(rounds):
            gaps = ((points[:, None] - centres[None]) ** 2).sum(-1)
            new = gaps.argmin(1)
            if (new == labels).all():
                break
            labels = new
            centres = np.array([points[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(len(centres))])
        cost = ((points - centres[labels]) ** 2).sum()
        if cost < least - 1e-15:
            best, least = labels, cost
    return best


def _parts(points: np.ndarray, members: Cluster, k: int, seed: int) -> list[Cluster]:
    labels = kmeans(points[members], k, seed)
    return [[m for m, x in zip(members, labels) if x == j] for j in range(labels.max() + 1) if (labels == j).any()]


def cap_size(points: np.ndarray, members: Cluster, limit: int, seed: int) -> list[Cluster]:
    """Parts of at most ``limit`` points; points that can't be told apart are cut in their order."""
    if len(members) <= limit:
        return [members]
    parts = _parts(points, members, max(2, math.ceil(len(members) / limit)), seed)
    if len(parts) == 1:
        return [members[i : i + limit] for i in range(0, len(members), limit)]
    return [q for p in parts for q in cap_size(points, p, limit, seed)]


def cap_diameter(points: np.ndarray, members: Cluster, limit: float) -> list[Cluster]:
    """Parts none of which is wider than ``limit`` km: of the farthest pair the earlier point leaves, again and again."""
    stays, leaves = list(members), []
    while len(stays) > 1:
        gaps = np.triu(km(points[stays][:, None], points[stays][None]), 1)
        i, j = np.unravel_index(gaps.argmax(), gaps.shape)
        if gaps[i, j] <= limit:
            break
        leaves.append(stays.pop(min(i, j)))
    return [stays] + (cap_diameter(points, leaves, limit) if leaves else [])


def clusters_of(points: np.ndarray, s: Spatial) -> list[Cluster]:
    n = len(points)
    if not n:
        return []
    k = min(s.cluster_k, max(2, math.ceil(n / s.max_size)), n)
    sized = [q for p in _parts(points, list(range(n)), k, s.seed) for q in cap_size(points, p, s.max_size, s.seed)]
    return [q for p in sized for q in cap_diameter(points, p, s.max_km)]


def is_urban(districts: np.ndarray, members: Cluster, s: Spatial) -> bool:
    return sum(districts[m] in s.urban_districts for m in members) > len(members) / 2


def absorb_singletons(points: np.ndarray, districts: np.ndarray, clusters: list[Cluster], s: Spatial) -> list[Cluster]:
    """Urban single points join the nearest larger urban cluster, whose centre moves with them."""
    urban = [list(c) for c in clusters if is_urban(districts, c, s)]
    rural = [list(c) for c in clusters if not is_urban(districts, c, s)]
    multi, single = [c for c in urban if len(c) > 1], [c for c in urban if len(c) == 1]
    if not multi:
        return clusters
    for (p,) in single:
        nearest = min(range(len(multi)), key=lambda j: float(km(points[p], points[multi[j]].mean(0))))
        multi[nearest].append(p)
    return multi + rural


def _centre(points: np.ndarray, segment: list[Cluster]) -> np.ndarray:
    members = [m for c in segment for m in c]
    return points[members].mean(0) if members else np.zeros(2)


def _size(segment: list[Cluster]) -> int:
    return sum(map(len, segment))


def deal_days(points: np.ndarray, clusters: list[Cluster], days: int, s: Spatial) -> list[list[Cluster]]:
    """Clusters to days by their centres; with no more clusters than days, one each."""
    if len(clusters) <= days:
        return [[c] for c in clusters] + [[] for _ in range(days - len(clusters))]
    labels = kmeans(np.array([_centre(points, [c]) for c in clusters]), days, s.seed)
    return [[c for c, x in zip(clusters, labels) if x == d] for d in range(days)]


def correct(points: np.ndarray, segments: list[list[Cluster]], s: Spatial) -> list[list[Cluster]]:
    """Rounds in which each cluster moves to the nearest day's centre, centres held still, until none moves."""
    for _ in range(s.correction_rounds):
        centres = np.array([_centre(points, seg) for seg in segments])
        full = [d for d, seg in enumerate(segments) if seg]
        new: list[list[Cluster]] = [[] for _ in segments]
        moved = False
        for d, seg in enumerate(segments):
            for c in seg:
                to = full[int(km(_centre(points, [c]), centres[full]).argmin())]
                moved |= to != d
                new[to].append(c)
        if not moved:
            break
        segments = new
    return segments


def fill(points: np.ndarray, segments: list[list[Cluster]], s: Spatial) -> list[list[Cluster]]:
    """While a day has too few points, it takes the closest cluster of the nearest day that can spare its smallest one."""
    segments = [list(seg) for seg in segments]
    for _ in range(s.fill_rounds):
        small = min(range(len(segments)), key=lambda d: _size(segments[d]))
        if _size(segments[small]) >= s.min_points:
            break
        here = _centre(points, segments[small])
        donors = [d for d, seg in enumerate(segments) if d != small and seg and _size(seg) - min(map(len, seg)) >= s.min_points]
        if not donors:
            break
        donor = min(donors, key=lambda d: float(km(here, _centre(points, segments[d]))))
        taken = min(range(len(segments[donor])), key=lambda i: float(km(here, _centre(points, [segments[donor][i]]))))
        segments[small].append(segments[donor].pop(taken))
    return segments


def order_days(points: np.ndarray, segments: list[list[Cluster]], start: np.ndarray) -> list[list[Cluster]]:
    """Days in the order of a walk: nearest to the start first, then nearest to the previous one; empty ones last."""
    left, found, at = [seg for seg in segments if seg], [], start
    while left:
        i = min(range(len(left)), key=lambda j: float(km(at, _centre(points, left[j]))))
        found.append(left.pop(i))
        at = _centre(points, found[-1])
    return found + [seg for seg in segments if not seg]


STEPS = ("clusters", "absorbed", "dealt", "corrected", "filled", "planned")


def plan_days(points: np.ndarray, districts: np.ndarray, days: int, start: np.ndarray, s: Spatial, upto: str = "planned") -> list[list[Cluster]]:
    """Days of clusters of point numbers after the step ``upto``; before days exist, one day holds all clusters."""
    clusters = clusters_of(points, s)
    if upto == "clusters":
        return [clusters]
    clusters = absorb_singletons(points, districts, clusters, s)
    if upto == "absorbed":
        return [clusters]
    urban, rural = [c for c in clusters if is_urban(districts, c, s)], [c for c in clusters if not is_urban(districts, c, s)]
    segments = deal_days(points, urban, days, s)
    if upto in STEPS[3:]:
        segments = correct(points, segments, s)
    if upto in STEPS[4:]:
        segments = fill(points, segments, s)
    if upto != "planned":
        return segments
    empty = next((d for d, seg in enumerate(segments) if not seg), None)
    if rural and empty is not None:
        segments[empty] = rural
    return order_days(points, segments, start)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearest(here: Column, places: Column, key: str) -> Column:
    """The ``key`` of the nearest of ``places`` (sums lat and lng of n points); ties to the smallest key; null if there are none."""
    centre = lambda p: (p["lat"] / p["n"], p["lng"] / p["n"])
    away = lambda p: F.struct(haversine(here["lat"] / F.greatest(here["n"], F.lit(1)), here["lng"] / F.greatest(here["n"], F.lit(1)), *centre(p)).alias("km"), p[key].alias("key"))
    return F.array_min(F.transform(places, away))["key"]


def _days(clusters: Column, days: Column) -> Column:
    """n, day, least (points of the smallest cluster) and sums lat and lng of each day's points; a day without clusters has zeros."""

    def day(d: Column) -> Column:
        own = F.filter(clusters, lambda c: c["day"] == d)
        total = lambda x, name, zero: F.aggregate(x, zero, lambda t, c: t + c[name])
        sums = lambda x: F.struct(total(x, "n", F.lit(0).cast("long")).alias("n"), d.alias("day"), F.array_min(F.transform(x, lambda c: c["n"])).alias("least"), *(total(x, c, F.lit(0.0)).alias(c) for c in ("lat", "lng")))
        return _let(own, sums)

    return F.transform(F.filter(F.sequence(F.lit(0), days), lambda d: d > 0), day)


def _absorbed(clusters: Column) -> Column:
    """Clusters after urban single points, in the order of their numbers, have joined the nearest larger urban one, whose centre moves with them."""

    def join(found: Column, p: Column) -> Column:
        grown = lambda c: c.withField("n", c["n"] + 1).withField("lat", c["lat"] + p["lat"]).withField("lng", c["lng"] + p["lng"]).withField("ids", F.concat(c["ids"], p["ids"]))
        return _let(_nearest(p, found, "cluster"), lambda goal: F.transform(found, lambda c: F.when(c["cluster"] == goal, grown(c)).otherwise(c)))

    larger, alone = F.filter(clusters, lambda c: c["urban"] & (c["n"] > 1)), F.filter(clusters, lambda c: c["urban"] & (c["n"] == 1))
    joined = F.concat(F.aggregate(alone, larger, join), F.filter(clusters, lambda c: ~c["urban"]))
    return F.when(F.size(larger) > 0, joined).otherwise(clusters)


def _corrected(clusters: Column, days: Column, rounds: int) -> Column:
    """Clusters after rounds in which each moves to the nearest day's centre, centres held still; once none moves, rounds change nothing."""

    def turn(found: Column, _: Column) -> Column:
        full = F.filter(_days(found, days), lambda d: d["n"] > 0)
        return _let(full, lambda ds: F.transform(found, lambda c: F.when(c["day"].between(1, days), c.withField("day", _nearest(c, ds, "day"))).otherwise(c)))

    return F.aggregate(F.array_repeat(F.lit(0), rounds), clusters, turn)


def _filled(clusters: Column, days: Column, rounds: int, least: int) -> Column:
    """Clusters after rounds in which the day of fewest points takes the closest cluster of the nearest day that can spare its smallest one."""

    def take(found: Column, ds: Column, poor: Column) -> Column:
        donors = F.filter(ds, lambda d: (d["day"] != poor["day"]) & (d["n"] > 0) & (d["n"] - d["least"] >= least))
        moved = _let(_nearest(poor, donors, "day"), lambda giver: _nearest(poor, F.filter(found, lambda c: c["day"] == giver), "cluster"))
        return _let(moved, lambda m: F.transform(found, lambda c: F.when(c["cluster"] == m, c.withField("day", poor["day"])).otherwise(c)))

    def turn(found: Column, _: Column) -> Column:
        poorest = lambda ds: F.array_min(F.transform(ds, lambda d: d))
        return _let(_days(found, days), lambda ds: _let(poorest(ds), lambda poor: F.when(poor["n"] < least, take(found, ds, poor)).otherwise(found)))

    return F.aggregate(F.array_repeat(F.lit(0), rounds), clusters, turn)


def one_step(members: DataFrame, settings: Spatial, step: str) -> DataFrame:
    """request_id, id, day, cluster after one step ("absorbed", "corrected" or "filled") on clusters that are given.

    ``members`` has request_id, id, lat, lng, district, days, day (from 1) and cluster, a
    number that is known within a request; a cluster is in one day. Clusters come in the order of
    their numbers, and one that takes in another's point keeps its own; days outside 1 to ``days`` stay as they are;
    places without coordinates are left out. Rows are dealt by request once; a step is an expression over the sums of a request's clusters, so it runs in the JVM and
    a round costs clusters x days, however many points the clusters have.
    """
    urban = F.count_if(F.col("district").isin(*settings.urban_districts)) * 2 > F.count(F.lit(1))
    sums = (F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lng").alias("lng"), urban.alias("urban"), F.collect_list("id").alias("ids"))
    placed = members.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    dealt = placed.select("request_id", "id", "lat", "lng", "district", "days", F.col("day").cast("int").alias("day"), F.col("cluster").cast("int").alias("cluster")).repartition("request_id")
    each = dealt.groupBy("request_id", "cluster").agg(F.max("days").alias("days"), F.min("day").alias("day"), *sums)
    fields = F.struct("cluster", "day", "n", "lat", "lng", "urban", "ids")
    requests = each.groupBy("request_id").agg(F.coalesce(F.max("days"), F.lit(0)).cast("int").alias("days"), F.sort_array(F.collect_list(fields)).alias("clusters"))
    found, days = F.col("clusters"), F.col("days")
    after = {"absorbed": lambda: _absorbed(found), "corrected": lambda: _corrected(found, days, settings.correction_rounds), "filled": lambda: _filled(found, days, settings.fill_rounds, settings.min_points)}[step]()
    clusters = requests.select("request_id", F.explode(after).alias("c"))
    return clusters.select("request_id", F.explode("c.ids").alias("id"), F.col("c.day").alias("day"), F.col("c.cluster").alias("cluster"))


def spatial_plan(candidates: DataFrame, settings: Spatial, upto: str = "planned") -> DataFrame:
    """request_id, id, day (from 1; null: dropped), cluster_id (within the day; -1: dropped).

    ``candidates`` has request_id, id, rank, lat, lng, district, days, stay_lat, stay_lng; rows
    without coordinates are dropped before.
    """
    spatial = asdict(settings)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"], kind="stable").reset_index(drop=True)
        points, first = rows[["lat", "lng"]].to_numpy(float), rows.iloc[0]
        segments = plan_days(points, rows["district"].to_numpy(), int(first["days"]), np.array([first["stay_lat"], first["stay_lng"]], float), Spatial(**spatial), upto)
        day, cluster = np.full(len(rows), np.nan), np.full(len(rows), -1)
        for d, seg in enumerate(segments):
            for c, members in enumerate(seg):
                day[members], cluster[members] = d + 1, c
        return pd.DataFrame({"request_id": rows["request_id"], "id": rows["id"], "day": pd.array(day, dtype="Float64").astype("Int32"), "cluster_id": cluster.astype("int32")})

    kinds = dict(candidates.dtypes)
    slim = candidates.filter(valid_coordinate(F.col("lat"), F.col("lng"))).select("request_id", "id", "rank", "lat", "lng", "district", "days", "stay_lat", "stay_lng")
    return slim.groupBy("request_id").applyInPandas(work, f"request_id {kinds['request_id']}, id {kinds['id']}, day int, cluster_id int")


def centroids(members: DataFrame, *keys: str) -> DataFrame:
    """Size and mean coordinates of each group."""
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def outermost(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """The places (numbers) that are corners of the smallest convex area on the sphere around all of them; all places, if they are more than 45 degrees from their middle.

    Seen from the centre of the sphere, great circles are straight lines, so the corners are those of a plane hull; within a quarter of the
    sphere the place farthest from any other is one of them.
    """
    la, ln = np.radians(lat), np.radians(lng)
    v = np.column_stack([np.cos(la) * np.cos(ln), np.cos(la) * np.sin(ln), np.sin(la)])
    mid = v.mean(axis=0)
    far = np.linalg.norm(mid)
    up = v @ (mid / far) if far > 1e-6 else np.zeros(len(v))
    if len(v) < 4 or up.min() < 0.71:
        return np.arange(len(v))
    east = np.cross(mid, np.eye(3)[np.abs(mid).argmin()])
    east /= np.linalg.norm(east)
    x, y = v @ east / up, v @ np.cross(mid / far, east) / up
    order = np.lexsort((y, x))
    order = order[np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])]
    corners: set[int] = set()
    for way in (order.tolist(), order[::-1].tolist()):
        chain: list[int] = []
        for i in way:
            while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[i] - y[chain[-2]]) - (y[chain[-1]] - y[chain[-2]]) * (x[i] - x[chain[-2]]) <= 0:
                chain.pop()
            chain.append(i)
        corners.update(chain)
    return np.array(sorted(corners))


def farthest_km(lat: np.ndarray, lng: np.ndarray) -> float:
    """The largest distance of two places, compared corner by corner in blocks."""
    some = outermost(lat, lng)
    la, ln = np.radians(lat[some]), np.radians(lng[some])
    most = 0.0
    for start in range(0, len(some), 512):
        p, q = la[start : start + 512, None], ln[start : start + 512, None]
        h = np.sin((la - p) / 2) ** 2 + np.cos(la) * np.cos(p) * np.sin((ln - q) / 2) ** 2
        most = max(most, float(h.max()))
    return 2 * EARTH_KM * float(np.arcsin(np.sqrt(min(1.0, most))))


def diameters(members: DataFrame, *keys: str) -> DataFrame:
    """The largest distance of two members of each group of two or more; null places don't count.

    Tasks send the corners of what they hold of a group, so a group of any size meets as few places; corners of corners are the group's.
    """
    places = members.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(*keys, "lat", "lng")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema]

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, group in rows.groupby(list(keys), dropna=False, sort=False):
                some = group.iloc[outermost(group["lat"].to_numpy(float), group["lng"].to_numpy(float))]
                yield some.assign(n=[len(group), *[0] * (len(some) - 1)])

    def widest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[list(keys)].head(1).assign(km=farthest_km(rows["lat"].to_numpy(float), rows["lng"].to_numpy(float)), n=rows["n"].sum())

    sent = places.mapInPandas(corners, ", ".join([*kinds, "n long"]))
    return sent.groupBy(*keys).applyInPandas(widest, ", ".join([*kinds[: len(keys)], "km double", "n long"])).filter("n > 1").drop("n")


def urban_majority(members: DataFrame, urban_districts: tuple[str, ...], *keys: str) -> DataFrame:
    """Whether more than half of each group's places lie in urban districts."""
    return members.groupBy(*keys).agg((F.count_if(F.col("district").isin(*urban_districts)) > F.count(F.lit(1)) / 2).alias("urban"))


#: Centres up to which each point is compared with all of them, and the rings of cells that a point's centre is looked for in.
FEW_CENTRES, RINGS = 16, (1, 3)


def _on_sphere(lat: Column, lng: Column) -> list[Column]:
    """Coordinates on the unit sphere; nearest there is nearest on the ground."""
    la, ln = F.radians(lat), F.radians(lng)
    return [F.cos(la) * F.cos(ln), F.cos(la) * F.sin(ln), F.sin(la)]


def nearest_centre(points: DataFrame, centres: DataFrame, centre_key: str = "centre") -> DataFrame:
    """id, centre, km of the nearest of the centres; ties by centre; points and centres without a place don't count.

    Centres are dealt to the cells of a grid about as fine as they are dense. A point meets those of the cells
    around its own, in rings that grow; whatever lies outside a ring is farther than its width, so
    a point whose best is nearer than that is done. The few that aren't, far from every centre, are compared with
    all centres, which go to the tasks in blocks.
    """
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    c = centres.filter(placed).select(F.col(centre_key).alias("centre"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    left = points.filter(placed).select("id", "lat", "lng")
    away = haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    best = lambda pairs: pairs.withColumn("km", away).groupBy("id", "lat", "lng").agg(F.min_by("centre", F.struct("km", "centre")).alias("centre"), F.min("km").alias("km"))
    at = _on_sphere(F.col("_lat"), F.col("_lng"))
    n, *ends = c.agg(F.count(F.lit(1)), *(f(x) for x in at for f in (F.min, F.max))).first()
    done = []
    if n > FEW_CENTRES:
        size = max([1e-9, *(b - a for a, b in zip(ends[::2], ends[1::2]))]) / math.sqrt(n)
        cell = lambda x: F.floor(x / size).cast("long")
        dealt = if_few(c.select("*", F.array(*map(cell, at)).alias("_cell")))
        for ring in RINGS:
            near = F.sequence(F.lit(-ring), F.lit(ring))
            own = left.select("*", *(cell(x).alias(f"_{i}") for i, x in enumerate(_on_sphere(F.col("lat"), F.col("lng")))))
            for axis in ("_0", "_1", "_2"):
                own = own.withColumn("_step", F.explode(near)).withColumn(axis, F.col(axis) + F.col("_step"))
            found = own.select("id", "lat", "lng", F.array("_0", "_1", "_2").alias("_cell")).join(dealt, "_cell")
            sure = written(best(found).filter(F.lit(2.0) * F.sin(F.col("km") / (2 * EARTH_KM)) < ring * size * (1 - 1e-9)))
            done.append(sure)
            left = written(left.join(sure.select("id", "lat", "lng"), ["id", "lat", "lng"], "left_anti"))
            if left.isEmpty():
                break
    found = reduce(DataFrame.unionByName, [*done, best(against(left, c, "centre"))])
    return found.groupBy("id").agg(F.min_by("centre", F.struct("km", "centre")).alias("centre"), F.min("km").alias("km"))
