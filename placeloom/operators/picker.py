"""Picking a day's stops: seeded weighted sampling without replacement, with a penalty on nearness, then a greedy route.

Days are independent groups of bounded size; Spark deals them out and numpy works on each. Two
sources of randomness: ``python`` draws from one seeded stream per day, ``md5`` derives each number
from a digest of its place in the draw, so that any engine can repeat it.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.config import CROWD_WEIGHTS, DEFAULT_STYLE, LOCKING_STYLE, STYLES, Style
from placeloom.functions import scores
from placeloom.functions.text import contains_any
from placeloom.operators.spatial import km


def md5_uniform(key: str) -> float:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0


def score_terms(candidates: DataFrame, core: Iterable[str], crowd: Mapping[str, Mapping[str, float]] = CROWD_WEIGHTS) -> DataFrame:
    """``candidates`` (name, rating, tags, interests, behaviors, companion, level) with the terms of a base score, as columns t_*."""
    core = tuple(sorted(core))
    return candidates.withColumns({
        "t_rating": scores.rating_norm(F.col("rating")), "t_interest": scores.interest_match(F.col("tags"), F.col("interests")),
        "t_behavior": scores.behavior_norm(F.col("behaviors"), F.col("companion"), crowd), "t_level": scores.level_norm(F.col("level")), "t_core": contains_any(F.col("name"), core),
    })


def route(points: np.ndarray, start: np.ndarray) -> list[int]:
    """Greedy nearest-neighbour order; the first of equals."""
    left, found, at = list(range(len(points))), [], start
    while left:
        i = left.pop(int(km(at, points[left]).argmin()))
        found.append(i)
        at = points[i]
    return found


def distance_factor(away: np.ndarray, core: np.ndarray) -> np.ndarray:
    plain = np.select([away < 0.5, away < 1.5, away < 2.0], [0.1, 0.6, 0.8], 1.0)
    return np.where(core, 1 - (1 - plain) / 2, plain)


def _draw(weights: np.ndarray, u: float) -> int:
    """The first index whose running weight reaches u of the sum; uniform without any weight."""
    total = np.cumsum(weights)
    if total[-1] <= 0:
        return min(int(u * len(weights)), len(weights) - 1)
    return min(int(np.searchsorted(total, u * total[-1])), len(weights) - 1)


class _Numbers:
    """The random numbers of one day."""

    def __init__(self, kind: str, seed, style: str, day: int):
        self.key = f"{seed}|{style}|{day}"
        self.stream = random.Random(self.key) if kind == "python" else None

    def of_candidate(self, id_) -> float:
        return self.stream.random() if self.stream else md5_uniform(f"{self.key}|c|{id_}")

    def of_round(self, i: int) -> float:
        return self.stream.random() if self.stream else md5_uniform(f"{self.key}|r|{i}")

    def choice(self, i: int, among: list[int]) -> int:
        return self.stream.choice(among) if self.stream else among[int(md5_uniform(f"{self.key}|x|{i}") * len(among))]


class Trace:
    """What picking saw in one day: base scores, the round that picked each row (0: before any, nan: none), each round's weights (nan: taken)."""

    def __init__(self, n: int):
        self.base, self.picked_in = np.full(n, np.nan), np.zeros(n)
        self.weights: list[np.ndarray] = []


def pick_rows(rows: pd.DataFrame, style: Style, locks: bool, numbers: _Numbers, trace: Trace | None = None) -> list[tuple[int, float]]:
    """Row numbers of the stops in route order, with their base scores (nan if all rows are taken); a ``trace`` gets all base scores and each round."""
    points = rows[["lat", "lng"]].to_numpy(float)
    start = rows[["start_lat", "start_lng"]].to_numpy(float)[0]
    if len(rows) <= style.target:
        return [(i, float("nan")) for i in route(points, start)]
    draws = np.array([numbers.of_candidate(x) for x in rows["id"]])
    core = rows["t_core"].to_numpy(bool)
    base = style.rating * rows["t_rating"].to_numpy() + style.interest * rows["t_interest"].to_numpy() + style.random * draws + style.core * core + style.behavior * rows["t_behavior"].to_numpy() + style.level * rows["t_level"].to_numpy()
    if trace:
        trace.base[:] = base
        trace.picked_in[:] = np.nan
    picked: list[int] = []
    if locks:
        five = np.flatnonzero((rows["level"] == "5A").to_numpy())
        if len(five) > style.target:
            five = five[np.argsort(-rows["t_rating"].to_numpy()[five], kind="stable")][: style.target]
        picked = five.tolist()
    if trace:
        trace.picked_in[picked] = 0
    nearest = km(points[:, None], points[None, picked]).min(1) if picked else np.full(len(rows), np.inf)
    for i in range(style.target - len(picked)):
        weights = base * distance_factor(nearest, core)
        weights[picked] = 0.0
        chosen = _draw(weights, numbers.of_round(i))
        if chosen in picked:
            chosen = numbers.choice(i, [j for j in range(len(rows)) if j not in picked])
        if trace:
            weights[picked] = np.nan
            trace.weights.append(weights)
            trace.picked_in[chosen] = i + 1
        picked.append(chosen)
        nearest = np.minimum(nearest, km(points, points[chosen]))
    return [(picked[j], float(base[picked[j]])) for j in route(points[picked], start)]


_OF_A_DAY = ("request_id", "day", "rank", "id", "lat", "lng", "style", "level", "start_lat", "start_lng", "t_rating", "t_interest", "t_behavior", "t_level", "t_core")


def _by_day(scored: DataFrame, schema: str, shape: Callable[[pd.DataFrame, list[tuple[int, float]], Trace], pd.DataFrame], seed, rng: str, styles: Mapping[str, Style], default: str, locking: str) -> DataFrame:
    """Each day's stops as ``shape`` makes a table of them. An unknown style counts as the default one."""
    table = {k: asdict(v) for k, v in styles.items()}

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"], kind="stable").reset_index(drop=True)
        first, trace = rows.iloc[0], Trace(len(rows))
        style = first["style"] if first["style"] in table else default
        chosen = pick_rows(rows, Style(**table[style]), style == locking, _Numbers(rng, seed, style, int(first["day"]) - 1), trace)
        return shape(rows, chosen, trace)

    kinds = dict(scored.dtypes)
    return scored.select(*_OF_A_DAY).groupBy("request_id", "day").applyInPandas(work, schema.format(**kinds))


def pick_days(scored: DataFrame, seed: int | None = 42, rng: str = "python", styles: Mapping[str, Style] = STYLES, default: str = DEFAULT_STYLE, locking: str = LOCKING_STYLE) -> DataFrame:
    """request_id, day, stop (from 1), id, base of the stops of each request and day.

    ``scored`` has request_id, day, rank, id, lat, lng, style, level, start_lat, start_lng and the
    terms of ``score_terms``.
    """

    def stops(rows: pd.DataFrame, chosen: list[tuple[int, float]], trace: Trace) -> pd.DataFrame:
        at = [i for i, _ in chosen]
        return pd.DataFrame({"request_id": rows["request_id"][at].to_numpy(), "day": rows["day"][at].to_numpy(), "stop": np.arange(1, len(at) + 1, dtype="int32"), "id": rows["id"][at].to_numpy(), "base": [b for _, b in chosen]})

    return _by_day(scored, "request_id {request_id}, day int, stop int, id {id}, base double", stops, seed, rng, styles, default, locking)


def pick_traces(scored: DataFrame, seed: int | None = 42, rng: str = "python", styles: Mapping[str, Style] = STYLES, default: str = DEFAULT_STYLE, locking: str = LOCKING_STYLE) -> DataFrame:
    """request_id, day, rank, id, base, picked_in, weights of every candidate, from the same draws as ``pick_days``.

    picked_in is the round that took it (0: locked, or the day takes all; null: not taken); weights
    has its weight in each round, null once it is taken. A day that takes all has no base and no rounds.
    """

    def candidates(rows: pd.DataFrame, chosen: list[tuple[int, float]], trace: Trace) -> pd.DataFrame:
        known = lambda x: None if np.isnan(x) else float(x)
        weights = [[known(w[i]) for w in trace.weights] for i in range(len(rows))]
        return pd.DataFrame({"request_id": rows["request_id"], "day": rows["day"], "rank": rows["rank"], "id": rows["id"], "base": pd.array(trace.base, dtype="Float64"), "picked_in": pd.array(trace.picked_in, dtype="Float64").astype("Int32"), "weights": weights})

    return _by_day(scored, "request_id {request_id}, day int, rank {rank}, id {id}, base double, picked_in int, weights array<double>", candidates, seed, rng, styles, default, locking)


def heaviest(traces: DataFrame, k: int = 5) -> DataFrame:
    """request_id, day, round, place (from 1), id, weight, picked: the k heaviest candidates of each round; ties by rank."""
    each = traces.select("request_id", "day", "rank", "id", "picked_in", F.posexplode("weights").alias("i", "weight")).filter("weight IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("request_id", "day", "i").orderBy(F.desc(F.round("weight", 9)), "rank"))
    top = each.withColumn("place", place).filter(F.col("place") <= k)
    return top.select("request_id", "day", (F.col("i") + 1).alias("round"), "place", "id", "weight", F.coalesce(F.col("picked_in") == F.col("i") + 1, F.lit(False)).alias("picked"))


def compare_styles(scored: DataFrame, seed: int | None = 42, rng: str = "python", styles: Mapping[str, Style] = STYLES, **options) -> DataFrame:
    """The stops of each request and day under every style."""
    found = [pick_days(scored.withColumn("style", F.lit(s)), seed, rng, styles, **options).withColumn("style", F.lit(s)) for s in styles]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def routes(stops: DataFrame) -> DataFrame:
    """request_id, stop, id: the greedy order of the places of each request (rank breaks ties), from its start."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"], kind="stable").reset_index(drop=True)
        order = route(rows[["lat", "lng"]].to_numpy(float), rows[["start_lat", "start_lng"]].to_numpy(float)[0])
        return pd.DataFrame({"request_id": rows["request_id"][order].to_numpy(), "stop": np.arange(1, len(order) + 1, dtype="int32"), "id": rows["id"][order].to_numpy()})

    kinds = dict(stops.dtypes)
    return stops.select("request_id", "rank", "id", "lat", "lng", "start_lat", "start_lng").groupBy("request_id").applyInPandas(work, f"request_id {kinds['request_id']}, stop int, id {kinds['id']}")


def lock_must_haves(scored: DataFrame, target: int) -> DataFrame:
    """Per request the 5A places that are taken in any case: all, or the best rated ones if they exceed the target."""
    best = Window.partitionBy("request_id").orderBy(F.desc("t_rating"), "rank")
    return scored.filter(F.col("level") == "5A").withColumn("lock", F.row_number().over(best)).filter(F.col("lock") <= target)


def weighted_draw(candidates: DataFrame, key: str = "request_id", order: str = "rank", seed: str = "draw") -> DataFrame:
    """One row of each group by its weight: the first, in order, whose running weight reaches an md5-uniform share of the sum."""
    running = F.sum("weight").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy(key))
    drawn = candidates.withColumns({"_run": running, "_goal": scores.md5_uniform(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))) * total})
    return drawn.filter(F.col("_run") >= F.col("_goal")).groupBy(key).agg(F.min_by("id", order).alias("id"))
