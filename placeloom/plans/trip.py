"""The whole way from requests to written days, many requests in one job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.config import CROWD_WEIGHTS, DEFAULT_STYLE, LOCKING_STYLE, STYLES, Spatial, Style
from placeloom.functions.scores import recall_count
from placeloom.functions.text import first_nonempty, or_empty, query_text
from placeloom.operators.anchors import stay_coordinates
from placeloom.operators.index import Bm25Index
from placeloom.operators.itinerary import day_prompts, write_days
from placeloom.operators.picker import pick_days, score_terms
from placeloom.operators.providers import Answer, offline_writer
from placeloom.operators.retrieve import search
from placeloom.operators.spatial import spatial_plan


def recalled(requests: DataFrame, kb: DataFrame, vectors: DataFrame, index: Bm25Index | None, most: int = 120) -> DataFrame:
    """request_id, id, score, rank: as many places as each request's days ask for.

    ``requests`` carries the vector of its query; ``kb`` has id and city.
    """
    asked = requests.select(F.col("request_id").alias("query_id"), query_text(F.col("interests"), F.col("city")).alias("query"), "city", "vector")
    found = search(asked, most, "hybrid", vectors, index, kb.select("id", "city"))
    wanted = requests.select(F.col("request_id").alias("query_id"), recall_count(F.col("days")).alias("n"))
    return found.join(wanted, "query_id").filter(F.col("rank") <= F.col("n")).select(F.col("query_id").alias("request_id"), "id", "score", "rank")


def plan_places(planned: DataFrame, docs: DataFrame) -> DataFrame:
    """What a plan has of its places: ``planned`` (request_id, day, id, cluster_id) with the fields of ``docs``."""
    joined = lambda c: or_empty(F.array_join(c, ",")).alias(c)
    none = F.array().cast("array<string>")
    fields = docs.select(
        "id", "name", first_nonempty(F.col("display_name"), F.col("name")).alias("display_name"), joined("tags"), joined("behaviors"), or_empty(F.col("level")).alias("level"),
        F.coalesce("aliases", none).alias("aliases"), F.coalesce("photos", none).alias("photos"), or_empty(F.col("description")).alias("description"), "lat", "lng", "rating", or_empty(F.col("district")).alias("district"),
    )
    return planned.select("request_id", "day", "id", "cluster_id").join(fields, "id").withColumnRenamed("id", "poi_id")


def plan_trips(
    requests: DataFrame, kb: DataFrame, vectors: DataFrame, index: Bm25Index | None, districts: DataFrame, spatial: Spatial, core: Iterable[str] = (), seed: int = 42, rng: str = "python",
    styles: Mapping[str, Style] = STYLES, default: str = DEFAULT_STYLE, locking: str = LOCKING_STYLE, crowd: Mapping[str, Mapping[str, float]] = CROWD_WEIGHTS,
) -> DataFrame:
    """request_id, day, stop, id: recall, split into days, pick and order the stops of each."""
    placed = stay_coordinates(requests.drop("vector"), districts)
    found = recalled(requests, kb, vectors, index).join(kb.drop("city"), "id").join(placed, "request_id")
    days = spatial_plan(found, spatial).filter("day IS NOT NULL")
    pool = days.join(found, ["request_id", "id"]).withColumns({"start_lat": F.col("stay_lat"), "start_lng": F.col("stay_lng")})
    return pick_days(score_terms(pool, core, crowd), seed, rng, styles, default, locking).drop("base")


def write_trips(stops: DataFrame, kb: DataFrame, requests: DataFrame, answer: Answer = offline_writer) -> DataFrame:
    """request_id and its days, each with its text, stops and warnings, in order."""
    rich = stops.join(kb.select("id", "display_name", "name", "aliases", F.array_join("tags", ",").alias("tags"), "description"), "id")
    days = write_days(day_prompts(rich, requests), answer)
    return days.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("day", "text", "pois", "warnings"))).alias("days"))
