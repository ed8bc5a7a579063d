"""Anchors of a city (transport hubs and stay districts): lookup, cleaning, partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions.text import parse_location
from placeloom.schema import NO_COORDINATE

HUB, DISTRICT = "transport_hub", "stay_district"


def best_match(found: DataFrame, key: str = "anchor", name: str = "name", order: str = "ord") -> DataFrame:
    """Of the search results of each anchor the one of exactly its name, else the first."""
    first = Window.partitionBy(key).orderBy(F.col(name) != F.col(key), order)
    return found.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def misses(wanted: DataFrame, found: DataFrame, key: str = "anchor") -> DataFrame:
    """Anchors that no search result belongs to."""
    return wanted.join(found, key, "left_anti")


def crawl_anchors(hubs: DataFrame, districts: DataFrame, search_results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found anchors (name, location, type; hubs first) and the misses, from names (anchor) and results (anchor, ord, name, location)."""
    wanted = hubs.select("anchor", F.lit(HUB).alias("type")).unionByName(districts.select("anchor", F.lit(DISTRICT).alias("type")))
    hit = best_match(search_results).select("anchor", "location")
    return wanted.join(hit, "anchor").select(F.col("anchor").alias("name"), "location", "type"), misses(wanted, hit)


def clean_anchors(raw: DataFrame) -> DataFrame:
    """name, lat, lng, type; anchors without readable coordinates are dropped."""
    at = raw.withColumn("_at", parse_location(F.col("location")))
    return at.select("name", "_at.lat", "_at.lng", "type").filter(F.col("lat") != NO_COORDINATE)


def of_type(anchors: DataFrame, kind: str) -> DataFrame:
    return anchors.filter(F.col("type") == kind)


def lookup(anchors: DataFrame, names: DataFrame, order: str = "ord") -> DataFrame:
    """The anchor of each name (``names``: wanted): hubs before districts, then the first."""
    hit = names.join(anchors, F.col("wanted") == F.col("name"))
    first = Window.partitionBy("wanted").orderBy(F.col("type") != HUB, order)
    return hit.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def stay_coordinates(requests: DataFrame, districts: DataFrame) -> DataFrame:
    """``requests`` (stay_district) with stay_lat and stay_lng; (0, 0) and ``stay_found`` false for an unknown district."""
    at = districts.groupBy(F.col("name").alias("stay_district")).agg(F.min_by(F.struct("lat", "lng"), "ord").alias("_at"))
    joined = requests.join(at, "stay_district", "left")
    return joined.select(*requests.columns, F.coalesce("_at.lat", F.lit(0.0)).alias("stay_lat"), F.coalesce("_at.lng", F.lit(0.0)).alias("stay_lng"), F.col("_at").isNotNull().alias("stay_found"))
