"""Cleaning of raw places: dedupe by id, the rule chain, projection, caps and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.config import MAX_POIS, CleanRules
from placeloom.functions.text import contains_any, or_empty, parse_rating, photo_urls

# Reasons of the rule chain; the last three keep a place.
REASONS = ("hard_exclude", "soft_exclude", "brand_store", "sub_facility", "local_exclude", "core_spot", "interest_group", "passed")
KEEPING = REASONS[-3:]


def dedupe_prefer_flagged(df: DataFrame, key: str = "id", flag: str = "interest_group", order: str = "ord") -> DataFrame:
    """The first row of each key, or its first flagged row if there is one; ``position`` is where the key was first seen.

    One aggregation with map-side combining, so a key of very many rows is no burden.
    """
    row = F.struct(*df.columns)
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(F.col(flag).isNull(), F.col(order))).alias("_row"), F.min(order).alias("position"))
    return best.select("_row.*", "position")


def rule_reason(name: Column, kind: Column, interest_group: Column, rules: CleanRules, core: Iterable[str]) -> Column:
    """Which rule decides on a place; the first that applies does."""
    name, kind = or_empty(name), or_empty(kind)
    core = sorted(core)
    reason = F.when(contains_any(name, rules.hard_names) | contains_any(kind, rules.hard_types), "hard_exclude")
    reason = reason.when(name.isin(*core) if core else F.lit(False), "core_spot").when(or_empty(interest_group) != "", "interest_group")
    reason = reason.when(contains_any(kind, rules.soft_types) & ~contains_any(name, rules.exempt_words), "soft_exclude")
    if rules.brand_store:
        reason = reason.when(name.rlike(rules.brand_store), "brand_store")
    reason = reason.when(F.contains(name, F.lit("-")) & contains_any(F.substring_index(name, "-", -1), rules.sub_facility), "sub_facility")
    return reason.when(contains_any(name, rules.local) | contains_any(kind, rules.local), "local_exclude").otherwise("passed")


def apply_rules(df: DataFrame, rules: CleanRules, core: Iterable[str] = (), interest_group: str = "interest_group") -> DataFrame:
    """``df`` (name, type and the flag) with reason and keep."""
    reason = rule_reason(F.col("name"), F.col("type"), F.col(interest_group), rules, core)
    return df.withColumn("reason", reason).withColumn("keep", F.col("reason").isin(*KEEPING))


def reason_histogram(judged: DataFrame) -> DataFrame:
    """How many places each rule rejected, most first."""
    return judged.filter(~F.col("keep")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def project_clean(raw: DataFrame, source: str = "amap") -> DataFrame:
    """Raw places in the shape of CLEAN_POI; ``ord`` and the flag stay if they are there."""
    text = lambda c: or_empty(F.col(c))
    rest = [c for c in ("ord", "interest_group") if c in raw.columns]
    return raw.select(
        *rest, text("id").alias("id"), text("name").alias("name"), text("_city").alias("city"), text("adname").alias("district"), text("address").alias("address"), text("location").alias("location"), text("type").alias("type"),
        parse_rating(F.col("business.rating")).alias("rating"), text("business.opentime_today").alias("opentime"), text("business.keytag").alias("poi_level"),
        photo_urls(F.col("photos")).alias("photos"), F.lit(source).alias("source"), text("_crawled_at").alias("crawled_at"),
    )


def cap_by_rating(df: DataFrame, n: int = MAX_POIS, order: str = "ord") -> DataFrame:
    """The n places rated best, ties in their order."""
    return df.orderBy(F.desc("rating"), order).limit(n)


def type_prefixes(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent first segments of types; an empty one counts as 未知."""
    prefix = F.get(F.split(or_empty(F.col("type")), ";"), F.lit(0))
    prefix = F.when(prefix == "", "未知").otherwise(prefix)
    return df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(n)


def clean_city(raw: DataFrame, rules: CleanRules, core: Iterable[str] = (), max_pois: int = MAX_POIS) -> DataFrame:
    """Raw places of a city (RAW_POI with ``ord`` for their order) to clean ones: dedupe, rules, projection, districts, cap."""
    raw = raw.withColumn("interest_group", F.col("_interest_group"))
    kept = apply_rules(dedupe_prefer_flagged(raw), rules, core).filter("keep").drop("ord").withColumnRenamed("position", "ord")
    return cap_by_rating(project_clean(kept).filter("district <> ''"), max_pois)
