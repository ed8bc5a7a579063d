"""Tagging of clean places by a model, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions.text import parse_tag_json, tag_prompt, tag_system_prompt
from placeloom.operators.providers import Answer, answered, offline_tagger


def pending(pois: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Places that haven't been tagged yet."""
    return pois.join(done.select(key).distinct(), key, "left_anti")


def tag(pois: DataFrame, answer: Answer = offline_tagger, system: str | None = None) -> DataFrame:
    """``pois`` with is_attraction, tags, behaviors, description; what can't be parsed counts as an attraction without tags.

    The model gets the system prompt, an empty line and the place.
    """
    first = F.lit(tag_system_prompt() if system is None else system)
    asked = pois.withColumn("_prompt", F.concat(first, F.lit("\n\n"), tag_prompt(F.col("name"), F.col("type"), F.col("address"), F.col("rating"), F.col("poi_level"))))
    said = answered(asked, "_prompt", answer, "_answer").withColumn("_tag", parse_tag_json(F.col("_answer")))
    return said.select(*pois.columns, "_tag.*")


def outcomes(tagged: DataFrame, total: DataFrame) -> DataFrame:
    """One row: how many were tagged, failed (no tags though an attraction), aren't attractions, and were left out."""
    plain = (F.col("tags") == "") & (F.col("behaviors") == "") & (F.col("description") == "")
    counts = tagged.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("is_attraction") & ~plain).alias("success"), F.count_if(F.col("is_attraction") & plain).alias("fail"), F.count_if(~F.col("is_attraction")).alias("not_attraction"))
    return counts.join(total.agg(F.count(F.lit(1)).alias("total"))).select("success", "fail", "not_attraction", (F.col("total") - F.col("processed")).alias("skipped"))
