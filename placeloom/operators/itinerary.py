"""Texts of planned days: prompts, a writing model, and checks of what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions.text import STYLE_NOTES, day_prompt, day_system_prompt, mentioned
from placeloom.operators import patterns
from placeloom.operators.providers import Answer, answered, offline_writer


def day_prompts(stops: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, day, system, prompt from stops (request_id, day, stop, display_name, name, aliases, tags, description) and requests.

    ``system`` follows the request's style, if it has one.
    """
    line = F.struct("stop", F.struct("display_name", "name", "aliases", "tags", "description").alias("p"))
    days = stops.groupBy("request_id", "day").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["p"]).alias("pois"))
    named = days.withColumn("day_name", F.concat(F.lit("Day"), F.col("day").cast("string"))).join(requests, "request_id")
    prompt = day_prompt(F.col("city"), F.col("interests"), F.col("companion"), F.col("days"), F.col("stay_district"), F.col("day_name"), F.col("pois"))
    notes = F.create_map(*(F.lit(x) for s in STYLE_NOTES for x in (s, day_system_prompt(s))))
    style = F.coalesce(F.try_element_at(notes, F.col("style")), F.lit(day_system_prompt(None))) if "style" in requests.columns else F.lit(day_system_prompt(None))
    return named.select("request_id", "day", "day_name", "pois", style.alias("system"), prompt.alias("prompt"))


def write_days(prompts: DataFrame, answer: Answer = offline_writer) -> DataFrame:
    """The day's text and warnings: a model's failure becomes the text, with a warning, and never stops the others."""
    asked = prompts.withColumn("_asked", F.concat("system", F.lit("\n\n"), "prompt"))
    said = answered(asked, "_asked", answer, "text", on_error=lambda e: f"[failed] {e}")
    failed = F.when(F.col("text").startswith("[failed] "), F.array(F.lit("the model failed"))).otherwise(F.array().cast("array<string>"))
    return said.withColumn("warnings", failed).drop("_asked")


def missing_mentions(days: DataFrame) -> DataFrame:
    """request_id, day, name of the stops that a day's text doesn't name."""
    each = days.select("request_id", "day", "text", F.explode("pois").alias("p"))
    return each.filter(~mentioned(F.col("p.name"), F.col("text"))).select("request_id", "day", F.col("p.name").alias("name"))


#: Characters of a piece of text whose substrings are listed at once.
PIECE = 256


def contained(texts: DataFrame, names: DataFrame, *keys: str, shards: int = patterns.SHARDS) -> DataFrame:
    """keys, name: the names that each text contains.

    Each text is scanned once by an automaton of the names, which are counted; only what is found is
    shuffled. Beyond ``shards`` automata (of 2 million characters each) texts list their
    substrings instead, of the lengths that names have, and meet the names in an equi-join.
    """
    known = names.select("name").filter("name <> ''").distinct()
    parts = patterns.shards(known, shards)
    if parts is not None:
        return patterns.contained(texts.filter("text <> ''"), parts, *keys).distinct()
    return _by_substrings(texts, known, *keys)


def _by_substrings(texts: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """The same by an equi-join of substrings; a text is cut into pieces that overlap by the longest name, so no row holds a long one's substrings."""
    lengths = F.broadcast(known.agg(F.collect_set(F.length("name")).alias("_lengths"), F.max(F.length("name")).alias("_most")))  # as many numbers as lengths exist
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(PIECE))
    pieces = texts.filter("text <> ''").join(lengths).select(*keys, "_lengths", F.explode(F.transform(starts, lambda i: F.substr("text", i, F.col("_most") + (PIECE - 1)))).alias("_piece"))
    cut = F.flatten(F.transform("_lengths", lambda n: F.when(n <= F.length("_piece"), F.transform(F.sequence(F.lit(1), F.length("_piece") - n + 1), lambda i: F.substr("_piece", i, n))).otherwise(F.array().cast("array<string>"))))
    return pieces.select(*keys, F.explode(F.array_distinct(cut)).alias("name")).join(known, "name").select(*keys, "name").distinct()


def out_of_scope(texts: DataFrame, names: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    """key, name: known names that a text contains but that aren't among its allowed ones (key, name)."""
    return contained(texts, names, key).join(allowed, [key, "name"], "left_anti").select(key, "name")


def mentions(texts: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """keys, name: the names that each text mentions, in full or by their first three characters."""
    known = names.select("name").filter("name <> ''").distinct().select("name", F.substring("name", 1, 3).alias("_start"))
    hits = contained(texts, known.select(F.col("_start").alias("name")), *keys).withColumnRenamed("name", "_start")
    return hits.join(known, "_start").select(*keys, "name")


def photo_cards(pois: DataFrame, n: int = 6) -> DataFrame:
    """The first photo of each place that has one, at most n a day, escaped for HTML."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    with_photo = pois.filter(F.size("photos") > 0)
    card = F.row_number().over(Window.partitionBy("request_id", "day").orderBy("stop"))
    return with_photo.withColumn("card", card).filter(F.col("card") <= n).select("request_id", "day", "card", escape(F.col("name")).alias("name"), escape(F.get("photos", F.lit(0))).alias("photo"))
