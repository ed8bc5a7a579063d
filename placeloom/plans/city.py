"""The stages of a city, from search to evaluation; each reads the table of the one before and is skipped once written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import City, Vocabulary
from placeloom.functions import contract
from placeloom.functions.text import query_text, split_tags, tag_system_prompt
from placeloom.operators import anchors, clean, evaluate, group, index, retrieve, tag
from placeloom.operators.providers import Answer, Embed, embedded, offline_tagger
from placeloom.schema import CLEAN_ANCHOR, RAW_POI, TAGGED_POI
from placeloom.session import logger
from placeloom.sources import places
from placeloom.sources.search_api import Provider, as_places, crawl

_OWN = ("_city", "_interest_group", "_source_keyword", "_crawled_at")


def crawl_city(spark: SparkSession, city: City, root: str, provider: Provider, force: bool = False) -> bool:
    """Raw places by core and category words. The pages are written first, with what could not be fetched, which is logged."""
    if not force and places.exists(spark, city.paths(root)["raw"]):
        return False
    from pyspark.sql import types as T

    fields = [f for f in T._parse_datatype_string(RAW_POI).fields if f.name not in _OWN]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    at = f"{city.paths(root)['raw']}_pages"
    crawl(spark, city, provider).write.mode("overwrite").parquet(at)
    pages = spark.read.parquet(at)
    if missed := pages.filter("_missed IS NOT NULL").count():
        logger("crawl").warning("%d keywords of %s could not be fetched to their end; see _missed in %s", missed, city.key, at)
    found = as_places(pages.filter("_missed IS NULL"), [f.name for f in fields], schema)
    return places.write_rows(found, city.paths(root)["raw"], force)


def clean_stage(spark: SparkSession, city: City, root: str, force: bool = False, fields: Sequence[contract.Field] = ()) -> bool:
    """Clean places; with a contract, rows that break it are written with their reasons to <clean>_rejected instead, and counted in the log."""
    raw = spark.read.parquet(city.paths(root)["raw"])
    done = clean.clean_city(raw, city.rules, city.core_flat, city.max_pois).drop("interest_group")
    at = city.paths(root)["clean"]
    if not fields:
        return places.write_rows(done, at, force)
    if not force and places.exists(spark, at):
        return False
    judged = f"{at}_judged"
    contract.judged(done, fields, "clean").write.mode("overwrite").parquet(judged)
    rows = spark.read.parquet(judged)
    rejected = rows.filter(F.size(contract.REASONS) > 0)
    rejected.write.mode("overwrite").parquet(f"{at}_rejected")
    for r in contract.reason_counts(rejected).orderBy("reason").collect():  # as many rows as reasons exist
        logger("clean").warning("%s: %d rows of %s rejected", r.reason, r.n, city.key)
    return places.write_rows(rows.filter(F.size(contract.REASONS) == 0).drop(contract.REASONS), at, force)


def anchor_stage(spark: SparkSession, city: City, root: str, found: DataFrame, force: bool = False) -> bool:
    """Clean anchors from search results (anchor, ord, name, location) for the city's hubs and districts."""
    named = lambda words: spark.createDataFrame([(w,) for w in words], "anchor string")
    hits, _ = anchors.crawl_anchors(named(city.transport_hubs), named(city.stay_districts), found)
    return places.write_rows(anchors.clean_anchors(hits), city.paths(root)["anchors"], force)


def tag_stage(spark: SparkSession, city: City, root: str, answer: Answer = offline_tagger, words: Vocabulary = Vocabulary()) -> None:
    """Tag what has no tags yet, with the vocabulary's words, and append it."""
    at = city.paths(root)["tagged"]
    spark.createDataFrame([], TAGGED_POI).write.mode("append").parquet(at)
    done = spark.read.schema(TAGGED_POI).parquet(at)
    tag.tag(tag.pending(spark.read.parquet(city.paths(root)["clean"]), done), answer, tag_system_prompt(words.interests, words.behaviors)).select(done.columns).write.mode("append").parquet(at)


def build_stage(spark: SparkSession, city: City, root: str, force: bool = False, embed: Embed | None = None, bigrams: bool = True, lexicon: DataFrame | None = None, words: Vocabulary = Vocabulary(), fields: Sequence[contract.Field] = ()) -> bool:
    """The knowledge base with texts (by the vocabulary's template) and embeddings, and the inverted index over it.

    Ideographs are indexed by the words of a ``lexicon`` (word, freq) if there is one, else by pairs unless ``bigrams`` is off.
    The template is held against the contract, if there is one.

    Places keep the order of the clean table (by rating, then as they were found), which decides
    who stands for a group among equals.
    """
    tagged = group.attractions(spark.read.schema(TAGGED_POI).parquet(city.paths(root)["tagged"]))
    rows = tagged.join(spark.read.parquet(city.paths(root)["clean"]).select("id", "ord"), "id")
    if fields:
        contract.check_template(words.template, fields)
    docs = index.build_documents(group.merge_groups(rows, group.canonical_map(rows, city.groups)), words.template)
    if not places.write_rows(embedded(docs, embed=embed), city.paths(root)["kb"], force):
        return False
    index.write_bm25_index(spark.read.parquet(city.paths(root)["kb"]), city.paths(root)["index"], bigrams=bigrams and lexicon is None, lexicon=lexicon)
    return True


def search_city(spark: SparkSession, city: City, root: str, queries: DataFrame, k: int, mode: str = "hybrid", embed: Embed | None = None) -> DataFrame:
    """query_id, id, score, rank for ``queries`` (query_id, query) over a built city."""
    kb = spark.read.parquet(city.paths(root)["kb"])
    asked = embedded(queries.withColumn("city", F.lit(city.region)), "query", embed, "vector")
    made = index.Bm25Index.read(spark, city.paths(root)["index"]) if places.exists(spark, f"{city.paths(root)['index']}/postings") else None
    return retrieve.search(asked, k, mode, kb.select("id", "city", "embedding"), made, kb.select("id", "city"))


def eval_stage(spark: SparkSession, city: City, root: str, cases: DataFrame, top_k: int = 10, embed: Embed | None = None) -> DataFrame:
    """The cases (``read_eval_set``) with their results and measures; the report is written too."""
    asked = cases.select(F.col("id").alias("query_id"), F.coalesce(F.when(F.col("profile").isNotNull(), query_text(F.coalesce("profile.interests", split_tags(F.lit(""))), F.lit(city.name))), "query").alias("query"))
    names = spark.read.parquet(city.paths(root)["kb"]).select("id", "name")
    top = search_city(spark, city, root, asked, top_k, embed=embed).join(names, "id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("top_names"))
    none = F.array().cast("array<string>")
    listed = cases.join(top, F.col("id") == F.col("query_id"), "left").select(F.col("id").alias("case_id"), F.coalesce("top_names", none).alias("top_names"), F.coalesce("expected_names", none).alias("expected"), F.coalesce("must_not_include", none).alias("must_not"), "type", "difficulty")
    results = evaluate.evaluate_cases(listed)
    places.write_rows(evaluate.report(results, top_k), city.paths(root)["report"], force=True, kind="json")
    return results


def load_anchors(spark: SparkSession, city: City, root: str) -> DataFrame:
    """The clean anchors; an empty table if there are none."""
    at = city.paths(root)["anchors"]
    return spark.read.parquet(at) if places.exists(spark, at) else spark.createDataFrame([], CLEAN_ANCHOR)
