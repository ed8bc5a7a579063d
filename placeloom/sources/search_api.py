"""Place search behind a pluggable provider; tasks fetch the pages of keywords, a bounded number at a time.

A provider is a function (keyword, region, page_size, page) -> list of places (dicts as in RAW_POI).
The offline default reads a JSON file per keyword.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import City

Provider = Callable[[str, str, int, int], list[dict]]
TRIES, PAUSE_S = 3, 2.0
MISS = "_missed"


def offline(folder: str) -> Provider:
    """Pages cut from <folder>/<keyword>.json; an unknown keyword has none."""

    def fetch(keyword: str, region: str, page_size: int, page: int) -> list[dict]:
        at = Path(folder) / f"{keyword}.json"
        rows = json.loads(at.read_text(encoding="utf-8")) if at.exists() else []
        return rows[(page - 1) * page_size : page * page_size]

    return fetch


def with_retries(fetch: Provider, tries: int = TRIES, pause_s: float = PAUSE_S, sleep=time.sleep, strict: bool = False) -> Provider:
    """Exceptions are tried again after a pause that grows with each attempt; after the last one there is nothing, or it is raised if ``strict``."""

    def tried(keyword: str, region: str, page_size: int, page: int) -> list[dict]:
        for attempt in range(1, tries + 1):
            try:
                return fetch(keyword, region, page_size, page)
            except Exception:  # noqa: BLE001  whatever a remote service raises
                if attempt < tries:
                    sleep(pause_s * attempt)
                elif strict:
                    raise
        return []

    return tried


def fetch_pages(fetch: Provider, keyword: str, region: str, page_size: int, max_pages: int) -> Iterator[tuple[int, dict]]:
    """(page, place) until a page is empty or short; a page that fails for good is a place {MISS: reason} and counts as empty."""
    for page in range(1, max_pages + 1):
        try:
            rows = fetch(keyword, region, page_size, page)
        except Exception as e:  # noqa: BLE001  whatever a remote service raises
            yield page, {MISS: f"page {page}: {e}"}
            return
        for row in rows:
            yield page, row
        if len(rows) < page_size:
            return


def keyword_table(spark: SparkSession, city: City) -> DataFrame:
    """ord, keyword, interest_group, page_size, max_pages: core words by interest, then category words without."""
    rows = [(w, g, *city.core_pages) for g, words in city.core_spots.items() for w in words] + [(w, None, *city.category_pages) for w in city.category_words]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, keyword string, interest_group string, page_size int, max_pages int")


def crawl(spark: SparkSession, city: City, provider: Provider, parallel: int = 4) -> DataFrame:
    """ord, place (JSON) and stamps for all keywords of a city; ``parallel`` bounds the requests at a time.

    A keyword whose page failed for good has a row without a place, with the reason in _missed.
    """
    region, stamp = city.region, datetime.now(timezone.utc).isoformat(timespec="seconds")
    safe = with_retries(provider, strict=True)

    def work(batches):
        import pandas as pd

        for rows in batches:
            found = [(o * 1_000_000 + i, None if MISS in place else json.dumps(place, ensure_ascii=False), k, g, place.get(MISS)) for o, k, g, n, m in zip(rows["ord"], rows["keyword"], rows["interest_group"], rows["page_size"], rows["max_pages"]) for i, (_, place) in enumerate(fetch_pages(safe, k, region, int(n), int(m)))]
            yield pd.DataFrame(found, columns=["ord", "place", "_source_keyword", "_interest_group", MISS]).astype({"ord": "int64"})

    pages = keyword_table(spark, city).repartition(parallel, "ord").mapInPandas(work, "ord long, place string, _source_keyword string, _interest_group string, _missed string")
    return pages.select("*", F.lit(region).alias("_city"), F.lit(stamp).alias("_crawled_at"))


def two_sources(core: DataFrame, category: DataFrame) -> DataFrame:
    """Places found by core words (flagged with their interest) and by category words (no flag)."""
    return core.unionByName(category.withColumn("interest_group", F.lit(None).cast("string")))


def api_key(name: str, environment: dict[str, str]) -> str:
    """A provider's key; an error that names the missing variable."""
    if not environment.get(name):
        raise ValueError(f"set {name}")
    return environment[name]


def as_places(crawled: DataFrame, fields: Sequence[str], schema: str) -> DataFrame:
    """The JSON texts of ``crawl`` as columns of a schema."""
    return crawled.select("ord", F.from_json("place", schema).alias("p"), "_city", "_interest_group", "_source_keyword", "_crawled_at").select("ord", *(f"p.{f}" for f in fields), "_city", "_interest_group", "_source_keyword", "_crawled_at")
