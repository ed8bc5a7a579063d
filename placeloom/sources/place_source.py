"""Place search as a Python data source, for batch and streaming reads.

A partition is a keyword's range of pages, so that a page that fails for good fails its task, which Spark
runs again, and no other work is lost. Filters on keyword and region are pushed to the source: what they leave out is
never asked for. The streaming reader's offset is a page number: a batch asks for the pages of every
keyword that the settings allow now and no committed batch has asked for, so a query that is restarted with
more pages goes on after the last page it had.

Options: ``provider`` ("module:function") and ``arguments`` (a JSON list) name what makes the provider in a task;
``keywords`` is a JSON list of [ord, keyword, region, page_size, max_pages], of the size of a city's settings;
``tries`` and ``pause_s`` bound the attempts at a page.

Defined cases: no keywords give no rows; a range ends with its first page that is short or empty; a keyword listed twice is asked for twice.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from placeloom.sources.search_api import PAUSE_S, TRIES, Provider, with_retries

SCHEMA = "ord long, keyword string, region string, page int, position int, place string"
#: Pages that one task asks for.
PAGES = 10


def http(endpoint: str, key: str, timeout_s: float = 10.0, **more: str) -> Provider:
    """A search service over HTTP that answers {"status": "1", "pois": [...]}; any other status is an error."""

    def fetch(keyword: str, region: str, page_size: int, page: int) -> list[dict]:
        asked = {"key": key, "keywords": keyword, "region": region, "page_size": page_size, "page_num": page} | more
        with urllib.request.urlopen(f"{endpoint}?{urllib.parse.urlencode(asked)}", timeout=timeout_s) as said:
            answer = json.load(said)
        if answer.get("status") != "1":
            raise ValueError(f"page {page} of {keyword}: status {answer.get('status')}, {answer.get('info')}")
        return answer.get("pois") or []

    return fetch


def folder(at: str) -> Provider:
    """Pages cut from JSON lines in <folder>/keyword=<keyword>/, by their ``ord``; an unknown keyword has none."""
    from pathlib import Path

    def fetch(keyword: str, region: str, page_size: int, page: int) -> list[dict]:
        lines = [json.loads(x) for f in sorted(Path(at, f"keyword={keyword}").glob("*.json")) for x in f.read_text(encoding="utf-8").splitlines()]
        return sorted(lines, key=lambda x: x["ord"])[(page - 1) * page_size : page * page_size]

    return fetch


@dataclass(frozen=True)
class Pages(InputPartition):
    """A keyword's pages from ``first`` to ``last``."""

    ord: int
    keyword: str
    region: str
    page_size: int
    first: int
    last: int


class _Asking:
    """What both readers share: the options, and asking for the pages of a partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.keywords = [tuple(x) for x in json.loads(options.get("keywords", "[]"))]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        module, _, name = self.options["provider"].partition(":")
        make = getattr(importlib.import_module(module), name)
        fetch = with_retries(make(*json.loads(self.options.get("arguments", "[]"))), int(self.options.get("tries", TRIES)), float(self.options.get("pause_s", PAUSE_S)), strict=True)
        for page in range(partition.first, partition.last + 1):
            rows = fetch(partition.keyword, partition.region, partition.page_size, page)
            for i, place in enumerate(rows):
                yield partition.ord, partition.keyword, partition.region, page, i, json.dumps(place, ensure_ascii=False)
            if len(rows) < partition.page_size:
                return


class PageReader(_Asking, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what compares the keyword or the region with values; return the rest."""
        for f in filters:
            at = {("keyword",): 1, ("region",): 2}.get(getattr(f, "attribute", ()))
            if at and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keywords = [k for k in self.keywords if k[at] in wanted]
            else:
                yield f

    def partitions(self) -> Sequence[Pages]:
        return [Pages(o, k, r, size, first, min(first + PAGES - 1, most)) for o, k, r, size, most in self.keywords for first in range(1, most + 1, PAGES)]


class PageStream(_Asking, DataSourceStreamReader):
    """Offsets are {"page": the last page that any keyword may ask for}; the reader itself holds no state."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max((k[4] for k in self.keywords), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[Pages]:
        return [Pages(o, k, r, size, first, min(first + PAGES - 1, most, end["page"])) for o, k, r, size, most in self.keywords for first in range(start["page"] + 1, min(end["page"], most) + 1, PAGES)]

    def commit(self, end: dict) -> None:
        """Nothing is held for a committed page."""


class PlaceSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "place_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def _options(keywords: DataFrame | Sequence[tuple], provider: str, *arguments: object) -> dict[str, str]:
    rows = [tuple(r) for r in (keywords.select("ord", "keyword", "region", "page_size", "max_pages").collect() if isinstance(keywords, DataFrame) else keywords)]
    return {"provider": provider, "arguments": json.dumps(arguments), "keywords": json.dumps(sorted(rows), ensure_ascii=False)}


def read_pages(spark: SparkSession, keywords: DataFrame | Sequence[tuple], provider: str, *arguments: object, **options: object) -> DataFrame:
    """All places of the keywords (ord, keyword, region, page_size, max_pages), as a batch."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaceSearch)
    return spark.read.format("place_search").options(**_options(keywords, provider, *arguments), **options).load()


def stream_pages(spark: SparkSession, keywords: DataFrame | Sequence[tuple], provider: str, *arguments: object, **options: object) -> DataFrame:
    """The same as a stream of pages."""
    spark.dataSource.register(PlaceSearch)
    return spark.readStream.format("place_search").options(**_options(keywords, provider, *arguments), **options).load()
