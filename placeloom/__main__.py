"""python -m placeloom STAGE --city X ...: one stage of a city, or a search in it."""

from __future__ import annotations

import argparse

from placeloom.config import Vocabulary, city_config, load_cities, load_vocabulary
from placeloom.functions.contract import load_contract
from placeloom.operators.evaluate import aggregate
from placeloom.operators.segment import read_dictionary
from placeloom.plans import city as stages
from placeloom.session import session
from placeloom.sources.places import read_eval_set
from placeloom.sources.search_api import offline


def main(words: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="placeloom")
    p.add_argument("stage", choices=("crawl", "clean", "tag", "build", "eval", "search"))
    p.add_argument("--city", required=True)
    p.add_argument("--config", default="config/cities", help="folder of the cities' YAML files")
    p.add_argument("--root", default="data", help="folder of the tables")
    p.add_argument("--force", action="store_true", help="write again what has been written")
    p.add_argument("--places", default="places", help="crawl: folder of the offline provider's JSON files")
    p.add_argument("--cases", help="eval: file of the evaluation set")
    p.add_argument("--query", help="search: what to look for")
    p.add_argument("--top_k", type=int, default=10)
    p.add_argument("--mode", default="hybrid")
    p.add_argument("--whole_words", action="store_true", help="build: index runs of ideographs whole instead of by pairs")
    p.add_argument("--dictionary", help="build: file of words and frequencies by which ideographs are cut")
    p.add_argument("--schema", help="YAML file of the vocabulary, the text template and the field contract")
    a = p.parse_args(words)
    city, spark = city_config(load_cities(a.config), a.city), session()
    known, fields = (load_vocabulary(a.schema), load_contract(a.schema)) if a.schema else (Vocabulary(), ())
    if a.stage == "crawl":
        stages.crawl_city(spark, city, a.root, offline(a.places), a.force)
    elif a.stage == "clean":
        stages.clean_stage(spark, city, a.root, a.force, fields)
    elif a.stage == "tag":
        stages.tag_stage(spark, city, a.root, words=known)
    elif a.stage == "build":
        stages.build_stage(spark, city, a.root, a.force, bigrams=not a.whole_words, lexicon=read_dictionary(spark, a.dictionary) if a.dictionary else None, words=known, fields=fields)
    elif a.stage == "eval":
        aggregate(stages.eval_stage(spark, city, a.root, read_eval_set(spark, a.cases), a.top_k)).show()
    else:
        asked = spark.createDataFrame([(0, a.query)], "query_id long, query string")
        stages.search_city(spark, city, a.root, asked, a.top_k, a.mode).orderBy("rank").show(a.top_k)


if __name__ == "__main__":
    main()
