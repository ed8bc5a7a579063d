"""Views that give the driver's tables the shape of places, requests and candidates.

The texts run in Spark SQL and in DuckDB alike; the queries read them through Spark, the oracles
inline them.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import STYLES, CleanRules, Groups, Spatial
from placeloom.functions.scores import recall_count
from placeloom.operators.draws import drawn

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations".split()

POI = """SELECT p_partkey AS ord, p_partkey AS id,
  p_name || CASE WHEN p_partkey % 5 = 0 THEN '-' || lower(p_type) WHEN p_partkey % 11 = 0 THEN '(' || p_brand || ' shop)' ELSE '' END AS name,
  p_type || ';' || p_type || '|' || p_brand AS type,
  CASE WHEN p_partkey % 2 = 0 THEN 'C0' ELSE 'C1' END AS city,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'D' || cast(p_partkey % 13 AS string) END AS district,
  CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE cast(p_size / cast(10 AS double) AS string) END AS rating_raw,
  CASE WHEN p_partkey % 7 = 0 THEN cast(-1 AS double) ELSE p_size / cast(10 AS double) END AS rating,
  CASE WHEN p_partkey % 3 = 0 THEN p_type END AS interest_group,
  replace(p_name, ' ', ',') AS tags,
  CASE WHEN p_size % 2 = 0 THEN 'walk,' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'photo,' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'quiet,' ELSE '' END AS behaviors,
  CASE WHEN p_partkey % 29 = 0 THEN '5A tour' WHEN p_partkey % 23 = 0 THEN '4A' ELSE p_type END AS poi_level,
  CASE WHEN p_partkey % 29 = 0 THEN '5A' WHEN p_partkey % 23 = 0 THEN '4A' ELSE '' END AS level,
  repeat('x', cast(p_partkey % 9 AS int)) AS description,
  CASE WHEN p_partkey % 31 = 0 THEN 'bad' ELSE
    cast(round(cast(114 AS double) + cast((p_partkey * 104729) % 10009 AS double) / 10009 * cast(0.9 AS double), 6) AS string) || ',' ||
    cast(round(cast(30.2 AS double) + cast((p_partkey * 7919) % 10007 AS double) / 10007 * cast(0.8 AS double), 6) AS string) END AS location,
  CASE WHEN p_partkey % 31 = 0 THEN cast(-999 AS double) ELSE round(cast(30.2 AS double) + cast((p_partkey * 7919) % 10007 AS double) / 10007 * cast(0.8 AS double), 6) END AS lat,
  CASE WHEN p_partkey % 31 = 0 THEN cast(-999 AS double) ELSE round(cast(114 AS double) + cast((p_partkey * 104729) % 10009 AS double) / 10009 * cast(0.9 AS double), 6) END AS lng
FROM part"""

# A request of every customer; some ask for a district that isn't known.
CUST = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 < 2 THEN 'C0' ELSE 'C1' END AS city, cast(floor(c_custkey / cast(50 AS double)) AS int) % 10 + 1 AS days,
  CASE cast(floor(c_custkey / cast(50 AS double)) AS int) % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'acclaimed' ELSE 'relaxed' END AS style,
  CASE cast(floor(c_custkey / cast(50 AS double)) AS int) % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'small,ring' WHEN 2 THEN 'blue,bolt,gear' ELSE '' END AS interests,
  CASE cast(floor(c_custkey / cast(50 AS double)) AS int) % 5 WHEN 0 THEN 'couple' WHEN 1 THEN 'family' WHEN 2 THEN 'nobody' ELSE 'solo' END AS companion,
  CASE WHEN c_custkey % 19 = 0 THEN 'nowhere' ELSE 'D' || cast(c_nationkey % 13 AS string) END AS stay_district
FROM customer"""

# The stated set that searches all places: requests whose id is divisible by 50.
REQ = "SELECT * FROM cust_fx WHERE request_id % 50 = 0"

DIST = """SELECT n_nationkey AS ord, 'D' || cast(n_nationkey AS string) AS name, cast(30.2 AS double) + cast(n_nationkey AS double) / 40 AS lat, cast(114 AS double) + cast(n_nationkey AS double) / 30 AS lng FROM nation"""

# A request's candidates: as many places of its city as its days ask for, in the order of a digest.
CAND = """SELECT request_id, id, rank, name, rating, tags, interests, behaviors, companion, level, style, district, lat, lng, days, cast(rank % days AS int) + 1 AS day,
  cast(30.5 AS double) AS start_lat, cast(114.3 AS double) AS start_lng
FROM (SELECT r.request_id, r.days, r.interests, r.companion, r.style, p.id, p.name, p.rating, p.tags, p.behaviors, p.level, p.district, p.lat, p.lng,
  cast(row_number() OVER (PARTITION BY r.request_id ORDER BY md5(cast(r.request_id AS string) || '|' || cast(p.id AS string)), p.id) AS int) AS rank
  FROM req_fx r JOIN poi_fx p ON r.city = p.city WHERE p.lat <> -999) ranked
WHERE rank <= least(greatest(40, days * 20), 120)"""

EVT = """SELECT event_id AS ord, user_id AS id, CASE WHEN event_type IN ('purchase','signup') THEN event_type END AS interest_group, value FROM events"""

ANCHOR = """SELECT n_nationkey AS ord, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'transport_hub' ELSE 'stay_district' END AS type,
  CASE WHEN n_nationkey % 7 = 0 THEN 'bad' ELSE cast(114 + n_nationkey AS string) || ',' || cast(30 + n_nationkey AS string) END AS location FROM nation"""

# Search results per anchor: the suppliers of a nation, every third of them under the nation's own name.
FOUND = """SELECT n_name AS anchor, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE s_name END AS name, cast(s_acctbal AS string) AS location
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

TAGGED = """SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN '```json' || chr(10) || '{"is_attraction": true, "tags": " ' || event_type || ' ", "behaviors": "walk", "description": "d"}' || chr(10) || '```'
  WHEN 1 THEN '{"is_attraction": "no", "tags": "a", "behaviors": "b", "description": "c"}' WHEN 2 THEN 'not json' WHEN 3 THEN '["a"]'
  WHEN 4 THEN '{"is_attraction": "YES", "tags": null, "behaviors": " x "}' ELSE props END AS raw FROM events"""

VIEWS = {"poi_fx": POI, "cust_fx": CUST, "req_fx": REQ, "dist_fx": DIST, "cand_fx": CAND, "evt_fx": EVT, "anchor_fx": ANCHOR, "found_fx": FOUND, "tagged_fx": TAGGED}
NEEDS = {"req_fx": ("cust_fx",), "cand_fx": ("poi_fx", "req_fx")}

RULES = CleanRules(hard_names=("anvil",), hard_types=("PROMO",), soft_types=("ECONOMY", "Brand#1"), exempt_words=("ring", "gear"), brand_store=r"\(.*shop\)", sub_facility=("medium", "large"), local=("gizmo",))
CORE = ("cold bolt", "hot bolt", "red ring")
GROUPS = Groups({"bolts": ("cold bolt", "hot bolt"), "all bolts": ("bolts",), "rods": ("new rod",)}, no_merge=("old rod-small", "red gear-promo"))
STYLE_TABLE = {"balanced": STYLES["综合"], "acclaimed": STYLES["口碑"], "relaxed": STYLES["悠闲"]}
CROWD = {"couple": {"walk": 1.0, "photo": 1.0, "quiet": 2.0}, "family": {"walk": 1.5, "photo": 1.0, "quiet": 0.8}, "solo": {"quiet": 2.5, "photo": 1.0}}
SPATIAL = replace(Spatial(("D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7")), max_km=12.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    if name == "cand_fx":
        return _candidates(spark, sf_dir)
    text = VIEWS[name]
    needed = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    frames = needed | {t: table(spark, sf_dir, t) for t in used}
    for n in frames:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 <<{n}>>", text)
    text = text.replace("{", "{{").replace("}", "}}").replace("<<", "{").replace(">>", "}")
    return spark.sql(text, **frames)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``CAND``, whose window would sort every place for every request."""
    poi = view(spark, sf_dir, "poi_fx").filter("lat <> -999").select("id", "city", "name", "rating", "tags", "behaviors", "level", "district", "lat", "lng")
    req = view(spark, sf_dir, "req_fx").select("request_id", "city", "days", "interests", "companion", "style")
    found = drawn(req, poi, recall_count(F.col("days")), "city")
    return found.selectExpr(
        *"request_id id rank name rating tags interests behaviors companion level style district lat lng days".split(), "cast(rank % days AS int) + 1 AS day",
        "cast(30.5 AS double) AS start_lat", "cast(114.3 AS double) AS start_lng",
    )


def oracle(body: str, *views: str, recursive: bool = False) -> str:
    """DuckDB SQL: the views as common table expressions before ``body`` (which may go on with ", x AS (...)")."""
    names: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, ()):
            add(n)
        if v not in names:
            names.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}" if body.startswith(",") else f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
