"""Queries of cleaning, anchors and tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions.text import parse_location, parse_rating, parse_tag_json, photo_urls, tag_prompt, valid_coordinate
from placeloom.operators import anchors, clean, group, tag
from placeloom.plans.fixtures import CORE, RULES, oracle, view
from placeloom.plans.registry import registry
from placeloom.sources.search_api import two_sources

QUERIES, ORACLE_SQL, query = registry()


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


REASON = f"""CASE WHEN {_any('name', RULES.hard_names)} OR {_any('type', RULES.hard_types)} THEN 'hard_exclude'
  WHEN name IN {CORE} THEN 'core_spot' WHEN coalesce(interest_group, '') <> '' THEN 'interest_group'
  WHEN {_any('type', RULES.soft_types)} AND NOT {_any('name', RULES.exempt_words)} THEN 'soft_exclude'
  WHEN regexp_matches(name, '{RULES.brand_store}') THEN 'brand_store'
  WHEN contains(name, '-') AND {_any("split_part(name, '-', -1)", RULES.sub_facility)} THEN 'sub_facility'
  WHEN {_any('name', RULES.local)} OR {_any('type', RULES.local)} THEN 'local_exclude' ELSE 'passed' END"""
KEEP = "reason IN ('core_spot', 'interest_group', 'passed')"
JUDGED = f", judged AS (SELECT *, {REASON} AS reason FROM poi_fx)\n"


@query(oracle(f"{JUDGED}SELECT id, name, reason, {KEEP} AS keep FROM judged", "poi_fx"))
def clean_rule_chain(spark, sf_dir):
    return clean.apply_rules(view(spark, sf_dir, "poi_fx"), RULES, CORE).select("id", "name", "reason", "keep")


@query(oracle(f"SELECT id, name FROM poi_fx WHERE regexp_matches(name, '{RULES.brand_store}')", "poi_fx"))
def clean_brand_regex(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").filter(F.col("name").rlike(RULES.brand_store)).select("id", "name")


@query(oracle(f"{JUDGED}SELECT reason, count(*) AS n FROM judged WHERE NOT {KEEP} GROUP BY reason", "poi_fx"))
def clean_reason_hist(spark, sf_dir):
    return clean.reason_histogram(clean.apply_rules(view(spark, sf_dir, "poi_fx"), RULES, CORE))


def _raw(spark, sf_dir):
    """poi_fx as raw places, each id twice, the second time flagged."""
    poi = view(spark, sf_dir, "poi_fx")
    url = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("http://p/"), F.col("id").cast("string")))
    raw = poi.select(
        "ord", F.col("id").cast("string").alias("id"), "name", F.col("district").alias("adname"), F.lit(None).cast("string").alias("address"), "location", "type",
        F.when(F.col("id") % 13 != 0, F.struct(F.col("rating_raw").alias("rating"), F.lit("9-17").alias("opentime_today"), F.col("poi_level").alias("keytag"))).alias("business"),
        F.array(F.struct(F.lit("t").alias("title"), url.alias("url"))).alias("photos"), F.col("city").alias("_city"), F.lit(None).cast("string").alias("_interest_group"), F.lit("now").alias("_crawled_at"), "interest_group",
    )
    flagged = raw.filter("interest_group IS NOT NULL").withColumns({"_interest_group": F.col("interest_group"), "ord": F.col("ord") + 1_000_000})
    return raw.unionByName(flagged).drop("interest_group")


_CLEAN_COLUMNS = """id::VARCHAR AS id, name, city, district, '' AS address, location, type, CASE WHEN id % 13 = 0 THEN -1.0::DOUBLE ELSE rating END AS rating,
  CASE WHEN id % 13 = 0 THEN '' ELSE '9-17' END AS opentime, CASE WHEN id % 13 = 0 THEN '' ELSE poi_level END AS poi_level, CASE WHEN id % 3 = 0 THEN '' ELSE 'http://p/' || id END AS photos, 'amap' AS source, 'now' AS crawled_at"""


@query(oracle(f"SELECT {_CLEAN_COLUMNS} FROM poi_fx UNION ALL SELECT {_CLEAN_COLUMNS} FROM poi_fx WHERE interest_group IS NOT NULL", "poi_fx"))
def clean_projection(spark, sf_dir):
    return clean.project_clean(_raw(spark, sf_dir)).drop("ord").withColumn("photos", F.array_join("photos", ","))


@query(oracle(f"""{JUDGED}, kept AS (SELECT * FROM judged WHERE {KEEP} AND district <> ''), c AS (SELECT ord, {_CLEAN_COLUMNS} FROM kept)
SELECT * EXCLUDE (ord) FROM c ORDER BY rating DESC, ord LIMIT 400""", "poi_fx"))
def clean_city_pipeline(spark, sf_dir):
    return clean.clean_city(_raw(spark, sf_dir), RULES, CORE).drop("ord", "interest_group").withColumn("photos", F.array_join("photos", ","))


@query(oracle("""SELECT ord, id, interest_group, value, position FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS position,
  row_number() OVER (PARTITION BY id ORDER BY interest_group IS NULL, ord) AS r FROM evt_fx) WHERE r = 1""", "evt_fx"))
def dedupe_prefer_flagged(spark, sf_dir):
    return clean.dedupe_prefer_flagged(view(spark, sf_dir, "evt_fx")).select("ord", "id", "interest_group", "value", "position")


@query(oracle("SELECT id, name, rating FROM poi_fx ORDER BY rating DESC, ord LIMIT 400", "poi_fx"))
def rating_cap(spark, sf_dir):
    return clean.cap_by_rating(view(spark, sf_dir, "poi_fx")).select("id", "name", "rating")


@query(oracle("""SELECT CASE WHEN split_part(type, ';', 1) = '' THEN '未知' ELSE split_part(type, ';', 1) END AS prefix, count(*) AS n FROM poi_fx GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10""", "poi_fx"))
def type_prefix_top10(spark, sf_dir):
    return clean.type_prefixes(view(spark, sf_dir, "poi_fx"))


_NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_ODD = "CASE id % 4 WHEN 0 THEN rating_raw || 'f' WHEN 1 THEN ' ' || rating_raw WHEN 2 THEN '1_0' || rating_raw ELSE rating_raw END"


@query(oracle(f", r AS (SELECT id, {_ODD} AS raw FROM poi_fx) SELECT id, raw, CASE WHEN regexp_matches(raw, '{_NUMBER}') THEN coalesce(TRY_CAST(replace(trim(raw), '_', '') AS DOUBLE), -1) ELSE -1 END AS rating FROM r", "poi_fx"), name="parse_rating")
def parse_ratings(spark, sf_dir):
    raw = view(spark, sf_dir, "poi_fx").selectExpr("id", f"{_ODD} AS raw")
    return raw.withColumn("rating", parse_rating(F.col("raw")))



@query(oracle("SELECT id, lat, lng FROM poi_fx", "poi_fx"), name="parse_location")
def parse_locations(spark, sf_dir):
    at = parse_location(F.col("location"))
    return view(spark, sf_dir, "poi_fx").select("id", at["lat"].alias("lat"), at["lng"].alias("lng"))



@query(oracle("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE 'u' || id END || CASE WHEN id % 3 > 0 AND id % 4 > 0 THEN ',' ELSE '' END || CASE WHEN id % 4 = 0 THEN '' ELSE 'v' || id END AS urls, ((id % 3 > 0)::INT + (id % 4 > 0)::INT) AS n FROM poi_fx", "poi_fx"))
def extract_urls(spark, sf_dir):
    poi = view(spark, sf_dir, "poi_fx")
    key = F.col("id").cast("string")
    photos = F.array(F.struct(F.lit("a").alias("title"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("u"), key)).alias("url")), F.struct(F.lit("b").alias("title"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("v"), key)).alias("url")))
    urls = photo_urls(photos)
    return poi.select("id", F.array_join(urls, ",").alias("urls"), F.size(urls).alias("n"))


@query(oracle("SELECT id, name FROM poi_fx WHERE coalesce(CASE WHEN id % 4 = 0 THEN false WHEN id % 4 = 1 THEN true END, true)", "poi_fx"))
def kb_attraction_filter(spark, sf_dir):
    flag = F.when(F.col("id") % 4 == 0, False).when(F.col("id") % 4 == 1, True)
    return group.attractions(view(spark, sf_dir, "poi_fx").withColumn("is_attraction", flag)).select("id", "name")


@query(oracle("SELECT id, lat, lng FROM poi_fx WHERE lat <> -999 AND lng <> -999", "poi_fx"))
def valid_coords(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").filter(valid_coordinate(F.col("lat"), F.col("lng"))).select("id", "lat", "lng")


@query(oracle("SELECT id, name, interest_group FROM poi_fx WHERE interest_group IS NOT NULL UNION ALL SELECT id, name, NULL FROM poi_fx", "poi_fx"))
def two_source_union(spark, sf_dir):
    poi = view(spark, sf_dir, "poi_fx").select("id", "name", "interest_group")
    return two_sources(poi.filter("interest_group IS NOT NULL"), poi.drop("interest_group"))


@query(oracle("SELECT anchor, ord, name, location FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY name <> anchor, ord) AS r FROM found_fx) WHERE r = 1", "found_fx"))
def anchor_best_match(spark, sf_dir):
    return anchors.best_match(view(spark, sf_dir, "found_fx"))


@query(oracle("SELECT name AS anchor, type FROM anchor_fx WHERE name NOT IN (SELECT anchor FROM found_fx WHERE ord % 2 = 0)", "anchor_fx", "found_fx"))
def anchor_misses(spark, sf_dir):
    wanted = view(spark, sf_dir, "anchor_fx").withColumnRenamed("name", "anchor")
    found = view(spark, sf_dir, "found_fx").filter("ord % 2 = 0")
    return anchors.crawl_anchors(anchors.of_type(wanted, anchors.HUB), anchors.of_type(wanted, anchors.DISTRICT), found)[1]


@query(oracle("SELECT name, (30 + ord)::DOUBLE AS lat, (114 + ord)::DOUBLE AS lng, type FROM anchor_fx WHERE location <> 'bad' AND type = 'transport_hub'", "anchor_fx"))
def anchor_partition(spark, sf_dir):
    return anchors.of_type(anchors.clean_anchors(view(spark, sf_dir, "anchor_fx")), anchors.HUB)


@query(oracle(""", w AS (SELECT DISTINCT 'NATION_' || (n_regionkey * 2) AS wanted FROM nation), a AS (SELECT ord, name, type FROM anchor_fx UNION ALL SELECT ord + 100, 'NATION_' || (ord * 2), 'transport_hub' FROM anchor_fx)
SELECT wanted, ord, type FROM (SELECT wanted, ord, type, row_number() OVER (PARTITION BY wanted ORDER BY type <> 'transport_hub', ord) AS r FROM w JOIN a ON wanted = name) WHERE r = 1""", "anchor_fx"))
def anchor_lookup(spark, sf_dir):
    known = view(spark, sf_dir, "anchor_fx").select("ord", "name", "type")
    doubled = known.select((F.col("ord") + 100).alias("ord"), F.concat(F.lit("NATION_"), (F.col("ord") * 2).cast("string")).alias("name"), F.lit(anchors.HUB).alias("type"))
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("NATION_"), (F.col("n_regionkey") * 2).cast("string")).alias("wanted")).distinct()
    return anchors.lookup(known.union(doubled), wanted).select("wanted", "ord", "type")


@query(oracle("SELECT request_id, stay_district, coalesce(d.lat, 0) AS stay_lat, coalesce(d.lng, 0) AS stay_lng, d.name IS NOT NULL AS stay_found FROM cust_fx r LEFT JOIN dist_fx d ON r.stay_district = d.name", "cust_fx", "dist_fx"))
def stay_coord_lookup(spark, sf_dir):
    return anchors.stay_coordinates(view(spark, sf_dir, "cust_fx"), view(spark, sf_dir, "dist_fx")).select("request_id", "stay_district", "stay_lat", "stay_lng", "stay_found")


@query("SELECT event_id AS id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.event_id)")
def resume_pending(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    done = events.filter("event_type = 'error'").select(F.col("user_id").alias("id"))
    return tag.pending(events.select(F.col("event_id").alias("id"), "event_type"), done)


_TAGS = """, b AS (SELECT id, trim(replace(replace(raw, '```json', ''), '```', ''), chr(10) || ' ') AS body FROM tagged_fx),
j AS (SELECT id, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN body::JSON END END AS j FROM b),
k AS (SELECT id, j, CASE WHEN j IS NULL THEN true ELSE coalesce(lower(j->>'is_attraction') IN ('true', '1', 'yes'), true) END AS ok FROM j),
t AS (SELECT id, ok AS is_attraction, CASE WHEN ok THEN coalesce(trim(j->>'tags'), '') ELSE '' END AS tags, CASE WHEN ok THEN coalesce(trim(j->>'behaviors'), '') ELSE '' END AS behaviors, CASE WHEN ok THEN coalesce(trim(j->>'description'), '') ELSE '' END AS description FROM k)
"""


def _parsed(spark, sf_dir):
    return view(spark, sf_dir, "tagged_fx").select("id", parse_tag_json(F.col("raw")).alias("t")).select("id", "t.*")


@query(oracle(f"{_TAGS}SELECT * FROM t", "tagged_fx"), name="parse_tag_json")
def parse_tag_jsons(spark, sf_dir):
    return _parsed(spark, sf_dir)



@query(oracle(f"""{_TAGS}SELECT count(*) FILTER (is_attraction AND NOT (tags = '' AND behaviors = '' AND description = '')) AS success, count(*) FILTER (is_attraction AND tags = '' AND behaviors = '' AND description = '') AS fail,
  count(*) FILTER (NOT is_attraction) AS not_attraction, (SELECT count(*) FROM events) - count(*) AS skipped FROM t""", "tagged_fx"))
def tag_outcome_counts(spark, sf_dir):
    return tag.outcomes(_parsed(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))


@query(oracle("SELECT id, '名称：' || name || chr(10) || '类型：' || type || chr(10) || '地址：' || chr(10) || '评分：' || rating_raw || chr(10) || '景区等级：' || CASE WHEN level = '' THEN '无' ELSE level END AS prompt FROM poi_fx", "poi_fx"), name="tag_prompt")
def tag_prompts(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", tag_prompt(F.col("name"), F.col("type"), F.lit(None).cast("string"), F.col("rating_raw"), F.col("level")).alias("prompt"))

