"""Queries of sources and sinks: what was written, read back; place search page by page; what plans are handed."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import contract
from placeloom.functions import text as T
from placeloom.operators import index
from placeloom.plans import build_queries as build
from placeloom.plans import retrieve_queries as retrieval
from placeloom.plans import trip
from placeloom.plans.fixtures import oracle, table, view
from placeloom.plans.registry import registry
from placeloom.schema import RAW_ANCHOR
from placeloom.session import new_folder
from placeloom.sources import place_source, places

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS ord, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey || ',' || n_regionkey END AS location, CASE WHEN n_nationkey % 2 = 0 THEN 'stay_district' ELSE 'transport_hub' END AS type FROM nation")
def json_array_places(spark, sf_dir):
    """Anchors as one JSON array file a region, written twice (the second time skipped) and read back."""
    rows = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS region", "n_name AS name", "CASE WHEN n_nationkey % 3 = 0 THEN concat(n_nationkey, ',', n_regionkey) END AS location", "CASE WHEN n_nationkey % 2 = 0 THEN 'stay_district' ELSE 'transport_hub' END AS type")
    at = f"{new_folder(spark)}/anchors"
    places.write_json_arrays(rows, at, "region", "name")
    places.write_json_arrays(rows.limit(0), at, "region", "name")
    return places.read_json_array(spark, at, RAW_ANCHOR).select(F.col("region").cast("long").alias("region"), "ord", "name", "location", "type")


@query("SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord, doc_id AS id, md5(coalesce(text, '')) AS digest FROM documents")
def json_array_texts(spark, sf_dir):
    """The documents of a language as one JSON array file, large files read by many tasks."""
    at = f"{new_folder(spark)}/texts"
    places.write_json_arrays(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), at, "lang", "doc_id")
    return places.read_json_array(spark, at, "doc_id long, text string").select("lang", "ord", F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_SAID = ("id % 3 <> 0 AS is_attraction", "CASE WHEN id % 4 = 0 THEN '' ELSE tags END AS tags", "behaviors", "CASE WHEN id % 5 = 0 THEN NULL ELSE description END AS description")


@query(oracle(f"SELECT id::VARCHAR AS id, name, city, rating, {', '.join(_SAID)} FROM poi_fx", "poi_fx"))
def json_lines_tagged(spark, sf_dir):
    """Tagged places appended in two batches; blank and malformed lines between them are left out when they are read."""
    rows = view(spark, sf_dir, "poi_fx").selectExpr("id % 2 AS batch", "cast(id AS string) AS id", "name", "city", "rating", *_SAID)
    at = f"{new_folder(spark)}/tagged"
    for batch in (0, 1):
        places.append_lines(rows.filter(F.col("batch") == batch).drop("batch"), at)
    spark.createDataFrame([("",), ('{"id": "1", "name": ',), ("no json",)], "value string").write.mode("append").text(at)
    return places.read_tagged(spark, at).select("id", "name", "city", "rating", "is_attraction", "tags", "behaviors", "description")


@query("SELECT vec_id AS id, lang AS city, len(embedding)::INT AS dims, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2))), 6) AS norm FROM embeddings JOIN documents ON vec_id = doc_id")
def vector_store(spark, sf_dir):
    """The embeddings written as a table per city and read back."""
    placed = retrieval.vectors(spark, sf_dir).join(retrieval.corpus(spark, sf_dir).select("id", "city"), "id")
    at = f"{new_folder(spark)}/vectors"
    index.write_vectors(placed, at)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return spark.read.schema(placed.schema).parquet(at).select("id", "city", F.size("embedding").alias("dims"), F.round(norm, 6).alias("norm"))


# The search service: the places of a keyword are the parts of that name, on pages of five in one city and of seven in the other.
_PAGED = """SELECT n AS ord, p_name AS keyword, 'C' || cast(n % 2 AS string) AS region, cast(CASE WHEN n % 2 = 0 THEN 5 ELSE 7 END AS int) AS page_size, cast(n % 13 + 1 AS int) AS max_pages
FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) AS n FROM (SELECT DISTINCT p_name FROM part) a) b"""


@query(f"""WITH k AS ({_PAGED}), f AS (SELECT p_name, p_partkey, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS i FROM part)
SELECT ord, keyword, region, i // page_size + 1 AS page, i % page_size AS position, p_partkey AS id, p_brand AS brand FROM k JOIN f ON p_name = keyword WHERE i < page_size * max_pages AND region = 'C1'""")
def keyword_pages(spark, sf_dir):
    """The pages of all names of parts in one city, from a service whose answers are the parts themselves; the other city's keywords are never asked for."""
    parts = table(spark, sf_dir, "part")
    at = f"{new_folder(spark)}/service"
    parts.select(F.col("p_name").alias("keyword"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")).write.partitionBy("keyword").json(at)
    keywords = spark.sql(_PAGED.replace("FROM part", "FROM {part}"), part=parts)
    found = place_source.read_pages(spark, keywords, "placeloom.sources.place_source:folder", at.removeprefix("file://")).filter("region = 'C1'")
    place = F.from_json("place", "id long, brand string")
    return found.select("ord", "keyword", "region", F.col("page").cast("long"), F.col("position").cast("long"), place["id"].alias("id"), place["brand"].alias("brand"))


_FIELDS = contract.contract_from({"poi": {
    "id": {"type": "int", "required": True, "stage": "crawl", "usage": ["system"]}, "name": {"type": "string", "required": True, "stage": "crawl", "usage": ["embed"]},
    "district": {"type": "string", "required": True, "stage": "clean", "usage": ["embed", "filter"]}, "rating_raw": {"type": "float", "stage": "crawl", "usage": ["filter"]},
    "interest_group": {"type": "string", "required": True, "stage": "crawl"}, "opentime": {"type": "string", "required": True, "stage": "crawl"}, "level": {"type": "bool", "stage": "clean"},
    "tags": {"type": "list[string]", "required": True, "stage": "tag"},
}})
_REASONS = """SELECT id, list_filter([CASE WHEN district = '' THEN 'district: missing' END, CASE WHEN rating_raw = 'n/a' THEN 'rating_raw: not a float' END, CASE WHEN interest_group IS NULL THEN 'interest_group: missing' END,
  'opentime: missing', CASE WHEN level <> '' THEN 'level: not a bool' END], lambda x: x IS NOT NULL) AS reasons FROM poi_fx"""


@query(oracle(f", r AS ({_REASONS}) SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason", "poi_fx"))
def field_contract(spark, sf_dir):
    """How many places break each line of a contract; one field is of a later stage and isn't looked at."""
    return contract.reason_counts(contract.route(view(spark, sf_dir, "poi_fx"), _FIELDS, "clean")[1])


_SPELT = "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || p_size || '.5 ' WHEN 3 THEN p_size || '_000' WHEN 4 THEN p_size || 'e2' WHEN 5 THEN '-.' || p_size WHEN 6 THEN 'inf' WHEN 7 THEN '' ELSE '+' || p_size || '.' END"
_READ = "CASE p_partkey % 9 WHEN 2 THEN p_size + 0.5::DOUBLE WHEN 3 THEN p_size * 1000::DOUBLE WHEN 4 THEN p_size * 100::DOUBLE WHEN 5 THEN -p_size / CASE WHEN p_size < 10 THEN 10::DOUBLE ELSE 100::DOUBLE END WHEN 8 THEN p_size::DOUBLE ELSE -1::DOUBLE END"


@query(f"SELECT p_partkey AS id, {_SPELT} AS raw, round({_READ}, 6) AS number FROM part")
def safe_float(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_SPELT} AS raw")
    return raw.select("id", "raw", F.round(T.to_float(F.col("raw")), 6).alias("number"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_name END AS shown FROM part")
def display_name_fallback(spark, sf_dir):
    named = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS display_name", "p_name AS name")
    return named.select("id", T.first_nonempty(F.col("display_name"), F.col("name")).alias("shown"))


_DAYS = "(item_id % 10 + 1)::INT"


@query(f"""WITH q AS (SELECT item_id AS request_id, {retrieval._CITY} AS city, {_DAYS} AS days, embedding AS vector FROM benchmark JOIN embeddings ON item_id = vec_id)
SELECT request_id, id, score, rank FROM (SELECT request_id, days, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score, id) AS rank
  FROM (SELECT request_id, days, v.vec_id AS id, {retrieval._L2.format('q.vector')} AS score FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id JOIN q ON d.lang = q.city)) WHERE rank <= least(greatest(40, days * 20), 120)""")
def recall_without_index(spark, sf_dir):
    """What requests recall if no inverted index was built: the vectors' list alone, as long as their days ask for."""
    asked = retrieval.asked(spark, sf_dir).selectExpr("query_id AS request_id", "array('red') AS interests", "city", "cast(query_id % 10 + 1 AS int) AS days", "vector")
    kb = retrieval.vectors(spark, sf_dir).join(retrieval.corpus(spark, sf_dir).select("id", "city"), "id")
    return trip.recalled(asked, kb, kb, None)


@query(oracle(f"""{build._DOCS} SELECT c.request_id, c.day, t.id AS poi_id, t.name, trim(regexp_replace(t.name, '[（(][^（）()]*[）)]', '', 'g')) AS display_name, replace(t.tags, '|', ',') AS tags, replace(t.behaviors, '|', ',') AS behaviors,
regexp_extract(t.poi_level, '\\dA', 0) AS level, t.aliases, t.description, t.lat, t.lng, t.rating, t.district, c.rank % 3 AS cluster_id FROM cand_fx c JOIN texts t ON c.id = t.id""", "cand_fx"))
def plan_places(spark, sf_dir):
    """The fields that a plan has of each of its places."""
    planned = view(spark, sf_dir, "cand_fx").selectExpr("request_id", "day", "id", "rank % 3 AS cluster_id")
    docs = index.build_documents(build.merged(spark, sf_dir).drop("lat", "lng", "level").withColumn("photos", F.array().cast("array<string>")))
    return trip.plan_places(planned, docs).drop("photos").withColumns({c: F.coalesce(F.array_join(c, s), F.lit("")) for c, s in (("aliases", "|"),)})
