"""Queries of building the knowledge base: parsing, grouping, merging, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import group, index
from placeloom.plans.fixtures import GROUPS, oracle, view
from placeloom.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

_RAW_TAGS = "CASE WHEN id % 3 = 0 THEN replace(tags, ',', '，') WHEN id % 3 = 1 THEN ' ' || replace(tags, ',', ' ,, ') ELSE behaviors END"
_PARTS = "list_filter(list_transform(string_split(replace({}, '，', ','), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(oracle(f", r AS (SELECT id, {_RAW_TAGS} AS raw FROM poi_fx), p AS (SELECT id, raw, {_PARTS.format('raw')} AS p FROM r) SELECT id, raw, array_to_string(p, '|') AS tags, len(p)::INT AS n FROM p", "poi_fx"))
def split_tags(spark, sf_dir):
    raw = view(spark, sf_dir, "poi_fx").selectExpr("id", f"{_RAW_TAGS} AS raw")
    parts = T.split_tags(F.col("raw"))
    return raw.select("id", "raw", F.array_join(parts, "|").alias("tags"), F.size(parts).alias("n"))


@query(oracle(r"SELECT id, poi_level, regexp_extract(poi_level, '\dA', 0) AS level FROM poi_fx", "poi_fx"))
def parse_level(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", "poi_level", T.parse_level(F.col("poi_level")).alias("level"))


_SHOWN = "CASE WHEN id % 4 = 0 THEN replace(replace(name, '(', '（'), ')', '）') WHEN id % 9 = 0 THEN '(' || name || ')' WHEN id % 7 = 0 THEN '（a）' || name || ' (b)' ELSE name END"


@query(oracle(f""", shown AS (SELECT id, {_SHOWN} AS name FROM poi_fx) SELECT id, name, CASE WHEN short = '' THEN name ELSE short END AS display_name
FROM (SELECT id, name, trim(regexp_replace(name, '[（(][^（）()]*[）)]', '', 'g')) AS short FROM shown)""", "poi_fx"))
def display_name(spark, sf_dir):
    named = view(spark, sf_dir, "poi_fx").selectExpr("id", f"{_SHOWN} AS name")
    return named.select("id", "name", T.display_name(F.col("name")).alias("display_name"))


def _types(generic: tuple[str, ...] = ()) -> str:
    """CTE types (id, clean_type): the distinct words of a type in order, without the generic ones."""
    left = f" AND p NOT IN ({', '.join(repr(g) for g in generic)})" if generic else ""
    return f""", tp AS (SELECT id, trim(unnest(string_split(replace(type, '|', ';'), ';'))) AS p, generate_subscripts(string_split(replace(type, '|', ';'), ';'), 1) AS i FROM poi_fx),
tf AS (SELECT id, p, min(i) AS i FROM tp WHERE p <> ''{left} GROUP BY id, p), tj AS (SELECT id, string_agg(p, ',' ORDER BY i) AS clean_type FROM tf GROUP BY id),
types AS (SELECT poi_fx.id, coalesce(clean_type, '') AS clean_type FROM poi_fx LEFT JOIN tj ON poi_fx.id = tj.id)"""


GENERIC = ("PROMO", "ECONOMY", "Brand#13")


@query(oracle(f"{_types(GENERIC)} SELECT id, clean_type FROM types", "poi_fx"))
def clean_type(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", T.clean_type(F.col("type"), GENERIC).alias("clean_type"))


_SHORTEST = """, names AS (SELECT DISTINCT name FROM poi_fx WHERE name <> ''),
shortest AS (SELECT n.name, arg_min(v.name, lpad(length(v.name)::VARCHAR, 9, '0') || v.name) AS canonical FROM names n JOIN names v ON contains(n.name, v.name) GROUP BY n.name)"""


@query(oracle(f"{_SHORTEST} SELECT name, canonical FROM shortest", "poi_fx"))
def canonical_shortest_substring(spark, sf_dir):
    return group.shortest_substring(view(spark, sf_dir, "poi_fx"))


# The chains of GROUPS, followed to their ends by hand.
_CANON = f"""{_SHORTEST}, manual(member, grp) AS (VALUES ('cold bolt', 'all bolts'), ('hot bolt', 'all bolts'), ('bolts', 'all bolts'), ('new rod', 'rods')),
canon AS (SELECT s.name, CASE WHEN s.name IN {GROUPS.no_merge} THEN s.name ELSE coalesce(own.grp, auto.grp, s.canonical) END AS canonical
  FROM shortest s LEFT JOIN manual own ON s.name = own.member LEFT JOIN manual auto ON s.canonical = auto.member)"""


@query(oracle(f"{_CANON} SELECT name, canonical FROM canon", "poi_fx"))
def canonical_map(spark, sf_dir):
    return group.canonical_map(view(spark, sf_dir, "poi_fx"), GROUPS)


def _union(column: str) -> str:
    return f"""{column}_w AS (SELECT canonical, ord, {_PARTS.format(column)} AS p FROM members), {column}_e AS (SELECT canonical, ord, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {column}_w),
{column}_u AS (SELECT canonical, string_agg(x, '|' ORDER BY o) AS v FROM (SELECT canonical, x, min(ord * 1000 + i) AS o FROM {column}_e GROUP BY ALL) GROUP BY canonical)"""


_MERGED = f"""{_CANON}, members AS (SELECT p.*, c.canonical FROM poi_fx p JOIN canon c ON p.name = c.name), {_union("tags")}, {_union("behaviors")},
al AS (SELECT canonical, string_agg(name, '|' ORDER BY o) AS v FROM (SELECT canonical, name, min(ord) AS o FROM members WHERE name <> canonical GROUP BY ALL) GROUP BY canonical),
rep AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY rating DESC, length(description) DESC, ord) AS r, max(rating) OVER (PARTITION BY canonical) AS best, min(ord) OVER (PARTITION BY canonical) AS position FROM members),
merged AS (SELECT r.* EXCLUDE (tags, behaviors, rating), r.best AS rating, coalesce(al.v, '') AS aliases, coalesce(t.v, '') AS tags, coalesce(b.v, '') AS behaviors
  FROM rep r LEFT JOIN al ON r.canonical = al.canonical LEFT JOIN tags_u t ON r.canonical = t.canonical LEFT JOIN behaviors_u b ON r.canonical = b.canonical WHERE r = 1)"""


def merged(spark, sf_dir):
    poi = view(spark, sf_dir, "poi_fx")
    return group.merge_groups(poi, group.canonical_map(poi, GROUPS))


def joined(c: str):
    return F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)


@query(oracle(f'{_MERGED} SELECT id, name, canonical AS "group", rating, aliases, tags, behaviors, position FROM merged', "poi_fx"))
def group_merge_pois(spark, sf_dir):
    return merged(spark, sf_dir).select("id", "name", "group", "rating", joined("aliases"), joined("tags"), joined("behaviors"), "position")


@query(oracle(f'{_MERGED} SELECT canonical AS "group", tags, behaviors FROM merged', "poi_fx"))
def tag_union(spark, sf_dir):
    return merged(spark, sf_dir).select("group", joined("tags"), joined("behaviors"))


_DOCS = f"""{_types()}{_MERGED}, docs AS (SELECT m.*, CASE WHEN t.clean_type = '' THEN '景点' ELSE t.clean_type END AS kind FROM merged m JOIN types t ON m.id = t.id),
texts AS (SELECT *, regexp_replace(name || CASE WHEN aliases = '' THEN '' ELSE '（又称：' || replace(aliases, '|', '、') || '）' END || '，位于' || city || district || '。类型：' || kind || '，属于' || replace(tags, '|', '、') || '类，可以' || replace(behaviors, '|', '、') || '。' || chr(10) || description, '^\\s+|\\s+$', '', 'g') AS text FROM docs)"""


@query(oracle(f"{_DOCS} SELECT id, text FROM texts", "poi_fx"))
def build_text(spark, sf_dir):
    return index.build_documents(merged(spark, sf_dir)).select("id", "text")


@query(oracle(rf"""{_DOCS} SELECT id, trim(regexp_replace(name, '[（(][^（）()]*[）)]', '', 'g')) AS display_name, regexp_extract(poi_level, '\dA', 0) AS level, kind AS clean_type, lat, lng, canonical AS "group",
nullif(aliases, '') AS aliases, nullif(tags, '') AS tags, nullif(behaviors, '') AS behaviors, md5(text) AS text_md5 FROM texts""", "poi_fx"))
def kb_documents(spark, sf_dir):
    docs = index.build_documents(merged(spark, sf_dir).drop("lat", "lng", "level"))
    filled = lambda c: F.array_join(c, "|").alias(c)  # noqa: E731  null for an array that was empty
    return docs.select("id", "display_name", "level", "clean_type", "lat", "lng", "group", filled("aliases"), filled("tags"), filled("behaviors"), F.md5("text").alias("text_md5"))


@query(oracle(f"""{_DOCS} SELECT id, json_object('id', id, 'name', name, 'group', canonical, 'text', text)::VARCHAR AS line FROM texts""", "poi_fx"))
def kb_archive(spark, sf_dir):
    docs = index.build_documents(merged(spark, sf_dir))
    return docs.select("id", F.to_json(F.struct("id", "name", "group", "text")).alias("line"))
