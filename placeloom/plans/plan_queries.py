"""Queries of planning: scores, sampling, routes, clusters, areas, day texts, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeloom.config import DEFAULT_STYLE, KM_A_DEGREE
from placeloom.functions import scores
from placeloom.functions import text as T
from placeloom.functions.geo import circle, haversine, inside
from placeloom.operators import evaluate, geometry, itinerary, picker, spatial
from placeloom.plans.fixtures import CORE, CROWD, SPATIAL, STYLE_TABLE, oracle, table, view
from placeloom.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


def km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))))"


def uniform_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _parts(column: str) -> str:
    return f"list_filter(string_split({column}, ','), lambda x: x <> '')"


_RATING = "CASE WHEN rating < 0 THEN 0.6::DOUBLE ELSE least(rating / 5, 1.0::DOUBLE) END"
_INTEREST = f"""CASE WHEN len({_parts('interests')}) = 0 THEN 0.5::DOUBLE WHEN len({_parts('tags')}) = 0 THEN 0.0::DOUBLE
  ELSE least(len(list_filter({_parts('tags')}, lambda t: list_contains({_parts('interests')}, t)))::DOUBLE / len({_parts('interests')}), 1.0::DOUBLE) END"""
_LEVEL = "CASE WHEN level IN ('5A', '4A') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_CORE = "(" + " OR ".join(f"contains(name, '{w}')" for w in CORE) + ")"
_CROWD = ", crowd(companion, behavior, weight) AS (VALUES " + ", ".join(f"('{c}', '{b}', {w}::DOUBLE)" for c, ws in CROWD.items() for b, w in ws.items()) + ")"
_BEHAVIOR = f"""{_CROWD}, be AS (SELECT request_id, id, companion, unnest({_parts('behaviors')}) AS behavior FROM cand_fx), most AS (SELECT companion, max(weight) AS most FROM crowd GROUP BY companion),
bn AS (SELECT request_id, id, least((0.7::DOUBLE * max(weight) + 0.3::DOUBLE * avg(weight)) / any_value(most), 1.0::DOUBLE) AS b FROM be JOIN crowd USING (companion, behavior) JOIN most USING (companion) GROUP BY ALL),
bh AS (SELECT c.request_id, c.id, coalesce(b, 0.0::DOUBLE) AS t_behavior FROM cand_fx c LEFT JOIN bn ON c.request_id = bn.request_id AND c.id = bn.id)"""
_STYLES = ", styles(style, rating_w, interest_w, random_w, core_w, behavior_w, level_w, target) AS (VALUES " + ", ".join(f"('{k}', {s.rating}::DOUBLE, {s.interest}::DOUBLE, {s.random}::DOUBLE, {s.core}::DOUBLE, {s.behavior}::DOUBLE, {s.level}::DOUBLE, {s.target})" for k, s in STYLE_TABLE.items()) + ")"
_TERMS = f"""{_BEHAVIOR}{_STYLES}, sc AS (SELECT c.*, {_RATING} AS t_rating, {_INTEREST} AS t_interest, t_behavior, {_LEVEL} AS t_level, {_CORE} AS t_core, s.* EXCLUDE (style),
  {uniform_sql("'42|' || c.style || '|' || (c.day - 1) || '|c|' || c.id")} AS draw FROM cand_fx c JOIN bh ON c.request_id = bh.request_id AND c.id = bh.id JOIN styles s ON c.style = s.style),
based AS (SELECT *, rating_w * t_rating + interest_w * t_interest + random_w * draw + core_w * t_core::INT + behavior_w * t_behavior + level_w * t_level AS base FROM sc)"""


def candidates(spark, sf_dir):
    """cand_fx with its lists split."""
    return view(spark, sf_dir, "cand_fx").withColumns({c: T.split_tags(F.col(c)) for c in ("tags", "interests", "behaviors")})


def scored(spark, sf_dir):
    return picker.score_terms(candidates(spark, sf_dir), CORE, CROWD)


@query(oracle("SELECT request_id, days, least(greatest(40, days * 20), 120) AS n FROM cust_fx", "cust_fx"))
def recall_count(spark, sf_dir):
    return view(spark, sf_dir, "cust_fx").select("request_id", "days", scores.recall_count(F.col("days")).alias("n"))


@query(oracle(f"SELECT id, rating, {_RATING} AS rating_norm FROM poi_fx", "poi_fx"))
def rating_norm(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", "rating", scores.rating_norm(F.col("rating")).alias("rating_norm"))


@query(oracle(f"SELECT request_id, id, round({_INTEREST}, 6) AS interest_match FROM cand_fx", "cand_fx"))
def interest_match(spark, sf_dir):
    return candidates(spark, sf_dir).select("request_id", "id", F.round(scores.interest_match(F.col("tags"), F.col("interests")), 6).alias("interest_match"))


@query(oracle(f"{_BEHAVIOR} SELECT request_id, id, round(t_behavior, 6) AS behavior_norm FROM bh", "cand_fx"))
def behavior_norm(spark, sf_dir):
    return candidates(spark, sf_dir).select("request_id", "id", F.round(scores.behavior_norm(F.col("behaviors"), F.col("companion"), CROWD), 6).alias("behavior_norm"))


@query(oracle(f"SELECT id, level, {_LEVEL} AS level_norm FROM poi_fx", "poi_fx"))
def level_norm(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", "level", scores.level_norm(F.col("level")).alias("level_norm"))


@query(oracle(f"{_STYLES} SELECT request_id, r.style, rating_w, core_w, target FROM cust_fx r JOIN styles s ON r.style = s.style", "cust_fx"))
def style_weights(spark, sf_dir):
    w = lambda term: scores.style_weight(F.col("style"), term, STYLE_TABLE, "balanced")
    return view(spark, sf_dir, "cust_fx").select("request_id", "style", w("rating").alias("rating_w"), w("core").alias("core_w"), w("target").alias("target"))


@query(oracle(f"SELECT id, name, {_CORE} AS is_core FROM poi_fx", "poi_fx"))
def core_spot_match(spark, sf_dir):
    return view(spark, sf_dir, "poi_fx").select("id", "name", T.contains_any(F.col("name"), CORE).alias("is_core"))


@query(oracle(f"{_TERMS} SELECT request_id, day, id, round(base, 6) AS base FROM based", "cand_fx"))
def base_score(spark, sf_dir):
    c = F.col
    key = F.concat_ws("|", F.lit("42"), c("style"), (c("day") - 1).cast("string"), F.lit("c"), c("id").cast("string"))
    base = scores.base_score(c("style"), c("t_rating"), c("t_interest"), scores.md5_uniform(key), c("t_core"), c("t_behavior"), c("t_level"), STYLE_TABLE, "balanced")
    return scored(spark, sf_dir).select("request_id", "day", "id", F.round(base, 6).alias("base"))


_FACTOR = "CASE WHEN km < 0.5 THEN 0.1::DOUBLE WHEN km < 1.5 THEN 0.6::DOUBLE WHEN km < 2.0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


@query(oracle(f""", first AS (SELECT request_id, day, lat AS plat, lng AS plng FROM cand_fx WHERE rank <= days), d AS (SELECT c.request_id, c.id, {_CORE} AS core, {km_sql('plat', 'plng', 'lat', 'lng')} AS km FROM cand_fx c JOIN first f ON c.request_id = f.request_id AND c.day = f.day)
SELECT request_id, id, round(km, 6) AS km, round(CASE WHEN core THEN 1 - (1 - {_FACTOR}) / 2 ELSE {_FACTOR} END, 6) AS factor FROM d""", "cand_fx"))
def distance_penalty(spark, sf_dir):
    """The penalty of each candidate once the first of its day is picked."""
    cand = candidates(spark, sf_dir)
    picked = cand.filter("rank <= days").select("request_id", "day", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    km = haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    return cand.join(picked, ["request_id", "day"]).select("request_id", "id", F.round(km, 6).alias("km"), F.round(scores.distance_factor(km, T.contains_any(F.col("name"), CORE)), 6).alias("factor"))


@query(oracle(f"SELECT request_id, id, lock FROM (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY {_RATING} DESC, rank) AS lock FROM cand_fx WHERE level = '5A') WHERE lock <= 3", "cand_fx"))
def must_include_lock(spark, sf_dir):
    return picker.lock_must_haves(scored(spark, sf_dir), 3).select("request_id", "id", "lock")


@query(oracle(f""", w AS (SELECT request_id, id, rank, sum({_RATING}) OVER (PARTITION BY request_id ORDER BY rank) AS run, sum({_RATING}) OVER (PARTITION BY request_id) AS total FROM cand_fx)
SELECT request_id, arg_min(id, rank) AS id FROM w WHERE run >= {uniform_sql("'draw|' || request_id")} * total GROUP BY request_id""", "cand_fx"))
def weighted_draw(spark, sf_dir):
    return picker.weighted_draw(scored(spark, sf_dir).withColumn("weight", F.col("t_rating")))


_WALK = """, walk AS (SELECT DISTINCT {key}, 0 AS stop, -1::BIGINT AS id, start_lat AS lat, start_lng AS lng, []::BIGINT[] AS seen FROM {rows}
UNION ALL SELECT {key}, stop + 1, id, lat, lng, list_append(seen, id) FROM (SELECT {wkey}, w.stop, c.id, c.lat, c.lng, w.seen, row_number() OVER (PARTITION BY {wkey} ORDER BY {km}, c.rank) AS r
  FROM walk w JOIN {rows} c ON {same} AND NOT list_contains(w.seen, c.id)) WHERE r = 1)"""


def walk_sql(rows: str, *key: str) -> str:
    return _WALK.format(key=", ".join(key), wkey=", ".join(f"w.{k}" for k in key), rows=rows, same=" AND ".join(f"w.{k} = c.{k}" for k in key), km=km_sql("w.lat", "w.lng", "c.lat", "c.lng"))


@query(oracle(f"{walk_sql('cand_fx', 'request_id')} SELECT request_id, stop, id FROM walk WHERE stop > 0", "cand_fx", recursive=True))
def greedy_nn_order(spark, sf_dir):
    return picker.routes(candidates(spark, sf_dir))


# Rounds of one draw each over the candidates of a day, then the greedy walk over what was picked.
_NEAREST = f"list_min(list_transform(picked, lambda p: {km_sql('p.lat', 'p.lng', 'b.lat', 'b.lng')}))"
_WEIGHED = f"""SELECT d.request_id, d.day, d.style, d.target, d.i, d.picked, b.id, b.lat, b.lng, b.rank, {uniform_sql("'42|' || d.style || '|' || (d.day - 1) || '|r|' || d.i")} AS u,
  CASE WHEN list_contains(list_transform(d.picked, lambda p: p.id), b.id) THEN 0.0::DOUBLE ELSE base * (SELECT CASE WHEN km IS NULL THEN 1.0::DOUBLE WHEN b.t_core THEN 1 - (1 - {_FACTOR}) / 2 ELSE {_FACTOR} END FROM (SELECT {_NEAREST} AS km)) END AS w
  FROM draws d JOIN pool b ON d.request_id = b.request_id AND d.day = b.day WHERE len(d.picked) < d.target"""
_DRAWS = f"""{_TERMS}, pool AS (SELECT *, count(*) OVER (PARTITION BY request_id, day) AS n FROM based),
locked AS (SELECT request_id, day, id, lat, lng, rank, row_number() OVER (PARTITION BY request_id, day ORDER BY t_rating DESC, rank) AS l FROM pool WHERE n > target AND style = 'acclaimed' AND level = '5A' QUALIFY l <= target),
begun AS (SELECT p.request_id, p.day, p.style, p.target, coalesce(l.picked, []::STRUCT(id BIGINT, lat DOUBLE, lng DOUBLE)[]) AS picked FROM (SELECT DISTINCT request_id, day, style, target FROM pool WHERE n > target) p
  LEFT JOIN (SELECT request_id, day, list({{'id': id, 'lat': lat, 'lng': lng}}) AS picked FROM locked GROUP BY ALL) l ON p.request_id = l.request_id AND p.day = l.day),
draws AS (SELECT request_id, day, style, target, 0 AS i, picked FROM begun
  UNION ALL SELECT request_id, day, any_value(style), any_value(target), any_value(i) + 1, list_append(any_value(picked), arg_min({{'id': id, 'lat': lat, 'lng': lng}}, rank) FILTER (run >= u * total)) FROM (
    SELECT *, sum(w) OVER (PARTITION BY request_id, day ORDER BY rank) AS run, sum(w) OVER (PARTITION BY request_id, day) AS total FROM (
      {_WEIGHED})) GROUP BY request_id, day)"""
_PICK = f"""{_DRAWS},
chosen AS (SELECT request_id, day, unnest(picked).id AS id FROM draws WHERE len(picked) = target UNION ALL SELECT request_id, day, id FROM pool WHERE n <= target),
stops AS (SELECT p.request_id, p.day, p.id, p.rank, p.lat, p.lng, p.start_lat, p.start_lng FROM pool p JOIN chosen c ON p.request_id = c.request_id AND p.day = c.day AND p.id = c.id){walk_sql('stops', 'request_id', 'day')}
SELECT request_id, day, stop, id FROM walk WHERE stop > 0"""


def picked(spark, sf_dir):
    return picker.pick_days(scored(spark, sf_dir), 42, "md5", STYLE_TABLE, "balanced", "acclaimed").drop("base")


def traced(spark, sf_dir):
    return picker.pick_traces(scored(spark, sf_dir), 42, "md5", STYLE_TABLE, "balanced", "acclaimed")


@query(oracle(_PICK, "cand_fx", recursive=True))
def pick_day(spark, sf_dir):
    return picked(spark, sf_dir)


@query(oracle(f"""{_DRAWS}, done AS (SELECT b.request_id, b.day, len(b.picked) AS locked, list_transform(d.picked, lambda p: p.id) AS ids FROM begun b JOIN draws d ON b.request_id = d.request_id AND b.day = d.day AND len(d.picked) = d.target)
SELECT p.request_id, p.day, p.id, CASE WHEN n > target THEN round(base, 6) END AS base, CASE WHEN n <= target THEN 0 WHEN list_contains(ids, p.id) THEN greatest(list_position(ids, p.id) - locked, 0) END AS picked_in
FROM pool p LEFT JOIN done USING (request_id, day)""", "cand_fx", recursive=True))
def pick_trace(spark, sf_dir):
    """Every candidate's base score and the round that picked it."""
    return traced(spark, sf_dir).select("request_id", "day", "id", F.round("base", 6).alias("base"), "picked_in")


@query(oracle(f"""{_DRAWS}, weighed AS ({_WEIGHED}), after AS (SELECT request_id, day, i, picked[len(picked)].id AS last FROM draws)
SELECT w.request_id, w.day, w.i + 1 AS round, w.place, w.id, round(w.w, 6) AS weight, w.id = a.last AS picked
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, day, i ORDER BY round(w, 9) DESC, rank) AS place FROM weighed WHERE NOT list_contains(list_transform(picked, lambda p: p.id), id)) w
JOIN after a ON a.request_id = w.request_id AND a.day = w.day AND a.i = w.i + 1 WHERE w.place <= 5""", "cand_fx", recursive=True))
def pick_rounds(spark, sf_dir):
    """The five heaviest candidates of every round of picking."""
    return picker.heaviest(traced(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


# Every request once under each style, as if it were three requests.
_STYLED = ", styled AS (SELECT * REPLACE (request_id * 3 + s AS request_id, ['balanced', 'acclaimed', 'relaxed'][s + 1] AS style) FROM cand_fx, range(3) r(s))"
_COMPARED = _PICK.replace("cand_fx", "styled").replace(
    "SELECT request_id, day, stop, id FROM walk WHERE stop > 0", "SELECT request_id // 3 AS request_id, ['balanced', 'acclaimed', 'relaxed'][request_id % 3 + 1] AS style, day, stop, id FROM walk WHERE stop > 0"
)


@query(oracle(_STYLED + _COMPARED, "cand_fx", recursive=True))
def style_compare(spark, sf_dir):
    return picker.compare_styles(scored(spark, sf_dir), 42, "md5", STYLE_TABLE, default="balanced", locking="acclaimed").drop("base")


# Spatial.


@query(oracle(f"SELECT a.request_id, a.day, a.id AS a, b.id AS b, round({km_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 6) AS km FROM cand_fx a JOIN cand_fx b ON a.request_id = b.request_id AND a.day = b.day AND a.id < b.id", "cand_fx"))
def haversine_pairs(spark, sf_dir):
    """Distances within each day of a request, a group of bounded size."""
    cand = view(spark, sf_dir, "cand_fx").select("request_id", "day", "id", "lat", "lng")
    a, b = cand.alias("a"), cand.alias("b")
    both = a.join(b, (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.id") < F.col("b.id")))
    km = haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return both.select("a.request_id", "a.day", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(km, 6).alias("km"))


@query(oracle(f", k AS (SELECT p.id, d.name AS centre, {km_sql('p.lat', 'p.lng', 'd.lat', 'd.lng')} AS km FROM poi_fx p, dist_fx d WHERE p.lat <> -999) SELECT id, centre, round(km, 6) AS km FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, centre) = 1", "poi_fx", "dist_fx"))
def nearest_center_assign(spark, sf_dir):
    points = view(spark, sf_dir, "poi_fx").filter(T.valid_coordinate(F.col("lat"), F.col("lng"))).select("id", "lat", "lng")
    return spatial.nearest_centre(points, view(spark, sf_dir, "dist_fx"), "name").select("id", "centre", F.round("km", 6).alias("km"))


@query(oracle("SELECT request_id, day, count(*) AS size, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM cand_fx GROUP BY ALL", "cand_fx"))
def cluster_centroids(spark, sf_dir):
    at = spatial.centroids(view(spark, sf_dir, "cand_fx"), "request_id", "day")
    return at.select("request_id", "day", "size", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(oracle(f"SELECT a.request_id, a.day, round(max({km_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}), 6) AS km FROM cand_fx a JOIN cand_fx b ON a.request_id = b.request_id AND a.day = b.day AND a.id < b.id GROUP BY ALL", "cand_fx"))
def cluster_diameter(spark, sf_dir):
    return spatial.diameters(view(spark, sf_dir, "cand_fx"), "request_id", "day").select("request_id", "day", F.round("km", 6).alias("km"))


@query(oracle(f"SELECT request_id, day, count(*) FILTER (district IN {SPATIAL.urban_districts}) * 2 > count(*) AS urban FROM cand_fx GROUP BY ALL", "cand_fx"))
def urban_majority(spark, sf_dir):
    return spatial.urban_majority(view(spark, sf_dir, "cand_fx"), SPATIAL.urban_districts, "request_id", "day")


@query(oracle(f""", seg AS (SELECT request_id, day::BIGINT AS id, day AS rank, avg(lat) AS lat, avg(lng) AS lng, min(start_lat) AS start_lat, min(start_lng) AS start_lng FROM cand_fx GROUP BY ALL){walk_sql('seg', 'request_id')}
SELECT request_id, stop, id FROM walk WHERE stop > 0""", "cand_fx", recursive=True))
def segment_order(spark, sf_dir):
    """The days' centres as stops of a walk."""
    cand = view(spark, sf_dir, "cand_fx")
    seg = cand.groupBy("request_id", "day").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("start_lat").alias("start_lat"), F.min("start_lng").alias("start_lng"))
    return picker.routes(seg.withColumns({"id": F.col("day").cast("long"), "rank": F.col("day")}))


def _planned(upto: str):
    def run(spark, sf_dir):
        cand = view(spark, sf_dir, "cand_fx").withColumns({"stay_lat": F.col("start_lat"), "stay_lng": F.col("start_lng")})
        return spatial.spatial_plan(cand, SPATIAL, upto)

    return run


for _name, _upto in (("geo_kmeans", "clusters"), ("cluster_size_cap", "clusters"), ("absorb_singletons", "absorbed"), ("days_partition", "dealt"), ("reassign_until_stable", "corrected"), ("fill_min_points", "filled"), ("spatial_plan", "planned")):
    query(name=_name)(_planned(_upto))


# Steps on clusters that are given: every ninth place alone, the others dealt by their ranks; a cluster's number gives its day.
_GIVEN = "CASE WHEN rank % 9 = 0 THEN 100 + rank ELSE rank % 17 END"
_CITY = ", ".join(f"'{d}'" for d in SPATIAL.urban_districts)
_LABELLED = f""", given AS (SELECT request_id, id, lat, lng, district, days, {_GIVEN} AS cluster, ({_GIVEN}) * 5 % 7 % days + 1 AS day FROM cand_fx),
grp AS (SELECT request_id, cluster, any_value(days) AS days, any_value(day) AS day, count(*) AS n, sum(lat) AS lat, sum(lng) AS lng, count(*) FILTER (district IN ({_CITY})) * 2 > count(*) AS urban FROM given GROUP BY request_id, cluster)"""


def _given(step: str):
    def run(spark, sf_dir):
        cand = view(spark, sf_dir, "cand_fx").withColumn("cluster", F.expr(_GIVEN))
        return spatial.one_step(cand.withColumn("day", F.expr("cluster * 5 % 7 % days + 1")), SPATIAL, step)

    return run


def _km_to(lat: str, lng: str) -> str:
    return km_sql("c.lat / c.n", "c.lng / c.n", lat, lng)


# Clusters as lists of sums: single points in the order of their numbers join the nearest, whose sums grow.
query(oracle(f"""{_LABELLED}, larger AS (SELECT request_id, list({{'cluster': cluster, 'day': day, 'n': n, 'lat': lat, 'lng': lng}} ORDER BY cluster) AS cs FROM grp WHERE urban AND n > 1 GROUP BY request_id),
alone AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cluster) AS i FROM grp WHERE urban AND n = 1),
joined AS (SELECT request_id, 0::BIGINT AS i, 0 AS cluster, 0 AS into_cluster, 0 AS into_day, cs FROM larger UNION ALL
  SELECT request_id, i, cluster, goal.cluster, goal.day, list_transform(cs, lambda c: CASE WHEN c.cluster = goal.cluster THEN {{'cluster': c.cluster, 'day': c.day, 'n': c.n + 1, 'lat': c.lat + lat, 'lng': c.lng + lng}} ELSE c END)
  FROM (SELECT a.request_id, a.i, a.cluster, a.lat, a.lng, j.cs, list_sort(list_transform(j.cs, lambda c: {{'km': {_km_to('a.lat', 'a.lng')}, 'cluster': c.cluster, 'day': c.day}}))[1] AS goal FROM joined j JOIN alone a ON a.request_id = j.request_id AND a.i = j.i + 1))
SELECT g.request_id, g.id, coalesce(j.into_day, g.day) AS day, coalesce(j.into_cluster, g.cluster) AS cluster FROM given g LEFT JOIN joined j ON g.request_id = j.request_id AND g.cluster = j.cluster AND j.i > 0""", "cand_fx", recursive=True), "absorb_given_clusters")(_given("absorbed"))

# Rounds of all clusters to the nearest day's centre; once none moves, further rounds change nothing.
query(oracle(f"""{_LABELLED}, turns AS (SELECT request_id, cluster, n, lat, lng, day, 0 AS turn FROM grp UNION ALL
  SELECT request_id, cluster, n, lat, lng, list_sort(list_transform(centres, lambda d: {{'km': {km_sql('lat / n', 'lng / n', 'd.lat', 'd.lng')}, 'day': d.day}}))[1].day, turn + 1
  FROM (SELECT *, list({{'day': day, 'lat': dlat, 'lng': dlng}}) OVER (PARTITION BY request_id) AS centres
    FROM (SELECT *, sum(lat) OVER d / sum(n) OVER d AS dlat, sum(lng) OVER d / sum(n) OVER d AS dlng FROM turns WHERE turn < {SPATIAL.correction_rounds} WINDOW d AS (PARTITION BY request_id, day))))
SELECT g.request_id, g.id, t.day, g.cluster FROM given g JOIN turns t ON g.request_id = t.request_id AND g.cluster = t.cluster AND t.turn = {SPATIAL.correction_rounds}""", "cand_fx", recursive=True), "reassign_given_clusters")(_given("corrected"))

# Rounds in which one cluster of a request moves: sizes and centres of its days, the poorest day, its giver, what is given.
query(oracle(f"""{_LABELLED}, turns AS (SELECT request_id, any_value(days) AS days, 0 AS turn, list({{'cluster': cluster, 'day': day, 'n': n, 'lat': lat, 'lng': lng}} ORDER BY cluster) AS cs FROM grp GROUP BY request_id UNION ALL
  SELECT request_id, days, turn + 1, list_transform(cs, lambda c: CASE WHEN c.cluster = moved THEN {{'cluster': c.cluster, 'day': poor.day, 'n': c.n, 'lat': c.lat, 'lng': c.lng}} ELSE c END)
  FROM (SELECT *, list_sort(list_transform(list_filter(cs, lambda c: c.day = giver), lambda c: {{'km': {_km_to('poor.lat', 'poor.lng')}, 'cluster': c.cluster}}))[1].cluster AS moved
  FROM (SELECT *, list_sort(list_transform(list_filter(segs, lambda s: s.day <> poor.day AND s.n > 0 AND s.n - s.least >= {SPATIAL.min_points}), lambda s: {{'km': {km_sql('poor.lat', 'poor.lng', 's.lat', 's.lng')}, 'day': s.day}}))[1].day AS giver
  FROM (SELECT *, list_sort(segs)[1] AS poor
  FROM (SELECT request_id, any_value(days) AS days, any_value(turn) AS turn, any_value(cs) AS cs, list({{'n': n, 'day': day, 'least': least, 'lat': CASE WHEN n > 0 THEN lat / n ELSE 0 END, 'lng': CASE WHEN n > 0 THEN lng / n ELSE 0 END}}) AS segs
  FROM (SELECT request_id, days, turn, cs, d.day AS day, list_sum([0] || list_transform(list_filter(cs, lambda c: c.day = d.day), lambda c: c.n)) AS n, list_min(list_transform(list_filter(cs, lambda c: c.day = d.day), lambda c: c.n)) AS least,
    list_sum(list_transform(list_filter(cs, lambda c: c.day = d.day), lambda c: c.lat)) AS lat, list_sum(list_transform(list_filter(cs, lambda c: c.day = d.day), lambda c: c.lng)) AS lng FROM turns, range(1, 11) d(day) WHERE d.day <= days AND turn < {SPATIAL.fill_rounds})
  GROUP BY request_id)) WHERE poor.n < {SPATIAL.min_points}) WHERE giver IS NOT NULL)),
last AS (SELECT request_id, unnest(arg_max(cs, turn), recursive := true) FROM turns GROUP BY request_id)
SELECT g.request_id, g.id, l.day, g.cluster FROM given g JOIN last l ON g.request_id = l.request_id AND g.cluster = l.cluster""", "cand_fx", recursive=True), "fill_given_clusters")(_given("filled"))


@query(name="cluster_size_cap")
def cluster_size_cap(spark, sf_dir):
    """The clusters' sizes; none is above the cap."""
    return _planned("clusters")(spark, sf_dir).groupBy("request_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query()
def plan_dropped(spark, sf_dir):
    return _planned("planned")(spark, sf_dir).filter("day IS NULL")


# Geometry.


@query(oracle("""SELECT id, i::INT AS i, round(lat + 0.4::DOUBLE / 111.32::DOUBLE * cos(2 * pi() * i / 48), 6) AS lat, round(lng + 0.4::DOUBLE / (111.32::DOUBLE * cos(radians(lat))) * sin(2 * pi() * i / 48), 6) AS lng
FROM poi_fx, range(48) r(i) WHERE lat <> -999""", "poi_fx"))
def circle_poly(spark, sf_dir):
    poi = view(spark, sf_dir, "poi_fx").filter(T.valid_coordinate(F.col("lat"), F.col("lng")))
    points = poi.select("id", F.explode(circle(F.col("lat"), F.col("lng"), F.lit(geometry.LEAST_RADIUS_KM))).alias("p"))
    return points.select("id", "p.i", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query(oracle("SELECT request_id, day, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM cand_fx GROUP BY ALL", "cand_fx"))
def day_centroid(spark, sf_dir):
    return geometry.day_centroids(view(spark, sf_dir, "cand_fx")).select("request_id", "day", "n", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_RING = ((114.1, 30.25), (114.8, 30.3), (114.5, 30.55), (114.75, 30.9), (114.2, 30.8))


@query(oracle(", ring(i, x, y) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_RING)) + """), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy FROM ring a JOIN ring b ON b.i = (a.i + 4) % 5)
SELECT id, count(*) FILTER ((ay > lat) <> (cy > lat) AND lng < (cx - ax) * (lat - ay) / (cy - ay) + ax) % 2 = 1 AS inside FROM poi_fx, e WHERE lat <> -999 GROUP BY id""", "poi_fx"))
def point_in_polygon(spark, sf_dir):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))
    poi = view(spark, sf_dir, "poi_fx").filter(T.valid_coordinate(F.col("lat"), F.col("lng")))
    return poi.select("id", inside(F.col("lng"), F.col("lat"), ring).alias("inside"))


def _shapes(shape: str):
    return lambda spark, sf_dir: geometry.day_shapes(view(spark, sf_dir, "cand_fx"), shape).withColumns({c: F.round(c, 9) for c in ("lat", "lng")})


# An edge of the hull has all other points on its left, or on itself; its ends in the order of their angle from the middle, the least point first.
_HULL = """, pt AS (SELECT DISTINCT request_id, day, lat, lng FROM cand_fx), big AS (SELECT request_id, day, count(*) AS n FROM pt GROUP BY ALL),
edge AS (SELECT a.request_id, a.day, a.lat, a.lng FROM pt a JOIN pt b ON a.request_id = b.request_id AND a.day = b.day AND (a.lat <> b.lat OR a.lng <> b.lng)
  WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.request_id = a.request_id AND c.day = a.day AND ((b.lat - a.lat) * (c.lng - a.lng) - (b.lng - a.lng) * (c.lat - a.lat) < 0
    OR ((b.lat - a.lat) * (c.lng - a.lng) = (b.lng - a.lng) * (c.lat - a.lat) AND (c.lat - a.lat) * (c.lat - b.lat) + (c.lng - a.lng) * (c.lng - b.lng) > 0)))),
corner AS (SELECT *, lat = first_value(lat) OVER o AND lng = first_value(lng) OVER o AS least, atan2(lng - avg(lng) OVER w, lat - avg(lat) OVER w) AS angle
  FROM (SELECT DISTINCT * FROM edge) WINDOW w AS (PARTITION BY request_id, day), o AS (PARTITION BY request_id, day ORDER BY lat, lng)),
turned AS (SELECT *, angle - max(angle) FILTER (least) OVER (PARTITION BY request_id, day) AS turn FROM corner),
hull AS (SELECT request_id, day, row_number() OVER (PARTITION BY request_id, day ORDER BY CASE WHEN turn < 0 THEN turn + 2 * pi() ELSE turn END) - 1 AS vertex, lat, lng FROM turned JOIN big USING (request_id, day) WHERE n > 2
  UNION ALL SELECT request_id, day, row_number() OVER (PARTITION BY request_id, day ORDER BY lat, lng) - 1, lat, lng FROM pt JOIN big USING (request_id, day) WHERE n <= 2)"""


def _cut(before: str, after: str) -> str:
    """One round of corner cutting; rings of one or two points stay as they are."""
    return f""", {before}_n AS (SELECT *, count(*) OVER w AS m, coalesce(lead(lat) OVER o, first_value(lat) OVER o) AS lat2, coalesce(lead(lng) OVER o, first_value(lng) OVER o) AS lng2
  FROM {before} WINDOW w AS (PARTITION BY request_id, day), o AS (PARTITION BY request_id, day ORDER BY vertex)),
{after} AS (SELECT request_id, day, vertex, lat, lng FROM {before}_n WHERE m <= 2
  UNION ALL SELECT request_id, day, 2 * vertex, 0.75::DOUBLE * lat + 0.25::DOUBLE * lat2, 0.75::DOUBLE * lng + 0.25::DOUBLE * lng2 FROM {before}_n WHERE m > 2
  UNION ALL SELECT request_id, day, 2 * vertex + 1, 0.25::DOUBLE * lat + 0.75::DOUBLE * lat2, 0.25::DOUBLE * lng + 0.75::DOUBLE * lng2 FROM {before}_n WHERE m > 2)"""


_RING_SQL = " SELECT request_id, day, vertex::INT AS vertex, round(lat, 9) AS lat, round(lng, 9) AS lng FROM {}"
# The smoothed hull (a circle for fewer than three corners) grown about the mean of the stops by the first factor that leaves all of them well inside.
_AREA = _HULL + _cut("hull", "one") + _cut("one", "two") + _cut("two", "three") + f""", mid AS (SELECT request_id, day, avg(lat) AS mlat, avg(lng) AS mlng, cos(radians(avg(lat))) * {KM_A_DEGREE} AS km_lng FROM cand_fx GROUP BY ALL),
corners AS (SELECT request_id, day, count(*) AS h FROM hull GROUP BY ALL),
far AS (SELECT request_id, day, greatest(max(sqrt(pow((lng - mlng) * km_lng, 2) + pow((lat - mlat) * {KM_A_DEGREE}, 2))), {geometry.LEAST_RADIUS_KM}::DOUBLE) AS r FROM cand_fx JOIN mid USING (request_id, day) GROUP BY ALL),
base AS (SELECT request_id, day, vertex, lat, lng FROM three JOIN corners USING (request_id, day) WHERE h > 2
  UNION ALL SELECT request_id, day, i, mlat + r / {KM_A_DEGREE}::DOUBLE * cos(2 * pi() * i / 48), mlng + r / km_lng * sin(2 * pi() * i / 48) FROM corners JOIN far USING (request_id, day) JOIN mid USING (request_id, day), range(48) t(i) WHERE h <= 2),
factors(f, factor) AS (VALUES {", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(geometry.FACTORS))}),
grown AS (SELECT request_id, day, f, vertex, mlat + (lat - mlat) * factor AS lat, mlng + (lng - mlng) * factor AS lng, km_lng FROM base JOIN mid USING (request_id, day), factors),
side AS (SELECT request_id, day, f, km_lng, ax, ay, coalesce(lead(ax) OVER o, first_value(ax) OVER o) AS bx, coalesce(lead(ay) OVER o, first_value(ay) OVER o) AS by_
  FROM (SELECT *, lng * km_lng AS ax, lat * {KM_A_DEGREE}::DOUBLE AS ay FROM grown) WINDOW o AS (PARTITION BY request_id, day, f ORDER BY vertex)),
seen AS (SELECT c.request_id, c.day, c.id, f, ax, ay, bx, by_, lng * km_lng AS x, lat * {KM_A_DEGREE}::DOUBLE AS y FROM cand_fx c JOIN side s ON c.request_id = s.request_id AND c.day = s.day),
along AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / greatest(pow(bx - ax, 2) + pow(by_ - ay, 2), 1e-300))) AS t FROM seen),
held AS (SELECT request_id, day, f, id, count(*) FILTER ((ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax) % 2 = 1 AS inside, min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2))) AS km FROM along GROUP BY ALL),
fits AS (SELECT request_id, day, f FROM held GROUP BY ALL HAVING bool_and(inside) AND min(km) >= {geometry.MARGIN_KM}),
grows AS (SELECT mid.request_id, mid.day, coalesce(min(f), {len(geometry.FACTORS) - 1}) AS f FROM mid LEFT JOIN fits ON mid.request_id = fits.request_id AND mid.day = fits.day GROUP BY ALL),
area AS (SELECT g.* FROM grown g JOIN grows USING (request_id, day, f))"""

_SHAPE_SQL = {"hull": oracle(_HULL + _RING_SQL.format("hull"), "cand_fx"), "smooth": oracle(_HULL + _cut("hull", "one") + _cut("one", "two") + _cut("two", "three") + _RING_SQL.format("three"), "cand_fx"), "area": oracle(_AREA + _RING_SQL.format("area"), "cand_fx")}

for _name, _shape in (("convex_hull", "hull"), ("chaikin", "smooth"), ("fit_area", "area")):
    query(_SHAPE_SQL[_shape], name=_name)(_shapes(_shape))


# Day texts.

_ALIASES = "CASE WHEN id % 3 = 0 THEN 'A' || id || '/' || 'B' || id END"
_LINE = f"stop || '. ' || name || CASE WHEN {_ALIASES} IS NULL THEN '' ELSE '（含 ' || {_ALIASES} || '）' END || ' | ' || tags || ' | ' || description"
_STOPS = ", st AS (SELECT c.request_id, c.day, c.id, c.name, c.tags, p.description, row_number() OVER (PARTITION BY c.request_id, c.day ORDER BY c.rank) AS stop FROM cand_fx c JOIN poi_fx p ON c.id = p.id)"
_LINES = f"{_STOPS}, ln AS (SELECT request_id, day, count(*) AS n, string_agg({_LINE}, chr(10) ORDER BY stop) AS lines FROM st GROUP BY ALL)"


def _stops(spark, sf_dir):
    """All candidates of a day as its stops, by rank."""
    cand = view(spark, sf_dir, "cand_fx").select("request_id", "day", "rank", "id", "name", "tags")
    key = F.col("id").cast("string")
    aliases = F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("A"), key), F.concat(F.lit("B"), key)))
    stop = F.row_number().over(Window.partitionBy("request_id", "day").orderBy("rank"))
    return cand.join(view(spark, sf_dir, "poi_fx").select("id", "description"), "id").withColumns({"aliases": aliases, "display_name": F.lit(""), "stop": stop})


def _prompts(spark, sf_dir):
    req = view(spark, sf_dir, "req_fx").withColumn("interests", T.split_tags(F.col("interests")))
    return itinerary.day_prompts(_stops(spark, sf_dir), req).drop("system")


@query(oracle(f"{_LINES} SELECT request_id, day, lines FROM ln", "cand_fx"))
def day_prompt_lines(spark, sf_dir):
    return _prompts(spark, sf_dir).select("request_id", "day", T.day_lines(F.col("pois")).alias("lines"))


@query(oracle(f"""{_LINES} SELECT l.request_id, day, '【用户需求】' || chr(10) || '城市：' || city || chr(10) || '兴趣偏好：' || CASE WHEN interests = '' THEN '不限' ELSE replace(interests, ',', '、') END || chr(10) || '同行人：' || companion || chr(10)
  || '行程共 ' || days || ' 天，这是其中：Day' || day || chr(10) || '住宿地：' || stay_district || chr(10) || chr(10) || '【本日景点】（共 ' || n || ' 个，必须全部出现，不得增删）' || chr(10) || lines || chr(10) || chr(10) || '请写 Day' || day || ' 这一天的行程文案。' AS prompt
FROM ln l JOIN req_fx r ON l.request_id = r.request_id""", "cand_fx"))
def day_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).select("request_id", "day", "prompt")


_TOLD = "CASE style " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STYLE_NOTES.items()) + f" ELSE '{T.STYLE_NOTES[DEFAULT_STYLE]}' END"
_STYLED = "CASE request_id % 4 WHEN 0 THEN '口碑' WHEN 1 THEN '悠闲' WHEN 2 THEN '综合' ELSE style END"


@query(oracle(f", r AS (SELECT request_id, {_STYLED} AS style FROM req_fx) SELECT request_id, day, {_TOLD} AS note, 4 AS n_lines FROM (SELECT DISTINCT request_id, day FROM cand_fx) JOIN r USING (request_id)", "cand_fx"))
def day_system_note(spark, sf_dir):
    """What the system prompt of each day ends with, by the request's style, and how many lines it has; an unknown style has the default's note."""
    req = view(spark, sf_dir, "req_fx").withColumns({"interests": T.split_tags(F.col("interests")), "style": F.expr(_STYLED)})
    lines = F.split("system", "\n")
    return itinerary.day_prompts(_stops(spark, sf_dir), req).select("request_id", "day", F.element_at(lines, -1).alias("note"), F.size(lines).alias("n_lines"))


_SAID = "SELECT DISTINCT conv_id, turn, text FROM conversations"
_NAMES = "SELECT DISTINCT split_part(name, '-', 1) AS name FROM poi_fx"


@query(oracle(f", n AS ({_NAMES}), t AS ({_SAID}) SELECT conv_id, turn, name FROM t, n WHERE contains(coalesce(text, ''), substr(name, 1, 3))", "poi_fx"))
def mentioned_check(spark, sf_dir):
    """Which places each turn mentions."""
    names = view(spark, sf_dir, "poi_fx").select(F.split_part("name", F.lit("-"), F.lit(1)).alias("name")).distinct()
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.or_empty(F.col("text")).alias("text"))
    return itinerary.mentions(turns, names, "conv_id", "turn")


@query(oracle(f""", n AS (SELECT DISTINCT w AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''), t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)
SELECT id, name FROM t, n WHERE contains(text, name) AND NOT (id % 2 = 0 AND name = 'red')""", "poi_fx"))
def out_of_scope_mentions(spark, sf_dir):
    """Words of place names in all documents; red is allowed in every second one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.or_empty(F.col("text")).alias("text"))
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    allowed = docs.filter("id % 2 = 0").select("id", F.lit("red").alias("name"))
    return itinerary.out_of_scope(docs, names, allowed)


@query(oracle(f"""{_STOPS}, ph AS (SELECT request_id, day, row_number() OVER (PARTITION BY request_id, day ORDER BY stop) AS card, replace(replace(name, '(', '&lt;'), ')', '&gt;') AS name, 'http://p/?a=1&amp;b=' || id AS photo FROM st WHERE id % 4 <> 0)
SELECT * FROM ph WHERE card <= 6""", "cand_fx"))
def photo_cards(spark, sf_dir):
    url = F.concat(F.lit("http://p/?a=1&b="), F.col("id").cast("string"))
    shown = _stops(spark, sf_dir).withColumns({"name": F.translate("name", "()", "<>"), "photos": F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(url))})
    return itinerary.photo_cards(shown)


# Evaluation: a case per request, whose results are its candidates; what is expected are core spots and a name of its own.

_CASES = """, cs AS (SELECT request_id AS case_id, list(name ORDER BY rank) AS top, any_value(style) AS type, CASE WHEN any_value(days) <= 2 THEN 'easy' WHEN any_value(days) <= 5 THEN 'medium' ELSE 'hard' END AS difficulty FROM cand_fx GROUP BY request_id),
ex AS (SELECT *, CASE WHEN case_id % 4 = 0 THEN []::VARCHAR[] WHEN case_id % 4 = 1 THEN ['cold bolt', 'no such place'] ELSE [top[3], 'hot bolt', 'red ring', 'none'] END AS expected, CASE WHEN case_id % 3 = 0 THEN ['large', 'nowhere'] ELSE []::VARCHAR[] END AS must_not FROM cs),
ev AS (SELECT case_id, type, difficulty, top, expected, must_not, list_filter(expected, lambda w: len(list_filter(top, lambda n: contains(n, w))) = 0) AS missed, list_filter(must_not, lambda w: len(list_filter(top, lambda n: contains(n, w))) > 0) AS unexpected,
  coalesce(list_position(list_transform(top, lambda n: len(list_filter(expected, lambda w: contains(n, w))) > 0), true), 0) AS spot FROM ex),
res AS (SELECT case_id, type, difficulty, missed, unexpected, CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE (len(expected) - len(missed))::DOUBLE / len(expected) END AS hit, CASE WHEN spot > 0 THEN 1.0::DOUBLE / spot ELSE 0.0::DOUBLE END AS rr,
  CASE WHEN len(must_not) = 0 THEN 0.0::DOUBLE ELSE len(unexpected)::DOUBLE / len(must_not) END AS noise FROM ev)"""


def results(spark, sf_dir):
    none = F.array().cast("array<string>")
    listed = view(spark, sf_dir, "cand_fx").groupBy(F.col("request_id").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("l"), F.first("style").alias("type"), F.first("days").alias("days"))
    top = F.transform("l", lambda x: x["name"])
    kind = F.col("case_id") % 4
    cases = listed.select(
        "case_id", top.alias("top_names"), "type", F.when(F.col("days") <= 2, "easy").when(F.col("days") <= 5, "medium").otherwise("hard").alias("difficulty"),
        F.when(kind == 0, none).when(kind == 1, F.array(F.lit("cold bolt"), F.lit("no such place"))).otherwise(F.array(F.get(top, F.lit(2)), F.lit("hot bolt"), F.lit("red ring"), F.lit("none"))).alias("expected"),
        F.when(F.col("case_id") % 3 == 0, F.array(F.lit("large"), F.lit("nowhere"))).otherwise(none).alias("must_not"),
    )
    return evaluate.evaluate_cases(cases)


def _measure(name: str, column: str):
    query(oracle(f"{_CASES} SELECT case_id, round({column}, 6) AS {column} FROM res", "cand_fx"), name=name)(lambda spark, sf_dir: results(spark, sf_dir).select("case_id", F.round(column, 6).alias(column)))


for _name, _column in (("eval_hit", "hit"), ("eval_rr", "rr"), ("eval_noise", "noise")):
    _measure(_name, _column)


@query(oracle(f"{_CASES} SELECT case_id, array_to_string(missed, '|') AS missed, array_to_string(unexpected, '|') AS unexpected FROM res", "cand_fx"))
def eval_case_detail(spark, sf_dir):
    return results(spark, sf_dir).select("case_id", F.array_join("missed", "|").alias("missed"), F.array_join("unexpected", "|").alias("unexpected"))


_AGG = """, ag AS (SELECT 'overall' AS "by", 'all' AS value, count(*) AS n, avg(hit) AS hit_rate, avg(rr) AS mrr, avg(noise) AS noise_rate FROM res
UNION ALL SELECT 'type', type, count(*), avg(hit), avg(rr), avg(noise) FROM res GROUP BY type UNION ALL SELECT 'difficulty', difficulty, count(*), avg(hit), avg(rr), avg(noise) FROM res GROUP BY difficulty)"""


@query(oracle(f"""{_CASES}{_AGG} SELECT "by", value, n, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr, round(noise_rate, 6) AS noise_rate FROM ag""", "cand_fx"))
def eval_aggregate(spark, sf_dir):
    return evaluate.aggregate(results(spark, sf_dir)).select("by", "value", "n", *(F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "noise_rate")))


@query(oracle(f"""{_CASES} SELECT 'hit' AS kind, case_id, round(hit, 6) AS value FROM (SELECT * FROM res ORDER BY hit, case_id LIMIT 3)
UNION ALL SELECT 'noise', case_id, round(noise, 6) FROM (SELECT * FROM res WHERE noise > 0 ORDER BY noise DESC, case_id LIMIT 3)""", "cand_fx"))
def eval_worst_cases(spark, sf_dir):
    return evaluate.worst_cases(results(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(oracle(f"""{_CASES}{_AGG} SELECT 40 AS top_k, max(n) AS n, max(round(hit_rate, 4)) FILTER ("by" = 'overall') AS hit_rate, max(round(mrr, 4)) FILTER ("by" = 'overall') AS mrr, count(*) FILTER ("by" = 'type') AS n_types, count(*) FILTER ("by" = 'difficulty') AS n_difficulties FROM ag""", "cand_fx"))
def eval_report(spark, sf_dir):
    """The report's JSON texts, read back."""
    kind = "map<string,struct<n:long,hit_rate:double,mrr:double,noise_rate:double>>"
    made = evaluate.report(results(spark, sf_dir), 40)
    whole = F.element_at(F.from_json("overall", kind), "all")
    return made.select("top_k", whole["n"].alias("n"), whole["hit_rate"].alias("hit_rate"), whole["mrr"].alias("mrr"), F.size(F.from_json("by_type", kind)).cast("long").alias("n_types"), F.size(F.from_json("by_difficulty", kind)).cast("long").alias("n_difficulties"))
