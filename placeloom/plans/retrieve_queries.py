"""Queries of retrieval: tokens, BM25, vectors, fusion, hybrid search; many queries in one job.

The corpus is ``documents`` (its language plays the city) with ``embeddings`` of the same ids. The
queries are all passages of ``benchmark``, each with the vector of its number; a search by vector
alone asks for every vector whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import cells, impact, index, retrieve, segment
from placeloom.plans import build_queries as build
from placeloom.plans.fixtures import oracle, table, view
from placeloom.plans.registry import registry
from placeloom.session import new_folder, written

QUERIES, ORACLE_SQL, query = registry()

_CITY = "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"



def _index(docs: str, terms: str) -> str:
    """The index of documents (id, text, city) whose texts ``terms`` cuts into a list."""
    return rf"""WITH doc_fx AS ({docs}),
tok AS MATERIALIZED (SELECT id, {terms.format("text")} AS terms FROM doc_fx),
post AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM tok) GROUP BY ALL),
dl AS MATERIALIZED (SELECT id, len(terms) AS dl FROM tok), s AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), s),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw))"""


def _scored(index_sql: str, queries: str, terms: str) -> str:
    return rf"""{index_sql}, q AS ({queries}),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms.format('query')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, id, score FROM (SELECT query_id, post.id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN dl ON post.id = dl.id, s GROUP BY ALL) WHERE score > 0)"""


_INDEX = _index("SELECT doc_id AS id, coalesce(text, '') AS text, lang AS city FROM documents", _TERMS)
_BM25 = _scored(_INDEX, f"SELECT item_id AS query_id, text AS query, {_CITY} AS city FROM benchmark", _TERMS)

# Names of parts with each letter as an ideograph of its own; a run of ideographs is cut into pairs.
_LETTERS, _IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz", "江湖楼阁山水园林寺塔街巷桥岛城门宫殿书院洞天峰泉谷滩"
_PAIRS_OF = r"flatten(list_transform(regexp_extract_all(lower({}), '\p{{Han}}+|[a-z0-9]+'), lambda w: CASE WHEN regexp_full_match(w, '\p{{Han}}{{2,}}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END))"
_NAMED = f"translate(replace(p_name, ' ', ''), '{_LETTERS}', '{_IDEOGRAPHS}') || ' ' || p_size || 'm' || lower(substr(p_brand, 1, 5))"
_NAMES = f"SELECT p_partkey AS id, {_NAMED} AS text FROM part"
# The stated queries: a part of a run, of every 50th name.
_PART_OF = "SELECT id AS query_id, substr(text, 2, 4) AS query FROM doc_fx WHERE id % 50 = 0"

_L2 = "round(list_sum(list_transform(list_zip(v.embedding, {}), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))), 9)"


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("city"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def asked(spark, sf_dir):
    """query_id, query, city, vector of all benchmark passages."""
    q = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query", f"{_CITY} AS city")
    return q.join(vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


@query(rf"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    each = corpus(spark, sf_dir).select("id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per = each.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"{_INDEX} SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM terms, s")
def bm25_index_stats(spark, sf_dir):
    made = index.bm25_index(corpus(spark, sf_dir))
    return made.terms.join(F.broadcast(made.sums)).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_NAMED} AS text")


@query(f"SELECT id, term, count(*) AS n FROM (SELECT id, unnest({_PAIRS_OF.format('text')}) AS term FROM ({_NAMES})) GROUP BY ALL")
def tokenize_ideographs(spark, sf_dir):
    each = _names(spark, sf_dir).select("id", F.explode(T.tokens(F.col("text"), bigrams=True)).alias("term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_scored(_index(_NAMES, _PAIRS_OF), _PART_OF, _PAIRS_OF)} SELECT query_id, id, score FROM bm")
def bm25_ideographs(spark, sf_dir):
    names = _names(spark, sf_dir)
    made = index.bm25_index(names, bigrams=True)
    return index.bm25_scores(made, names.filter("id % 50 = 0").selectExpr("id AS query_id", "substr(text, 2, 4) AS query"))


#: Indexes that this application has written, by kind and by what the files of their table were.
_WRITTEN: dict[tuple, str] = {}


def _index_of(spark, kind, rows, write):
    """Where the index of ``rows`` is: written on first use into the shared folder, and anew whenever the files that rows come from differ."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, kind, *sorted(map(tuple, files.collect())))  # a row per file of the table
    if key not in _WRITTEN:
        at = f"{new_folder(spark)}/{kind}"
        write(rows, at)
        _WRITTEN[key] = at
    return _WRITTEN[key]


def _blocks(spark, sf_dir):
    """The BM25 index in blocks over all documents."""
    return impact.read(spark, _index_of(spark, "bm25", corpus(spark, sf_dir), lambda rows, at: impact.add_documents(rows, at, group="city")))


def _cells(spark, sf_dir):
    """The index of all vectors in inverted lists."""
    return cells.read_cells(spark, _index_of(spark, "cells", vectors(spark, sf_dir), cells.write_cells))


# Words of ideographs: two words of parts are unknown; pieces across the border of a name's two words are listed, too.
_HAN = f"translate({{}}, '{_LETTERS}', '{_IDEOGRAPHS}')"
_LEXICON = f"""SELECT word, cast(sum(n) AS bigint) AS freq FROM (SELECT {_HAN.format('w')} AS word, 5 * count(*) AS n FROM (SELECT split_part(p_name, ' ', 1) AS w FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part) a WHERE w NOT IN ('gizmo', 'anvil', '') GROUP BY w
  UNION ALL SELECT {_HAN.format("substr(replace(p_name, ' ', ''), 3, 3)")}, count(*) FROM part GROUP BY substr(replace(p_name, ' ', ''), 3, 3)
  UNION ALL SELECT {_HAN.format("substr(p_name, 1, 1)")}, count(*) FROM part GROUP BY substr(p_name, 1, 1)) b GROUP BY word"""


def lexicon(spark, sf_dir):
    return spark.sql(_LEXICON.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def _whole(p: str) -> str:
    """A weight in whole millionths of a logarithm."""
    return f"round(ln({p}) * 1000000)::BIGINT"


# All ways to cut a run into listed words and single characters, and all ways to cut what is left of it into words of any length.
_CUT = rf""", lex AS (SELECT word, sum(freq)::DOUBLE AS freq, length(word) AS n FROM ({_LEXICON}) GROUP BY word),
tot AS (SELECT sum(freq) AS t, coalesce(sum(freq) FILTER (n = 1), 0) AS ones, coalesce(sum(freq * (n - 3)) FILTER (n > 2), 0) AS inn, coalesce(sum(freq) FILTER (n > 2), 0) AS lng FROM lex),
run AS (SELECT DISTINCT r.piece, r.run, length(r.run) AS m, r.id FROM (SELECT id, unnest(regexp_extract_all(lower(text), '\p{{Han}}+|[a-z0-9]+')) AS run, generate_subscripts(regexp_extract_all(lower(text), '\p{{Han}}+|[a-z0-9]+'), 1) - 1 AS piece FROM doc_fx) r),
han AS MATERIALIZED (SELECT DISTINCT run, m FROM run WHERE regexp_full_match(run, '\p{{Han}}+')),
edge AS MATERIALIZED (SELECT run, a.p, k.k, {_whole("coalesce(freq, 1) / t")} AS w FROM han, range(0, 40) a(p), range(1, 13) k(k), tot LEFT JOIN lex ON lex.word = substr(run, (a.p + 1)::INT, k.k::INT) WHERE a.p + k.k <= m AND (k.k = 1 OR freq IS NOT NULL)),
way AS (SELECT run, 0::BIGINT AS p, 0::BIGINT AS w, []::BIGINT[] AS cut FROM han UNION ALL SELECT way.run, way.p + k, way.w + edge.w, list_append(cut, k) FROM way JOIN edge ON way.run = edge.run AND way.p = edge.p),
best AS (SELECT run, cut FROM (SELECT way.run, cut, row_number() OVER (PARTITION BY way.run ORDER BY w DESC, cut DESC) AS i FROM way JOIN han ON way.run = han.run AND p = m) WHERE i = 1),
wd AS (SELECT run, i, cut[i] AS n, list_sum(cut[1:i]) - cut[i] AS start FROM best, range(1, 40) r(i) WHERE i <= len(cut)),
one AS (SELECT run, min(start) AS start, count(*) AS n FROM (SELECT *, start - row_number() OVER (PARTITION BY run ORDER BY start) AS g FROM wd WHERE n = 1) GROUP BY run, g),
unk AS (SELECT *, substr(run, (start + 1)::INT, n::INT) AS piece FROM one WHERE n > 1),
ch AS (SELECT c, s, sum(freq) AS f FROM (SELECT substr(word, (i + 1)::INT, 1) AS c, CASE WHEN n = 1 THEN 3 WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 2 ELSE 1 END AS s, freq FROM lex, range(0, 12) r(i) WHERE i < n) GROUP BY ALL),
kinds AS (SELECT count(DISTINCT c) AS v FROM ch), held AS (SELECT s.s, coalesce(sum(f), 0) AS f FROM range(0, 4) s(s) LEFT JOIN ch ON ch.s = s.s GROUP BY s.s),
pc AS (SELECT DISTINCT piece, length(piece) AS m FROM unk), spot AS (SELECT DISTINCT piece, i, substr(piece, (i + 1)::INT, 1) AS c FROM pc, range(0, 40) r(i) WHERE i < m),
emit AS MATERIALIZED (SELECT piece, i, held.s, {_whole("(coalesce(ch.f, 0) + 0.5::DOUBLE) / (held.f + 0.5::DOUBLE * (v + 1))")} AS w FROM spot CROSS JOIN held CROSS JOIN kinds LEFT JOIN ch ON ch.c = spot.c AND ch.s = held.s),
odds AS (SELECT (ones + 0.5::DOUBLE) / (t + 1) AS o, (lng + 0.5::DOUBLE) / (t - ones + 1) AS h, (inn + 0.5::DOUBLE) / (inn + lng + 1) AS q FROM tot),
word AS MATERIALIZED (SELECT pc.piece, a.i AS p, k.k, CASE WHEN k.k = 1 THEN {_whole("o")} + e3.w ELSE {_whole("1 - o")} + e0.w + e2.w + CASE WHEN k.k = 2 THEN {_whole("1 - h")} ELSE {_whole("h")} + {_whole("q")} * (k.k - 3) + {_whole("1 - q")} END
    + coalesce((SELECT sum(e1.w) FROM emit e1 WHERE e1.piece = pc.piece AND e1.s = 1 AND e1.i > a.i AND e1.i < a.i + k.k - 1), 0) END AS w
  FROM pc, range(0, 40) a(i), range(1, 40) k(k), odds, emit e0, emit e2, emit e3 WHERE a.i + k.k <= m AND e0.piece = pc.piece AND e0.s = 0 AND e0.i = a.i AND e2.piece = pc.piece AND e2.s = 2 AND e2.i = a.i + k.k - 1 AND e3.piece = pc.piece AND e3.s = 3 AND e3.i = a.i),
hid AS (SELECT piece, 0::BIGINT AS p, 0::HUGEINT AS w, []::BIGINT[] AS cut FROM pc UNION ALL SELECT hid.piece, hid.p + k, hid.w + word.w, list_append(cut, k) FROM hid JOIN word ON hid.piece = word.piece AND hid.p = word.p),
seen AS (SELECT piece, cut FROM (SELECT hid.piece, cut, row_number() OVER (PARTITION BY hid.piece ORDER BY w DESC) AS i FROM hid JOIN pc ON hid.piece = pc.piece AND p = m) WHERE i = 1),
cw AS (SELECT run, start, n FROM wd WHERE n > 1 UNION ALL SELECT run, start, n FROM one WHERE n = 1 UNION ALL SELECT run, start + list_sum(cut[1:i]) - cut[i], cut[i] FROM unk JOIN seen USING (piece), range(1, 40) r(i) WHERE i <= len(cut)),
term AS MATERIALIZED (SELECT id, piece, start::BIGINT AS start, substr(run, (start + 1)::INT, n::INT) AS term FROM run JOIN cw USING (run) UNION ALL SELECT id, piece, 0, run FROM run WHERE run NOT IN (SELECT run FROM han))"""


@query(f"WITH RECURSIVE doc_fx AS ({_NAMES}){_CUT} SELECT id, piece, start, term FROM term")
def segment_words(spark, sf_dir):
    """Names without spaces, cut into the words of a dictionary counted from the parts; two of the words aren't in it."""
    words = segment.segment(_names(spark, sf_dir), segment.dictionary(lexicon(spark, sf_dir)), "text", "id")
    return words.select("id", F.col("piece").cast("long"), F.col("start").cast("long"), F.col("word").alias("term"))


@query(f"""WITH RECURSIVE doc_fx AS ({_NAMES}){_CUT}, post AS (SELECT term, id, count(*) AS tf FROM term GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), s AS (SELECT (SELECT count(*) FROM doc_fx) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), s), terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw)),
asked AS (SELECT id AS query_id, term, count(*) AS qtf FROM term WHERE id % 50 = 0 GROUP BY ALL),
bm AS (SELECT query_id, post.id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN dl ON post.id = dl.id, s GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= 20""")
def bm25_words(spark, sf_dir):
    """The 20 best names for every 50th one, by words, from an index in blocks that keeps its dictionary and got its names in two batches."""
    names, at = _names(spark, sf_dir), f"{new_folder(spark)}/words"
    impact.add_documents(names.filter("id % 3 > 0"), at, lexicon=lexicon(spark, sf_dir))
    made = impact.add_documents(names.filter("id % 3 = 0"), at)
    return impact.top(made, names.filter("id % 50 = 0").selectExpr("id AS query_id", "text AS query"), 20).select("query_id", "id", "score", "rank")


@query(f"{_BM25} SELECT query_id, id, score FROM bm")
def bm25_scores(spark, sf_dir):
    """All scores, from the plain index as it was written."""
    made = index.Bm25Index.read(spark, _index_of(spark, "postings", corpus(spark, sf_dir), index.write_bm25_index))
    return index.bm25_scores(made, asked(spark, sf_dir))


_BM25_TOP = f"""{_BM25}, bt AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm JOIN doc_fx USING (id) JOIN q USING (query_id) WHERE doc_fx.city = q.city)"""


@query(f"{_BM25_TOP} SELECT query_id, id, score, rank FROM bt WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    top = retrieve.bm25_topk(_blocks(spark, sf_dir), asked(spark, sf_dir), 20, docs)
    return top.select("query_id", "id", "score", "rank")


_PAIRS = f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_L2.format('q.embedding')} AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)"""


def _probes(spark, sf_dir):
    return vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"{_PAIRS} SELECT query_id, id, distance FROM p")
def vector_l2_scores(spark, sf_dir):
    scored = retrieve.vector_distances(vectors(spark, sf_dir), _probes(spark, sf_dir))
    return scored.select("query_id", "id", "distance")


@query(f"{_PAIRS} SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 40")
def vector_topk(spark, sf_dir):
    top = retrieve.vector_topk(vectors(spark, sf_dir), _probes(spark, sf_dir), 40)
    return top.select("query_id", "id", "distance", "rank")


@query()
def vector_topk_cells(spark, sf_dir):
    """The same from inverted lists and product codes; not every true neighbour is found."""
    top = cells.search_cells(_cells(spark, sf_dir), _probes(spark, sf_dir), 40)
    return top.select("query_id", "id", "distance", "rank")


@query("SELECT count(*) AS queries, count(*) * least(40, (SELECT count(*) FROM embeddings)) AS found, true AS recalled, 0 AS inexact FROM embeddings WHERE vec_id % 50 = 0")
def vector_cells_recall(spark, sf_dir):
    """Whether the lists give 40 rows for each query, at least nine tenths of them true neighbours, and all with exact distances."""
    found, true = vector_topk_cells(spark, sf_dir), vector_topk(spark, sf_dir)
    found = written(found)
    both = found.select("query_id", "id").join(vectors(spark, sf_dir), "id").join(_probes(spark, sf_dir), "query_id")
    pairs = both.select("query_id", "id", F.round(retrieve.squared_l2(F.col("embedding"), F.col("vector")), 9).alias("exact"))
    told = found.join(pairs, ["query_id", "id"], "left").join(true.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    count = told.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count_if(~F.col("exact").eqNullSafe(F.col("distance"))).cast("int").alias("inexact"))
    return count.select("queries", "found", (F.col("hits") >= 0.9 * F.col("found")).alias("recalled"), "inexact")


_VECTOR_TOP = f"""{_BM25_TOP}, qv AS (SELECT q.query_id, q.city, e.embedding AS vector FROM q JOIN embeddings e ON q.query_id = e.vec_id),
vt AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM (SELECT query_id, v.vec_id AS id, {_L2.format('qv.vector')} AS distance FROM embeddings v JOIN doc_fx ON v.vec_id = doc_fx.id JOIN qv ON doc_fx.city = qv.city))"""


def _fused(vector_pool: int, bm25_pool: int) -> str:
    return f"""{_VECTOR_TOP}, lists AS (SELECT query_id, id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS part, rank AS vector_rank, NULL::BIGINT AS bm25_rank FROM vt WHERE rank <= {vector_pool}
  UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60.0::DOUBLE + rank), NULL, rank FROM bt WHERE rank <= {bm25_pool}),
fused AS (SELECT query_id, id, sum(part) AS score, min(vector_rank) AS vector_rank, min(bm25_rank) AS bm25_rank FROM lists GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, id) AS rank FROM fused)"""


def _placed(spark, sf_dir):
    """The vectors with the city of their document."""
    return vectors(spark, sf_dir).join(corpus(spark, sf_dir).select("id", "city"), "id")


@query(f"{_fused(50, 20)} SELECT query_id, id, round(score, 6) AS score, vector_rank, bm25_rank, rank FROM ranked")
def rrf_fuse(spark, sf_dir):
    docs, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    near = retrieve.vector_topk(_placed(spark, sf_dir), q, 50, city=True)
    fused = retrieve.rrf_fuse(near, retrieve.bm25_topk(_blocks(spark, sf_dir), q, 20, docs))
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), "vector_rank", "bm25_rank", "rank")


# A search drops the city's name from its query first.
_STRIPPED = f"{_fused(50, 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10".replace("item_id AS query_id, text AS query", f"item_id AS query_id, coalesce(nullif(trim(replace(text, {_CITY}, '')), ''), text) AS query")


@query(_STRIPPED)
def hybrid_search(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    found = retrieve.search(asked(spark, sf_dir), 10, "hybrid", _placed(spark, sf_dir), _blocks(spark, sf_dir), docs)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"{_VECTOR_TOP} SELECT query_id, id, distance, rank FROM vt WHERE rank <= 10")
def search_city_filter(spark, sf_dir):
    top = retrieve.vector_topk(_placed(spark, sf_dir), asked(spark, sf_dir), 10, city=True)
    return top.select("query_id", "id", "distance", "rank")


_ASK = "CASE WHEN id % 3 = 0 THEN city || ' ' || name || ' ' || city WHEN id % 3 = 1 THEN city ELSE name END"


@query(oracle(f", a AS (SELECT id, city, {_ASK} AS query FROM poi_fx) SELECT id, query, CASE WHEN trim(replace(query, city, '')) = '' THEN query ELSE trim(replace(query, city, '')) END AS stripped FROM a", "poi_fx"))
def strip_city(spark, sf_dir):
    named = view(spark, sf_dir, "poi_fx").selectExpr("id", "city", f"{_ASK} AS query")
    return named.select("id", "query", T.strip_city(F.col("query"), F.col("city")).alias("stripped"))


@query(oracle("SELECT request_id, CASE WHEN interests = '' THEN city || ' 景点' ELSE replace(interests, ',', ' ') END AS query FROM cust_fx", "cust_fx"))
def build_query_text(spark, sf_dir):
    return view(spark, sf_dir, "cust_fx").select("request_id", T.query_text(T.split_tags(F.col("interests")), F.col("city")).alias("query"))


@query(oracle(f"""{build._MERGED} SELECT id, CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN name ELSE 'shown ' || id END AS display_name, replace(tags, '|', ',') AS tags, CASE WHEN id % 3 = 0 THEN '' ELSE 'u' || id END AS photos,
  CASE WHEN id % 5 = 0 THEN -1 ELSE rating END AS rating, CASE WHEN id % 7 = 0 THEN -999 ELSE lat END AS lat, lng FROM merged""", "poi_fx"))
def result_accessors(spark, sf_dir):
    key = F.col("id").cast("string")
    stored = build.merged(spark, sf_dir).withColumns({
        "display_name": F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 > 1, F.concat(F.lit("shown "), key)),
        "photos": F.when(F.col("id") % 3 == 0, "not json").otherwise(F.concat(F.lit('["u'), key, F.lit('"]'))),
        "rating": F.when(F.col("id") % 5 != 0, F.col("rating").cast("string")), "lat": F.when(F.col("id") % 7 == 0, "north").otherwise(F.col("lat").cast("string")), "lng": F.col("lng").cast("string"),
    })
    return retrieve.accessors(stored).withColumn("photos", F.array_join("photos", ","))
