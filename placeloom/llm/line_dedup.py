"""Line deduplication by a log-template tree, with built-in functions only.

A line's way down the tree is fixed: first by its number of tokens, then by its leading tokens,
where tokens with digits count as the field ``<*>``. Only leaves that lines of enough documents
reach are looked at further. In such a leaf, a token that too few documents have at its place is a
field as well, so lines that differ in variable words fall under one template, provided that enough
of their tokens are constant; otherwise a line stays its own template. Too few is fewer than
MIN_DOCS, and fewer than CONSTANT_OF of the documents that have the line's constant tokens (as many
of its most frequent tokens as a template needs), so a variable word stays a field however large the
table is. A template that recurs in enough documents is dropped from all of them but the first
(smallest doc_id), which keeps the corpus from losing what the copies say. Order of rows and
partitions doesn't matter. OP2_SQL knows only the limit of MIN_DOCS: what it drops is dropped here
too, and more where a variable word's values recur in MIN_DOCS documents each.

Lines travel as 64-bit hashes of their leaf and of themselves; a hot line is pre-aggregated on the
map side, and templates (one row each, counted) go to the lines by broadcast, or by equi-joins,
which Spark may split where a key is hot.

Defined cases: a null text stays null and has no lines; lines of fewer than MIN_TOKENS tokens,
blank ones among them, always stay; doc_id identifies a document, so rows repeated under one
doc_id are one document and lose the same lines; a null doc_id is a document of its own, last in
order; an empty table gives an empty result; columns of the input stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import BROADCAST_ROWS, SPACE, counted_broadcast, documents, laid_out, scratch, set_aside

FIELD = "<*>"
#: Leading tokens that lead to a leaf, tokens of the shortest line looked at, documents a template recurs in,
#: tokens from which words may become fields, and the constant share a template then needs.
DEPTH, MIN_TOKENS, MIN_DOCS, MIN_GENERAL, MIN_CONSTANT = 3, 3, 5, 6, 0.75
#: The share that a constant token has, at least, of the documents of a line's MIN_CONSTANT most frequent tokens.
CONSTANT_OF = 0.5


def masked_lines(text: Column) -> Column:
    """The lines of a text with single blanks between their tokens, and fields for tokens with digits.

    Regular expressions run only on lines that have something for them.
    """

    def plain(x):
        odd = F.contains(x, F.lit("  "))
        for space in "\t\x0b\x0c\r":
            odd = odd | F.contains(x, F.lit(space))
        return F.trim(F.when(odd, F.regexp_replace(x, SPACE, " ")).otherwise(x))

    def fields(x):
        return F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(x)

    return F.transform(F.transform(F.split(text, "\n"), plain), fields)


def n_tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1)


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def leaf_key(line: Column) -> Column:
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", DEPTH), F.lit("leaf"))


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("doc_id", F.explode(masked_lines(F.col("text"))).alias("line"))
    return each.filter(n_tokens(F.col("line")) >= MIN_TOKENS)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, key: the lines to drop of each document."""
    slim = scratch(_lines(docs).select("doc_id", leaf_key(F.col("line")).alias("leaf"), line_key(F.col("line")).alias("key")).distinct(), "lines")
    docs_of_leaf = slim.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    live = counted_broadcast(scratch(docs_of_leaf.filter(F.col("n") >= min_docs).select("leaf"), "live-leaves"))
    slim = scratch(slim.join(live, "leaf", "left_semi"), "live-lines")
    # The texts of the distinct lines in live leaves.
    texts = _lines(docs).select(leaf_key(F.col("line")).alias("leaf"), line_key(F.col("line")).alias("key"), "line")
    texts = texts.join(live, "leaf", "left_semi").distinct()
    counted = texts.join(slim.groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("n_docs")), ["leaf", "key"])
    counted = scratch(counted, "distinct-lines")
    general = counted.filter(n_tokens(F.col("line")) >= MIN_GENERAL)
    tokens = general.select("leaf", "key", "n_docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.sum("n_docs").alias("n")).filter((F.col("n") >= min_docs) & (F.col("token") != FIELD))
    seen = tokens.drop("n_docs").join(constant, ["leaf", "at", "token"], "left")
    made = seen.groupBy("leaf", "key").agg(F.sort_array(F.collect_list(F.struct("at", "token", "n"))).alias("shape"))
    # The documents of the last token that a line needs as a constant; null if it has too few such tokens.
    level = F.get(F.sort_array(F.transform("shape", lambda t: t["n"]), asc=False), (F.ceil(MIN_CONSTANT * F.size("shape")) - 1).cast("int"))
    made = made.withColumn("level", level).filter("level IS NOT NULL")
    words = F.transform("shape", lambda t: F.when(t["n"] >= CONSTANT_OF * F.col("level"), t["token"]).otherwise(FIELD))
    made = made.select("leaf", "key", F.array_join(words, " ").alias("made"))
    # A line that isn't general enough is its own template.
    templates = counted.join(made, ["leaf", "key"], "left").select("leaf", "key", F.xxhash64("leaf", F.coalesce("made", "line")).alias("template"))
    templates = counted_broadcast(scratch(templates, "templates"))
    placed = scratch(slim.join(templates, ["leaf", "key"]), "placed")
    per = placed.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    per = counted_broadcast(scratch(per.filter(F.col("n") >= min_docs), "recurring"))
    hot = placed.join(per, "template")
    return hot.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "key")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines of recurring templates, with n_lines and n_dropped."""
    columns, needed = docs.columns, ("doc_id", "text")
    docs = set_aside(docs, *needed)
    drops = scratch(recurring_lines(docs, min_docs), "drops")
    few = drops.count() <= BROADCAST_ROWS
    # A document's lines to drop, dealt to short lists by their keys, so that each of its lines looks into one of them.
    parts = F.least(F.lit(1024), F.ceil(F.size("_keys") / 8)).cast("int")
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("_keys"))
    drops = drops.select(F.col("doc_id").alias("_id"), F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.filter("_keys", lambda k: F.pmod(k, parts) == i)).alias("_drop"))
    joined = docs.join(F.broadcast(drops) if few else drops, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")
    lines = F.split("text", "\n")
    looked_at = F.transform(masked_lines(F.col("text")), lambda m: F.when(n_tokens(m) >= MIN_TOKENS, line_key(m)))
    known = F.transform(looked_at, lambda k: k.isNull() | ~F.array_contains(F.get("_drop", F.pmod(k, F.size("_drop")).cast("int")), k))
    chosen = F.filter(F.zip_with(lines, known, lambda x, k: F.when(k, x)), lambda x: x.isNotNull())
    left = F.when(F.col("_drop").isNull(), lines).otherwise(chosen)
    joined = joined.withColumn("_left", left)
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    left_n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_left")).cast("long")
    return laid_out(joined, columns, needed, n_lines=n, n_dropped=n - left_n, text=F.array_join("_left", "\n"))


def op2_line_dedup(spark, sf_dir):
    out = drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP2_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, raw, regexp_replace(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS line FROM l),
n AS (SELECT *, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n, array_to_string(string_split(line, ' ')[1:{DEPTH}], ' ') AS lead FROM m),
live AS (SELECT n, lead FROM n WHERE n >= {MIN_TOKENS} GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
d AS (SELECT n, lead, line, count(DISTINCT doc_id) AS docs FROM n SEMI JOIN live USING (n, lead) GROUP BY ALL),
t AS (SELECT n, lead, line, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS pos FROM d WHERE n >= {MIN_GENERAL}),
k AS (SELECT n, lead, pos, token FROM t WHERE token <> '{FIELD}' GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT t.n, t.lead, t.line, string_agg(coalesce(k.token, '{FIELD}'), ' ' ORDER BY t.pos) AS made
      FROM t LEFT JOIN k ON t.n = k.n AND t.lead = k.lead AND t.pos = k.pos AND t.token = k.token GROUP BY ALL HAVING count(k.token) >= {MIN_CONSTANT} * count(*)),
p AS (SELECT n.doc_id, n.i, d.n, d.lead, coalesce(g.made, d.line) AS template FROM n JOIN d USING (n, lead, line) LEFT JOIN g USING (n, lead, line)),
r AS (SELECT n, lead, template, min(doc_id) AS first FROM p GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
x AS (SELECT doc_id, i FROM p JOIN r USING (n, lead, template) WHERE doc_id <> first)
SELECT n.doc_id, count(*)::BIGINT AS n_lines, count(x.i)::BIGINT AS n_dropped, sha256(coalesce(string_agg(raw, chr(10) ORDER BY n.i) FILTER (x.i IS NULL), '')) AS text_sha256
FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.i = x.i GROUP BY n.doc_id
"""
