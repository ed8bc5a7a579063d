"""BM25 over postings in blocks: exact top-k that reads only the blocks whose bound can still matter, and an index that grows by batches.

Documents are dealt to small ranges of one group (a city) and about one length. A block holds the
postings of one term in one range, with the largest count and the least length in it, which bound
the term's part of a score there whatever the corpus averages become. For a query the bounds of a range's
blocks are summed; its best ranges are scored first, their k-th score is the threshold, and of the other
ranges only those whose bound reaches it are scored. The result equals scoring everything.

The index is a family of segments, written once. A batch of documents becomes a segment of its own;
segments of one size class are merged into one of the next, so a posting is rewritten a logarithmic
number of times. Document frequencies are summed over the segments. A version becomes visible by
one appended row per segment, after all else has been written; what a failed writer leaves is never read.

Defined cases: documents without terms count in the averages, but are never found; a null group is a
group of its own, found only by queries that don't ask for a group; a term asked twice counts twice;
scores of 0 and less are left out; an id that is added again is another document; an empty batch changes nothing.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.config import BM25_B, BM25_EPSILON, BM25_K1
from placeloom.operators.index import ASKED_ROWS, terms_of
from placeloom.session import written

#: Documents of a range, ranges that are scored first, growth of lengths within a range, and how much segments of a size class may differ.
RANGE_DOCS, FIRST, LENGTHS, CLASS = 64, 2, 1.3, 4
MANIFEST = "version int, segment string, docs long, total long, bigrams boolean, `words` boolean"
SLACK = 2e-6  # scores are rounded to six places


@dataclass(frozen=True)
class BlockIndex:
    """blocks (term, range, group, n, most, least, postings), terms (term, df, idf), the number of documents and their mean length, and how texts were cut."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    mean: float
    bigrams: bool
    lexicon: DataFrame | None


def _segments(spark: SparkSession, path: str) -> list:
    """The rows of the newest version; none before the first one."""
    from placeloom.sources.places import exists

    if not exists(spark, f"{path}/manifest"):
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()  # a row per segment and version
    last = max((r.version for r in rows), default=0)
    return [r for r in rows if r.version == last]


def _write_blocks(postings: DataFrame, at: str) -> None:
    """Blocks of postings (id, group, term, tf, dl), in the order of terms."""
    lengths = F.floor(F.log(F.col("dl")) / math.log(LENGTHS)).cast("int")
    docs = postings.select("id", "group", "dl").distinct().withColumn("long", lengths)
    counts = docs.groupBy("group", "long").agg(F.ceil(F.count(F.lit(1)) / RANGE_DOCS).cast("int").alias("ranges"))
    name = at.rsplit("/", 1)[-1]
    placed = postings.withColumn("long", lengths).join(F.broadcast(counts.withColumnsRenamed({"group": "_g", "long": "_l"})), F.col("group").eqNullSafe(F.col("_g")) & (F.col("long") == F.col("_l")))
    key = F.xxhash64(F.lit(name), "group", "long", F.pmod(F.xxhash64("id"), F.col("ranges")))
    # Dealt by ranges of terms at once, so the one exchange of postings serves their grouping and the files' order.
    dealt = placed.select("term", key.alias("range"), "group", "id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).repartitionByRange("term")
    blocks = dealt.groupBy("term", "range", "group").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.collect_list(F.struct("id", "tf", "dl")).alias("postings"))
    blocks.sortWithinPartitions("term").write.mode("overwrite").parquet(at)


def _publish(spark: SparkSession, path: str, version: int, rows: list[tuple], bigrams: bool, words: bool, epsilon: float) -> None:
    """Write the terms of a version and then its rows."""
    n = sum(r[1] for r in rows)
    df = _blocks(spark, path, [r[0] for r in rows]).groupBy("term").agg(F.sum("n").alias("df"))
    plain = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(plain.agg(F.avg("raw").alias("mean")))
    terms = plain.join(mean).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/{version}")
    spark.createDataFrame([(version, *r, bigrams, words) for r in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _blocks(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/blocks/{name}") for name in names))


def _class(docs: int) -> int:
    return int(math.log(max(1, docs), CLASS))


def add_documents(docs: DataFrame, path: str, text: str = "text", bigrams: bool = False, lexicon: DataFrame | None = None, group: str | None = None, epsilon: float = BM25_EPSILON) -> BlockIndex:
    """Add a batch of ``docs`` (id and a text) to the index at ``path``, which is begun if there is none; its first batch decides how texts are cut."""
    spark = docs.sparkSession
    held = _segments(spark, path)
    if held:
        bigrams, words = held[0].bigrams, held[0].words
    else:
        words = lexicon is not None
        if words:
            lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
    lexicon = spark.read.parquet(f"{path}/lexicon") if words else None
    name, new = uuid.uuid4().hex, f"{path}/parts"
    of = F.lit(None).cast("string") if group is None else F.col(group)
    # Texts are dealt by id, and their terms are counted where they lie: a text travels once, its postings don't.
    texts = docs.select("id", of.alias("group"), F.col(text).alias("text")).repartition("id")
    each = terms_of(texts, "text", bigrams, lexicon, "id", "group").groupBy("id", "group", "term").agg(F.count(F.lit(1)).alias("tf"))
    each.withColumn("dl", F.sum("tf").over(Window.partitionBy("id"))).write.mode("overwrite").parquet(f"{new}/{name}")
    counted = spark.read.parquet(f"{new}/{name}")
    _write_blocks(counted, f"{path}/blocks/{name}")
    rows = [(r.segment, r.docs, r.total) for r in held] + [(name, docs.count(), counted.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])]
    rows = [r for r in rows if r[1]] or rows[:1]
    while True:
        rows.sort(key=lambda r: (r[1], r[0]))
        same = next((i for i in range(len(rows) - 1) if _class(rows[i][1]) == _class(rows[i + 1][1])), None)
        if same is None:
            break
        two, merged = rows[same : same + 2], uuid.uuid4().hex
        entries = _blocks(spark, path, [r[0] for r in two]).select("group", "term", F.explode("postings").alias("p")).select("p.id", "group", "term", "p.tf", "p.dl")
        _write_blocks(entries, f"{path}/blocks/{merged}")
        rows[same : same + 2] = [(merged, two[0][1] + two[1][1], two[0][2] + two[1][2])]
    _publish(spark, path, max((r.version for r in held), default=0) + 1, rows, bigrams, words, epsilon)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> BlockIndex:
    """The newest version of the index."""
    rows = _segments(spark, path)
    if not rows:
        raise ValueError(f"no index at {path}")
    n, total = sum(r.docs for r in rows), sum(r.total for r in rows)
    lexicon = spark.read.parquet(f"{path}/lexicon") if rows[0].words else None
    return BlockIndex(_blocks(spark, path, [r.segment for r in rows]), spark.read.parquet(f"{path}/terms/{rows[0].version}"), n, total / n if n else 0.0, rows[0].bigrams, lexicon)


def part(tf: Column, dl: Column, mean: float, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """A term's part of a score before its weight: it grows with tf and falls with dl."""
    return tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(mean or 1.0)))


@dataclass(frozen=True)
class Asked:
    """weights (query_id, group, term, weight) of the queries' terms that the index has, written once, and few: broadcast() if they are few."""

    weights: DataFrame
    few: object


def asked_terms(index: BlockIndex, queries: DataFrame, city: bool = False) -> Asked:
    """The terms of ``queries`` (query_id, query[, city]); without ``city`` the group is null and means any."""
    group = (F.col("city") if city else F.lit(None).cast("string")).alias("group")
    each = terms_of(queries.select("query_id", group, "query"), "query", index.bigrams, index.lexicon, "query_id", "group")
    asked = written(each.groupBy("query_id", "group", "term").agg(F.count(F.lit(1)).alias("qtf")))
    few = F.broadcast if asked.count() <= ASKED_ROWS else (lambda df: df)
    return Asked(written(index.terms.join(few(asked), "term").select("query_id", "group", "term", (F.col("qtf") * F.col("idf")).alias("weight"))), few)


def range_bounds(index: BlockIndex, asked: Asked, city: bool = False) -> DataFrame:
    """query_id, range, bound, n: what a score in each range can't exceed, and its asked postings. Postings themselves aren't read."""
    keys = ["term", "group"] if city else ["term"]
    heads = index.blocks.select(*keys, "range", "n", "most", "least").join(asked.few(asked.weights.select("query_id", *keys, "weight")), keys)
    most = F.greatest(F.col("weight"), F.lit(0.0)) * part(F.col("most"), F.col("least"), index.mean)
    return heads.groupBy("query_id", "range").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))


def _scores(index: BlockIndex, asked: Asked, ranges: DataFrame) -> DataFrame:
    """query_id, id, score of all documents in the given ranges (query_id, range)."""
    wanted = asked.weights.select("query_id", "term", "weight").join(ranges, "query_id")
    hits = index.blocks.select("term", "range", "postings").join(asked.few(asked.weights.select("term").distinct()), "term", "left_semi").join(wanted, ["term", "range"])
    each = hits.select("query_id", "weight", F.inline("postings")).select("query_id", "id", (F.col("weight") * part(F.col("tf"), F.col("dl"), index.mean)).alias("score"))
    return each.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def ranges_to_read(index: BlockIndex, asked: Asked, queries: DataFrame, k: int | str, city: bool = False) -> DataFrame:
    """query_id, range, bound, n, read: whether a range has to be scored for the ``k`` best (a number, or a column of ``queries``)."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    ranked = written(range_bounds(index, asked, city).withColumn("_n", order))
    first = _scores(index, asked, ranked.filter(F.col("_n") <= FIRST).select("query_id", "range")).filter("score > 0")
    if isinstance(k, str):
        first = first.join(queries.select("query_id", F.col(k).alias("_k")), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = first.withColumn("_p", place).filter(F.col("_p") == (F.col("_k") if isinstance(k, str) else k)).select("query_id", F.col("score").alias("least"))
    read = (F.col("_n") <= FIRST) | (F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK)
    return ranked.join(least, "query_id", "left").select("query_id", "range", "bound", "n", read.alias("read"))


def top(index: BlockIndex, queries: DataFrame, k: int | str, city: bool = False) -> DataFrame:
    """query_id, id, score, rank of the ``k`` best documents for ``queries`` (query_id, query[, city]), ties by id; with ``city`` among those of the query's group."""
    from placeloom.operators.retrieve import top_k

    asked = asked_terms(index, queries, city)
    reads = ranges_to_read(index, asked, queries, k, city).filter("read").select("query_id", "range")
    scored = _scores(index, asked, reads).withColumn("score", F.round("score", 6)).filter("score > 0")
    if isinstance(k, str):
        scored = scored.join(queries.select("query_id", k), "query_id")
    return top_k(scored, k, F.desc("score"), F.col("id"))
