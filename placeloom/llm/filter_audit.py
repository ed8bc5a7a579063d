"""Filter interaction audit: what each of several filters removes in every order they could be applied in.

One pass over the texts turns every document into a mask of the filters it fails and a fingerprint,
the xxhash64 of its text. Four conditions need the text alone; the fifth, being identical to the
text of any smaller doc_id, is settled among the documents whose fingerprint occurs more than once:
only their texts travel. A map task chains the texts of one fingerprint, keeps of each the smallest
id it has seen, and emits all others at once. What it keeps goes, with the full text, to the
partition that owns the fingerprint, which reads its entries in the order of fingerprints, chains
the different texts of one value, compares them whole and emits the ids that aren't the smallest. A
group of copies of any size thus sends one text from each map task (more if a task has to let go of
its chains, at CHAIN_CHARS characters), and the owner holds one chain at a time: Spark's external
sort spills the rest.

Masks, with the labels joined by doc_id, are counted per part by combineByKey into vectors of
3 x 32 numbers (all, good and toxic documents of each mask), from which every order's steps follow
without looking at a document again.

Defined cases: a null text counts as empty, and empty texts are equal; a null lang is the part of
the empty string; a null doc_id is larger than any other, and has no labels; rows repeated under one
doc_id count as often as they stand there and don't make each other copies (their verdicts are told apart by fingerprint); a document is good
(toxic) if any row of its labels says so; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from placeloom.llm.common import counted_broadcast, documents, scratch

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = re.compile(r"[#$%&*|]").search
CAPITALS = re.compile(r"[A-Z]+").findall
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Characters of texts that a map task chains before it sends what it holds and begins anew.
CHAIN_CHARS = 32_000_000


def text_mask(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    words = WORDS(text)
    n = len(words)
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * sum(map(len, CAPITALS(text))) > MAX_CAPITALS * len(text)) << 2 | (SYMBOLS(text) is not None) << 3


def smaller(a: object, b: object) -> bool:
    """Whether id ``a`` comes before id ``b``; a null one comes last."""
    return a is not None and (b is None or a < b)


class Chains:
    """The different texts of each fingerprint with the smallest id of each. ``add`` returns the id that turns out to be of a copy."""

    def __init__(self) -> None:
        self.of: defaultdict[int, dict[str, object]] = defaultdict(dict)  # a chain is searched by whole texts
        self.chars = 0

    def add(self, key: int, text: str, doc_id: object) -> list:
        chain = self.of[key]
        if text not in chain:
            chain[text] = doc_id
            self.chars += len(text)
            return []
        if chain[text] == doc_id:
            return []
        if smaller(doc_id, chain[text]):
            chain[text], doc_id = doc_id, chain[text]
        return [doc_id]

    def entries(self) -> Iterator[tuple]:
        for key, chain in self.of.items():
            yield from ((key, x) for x in chain.items())


def _send(rows: Iterable) -> Iterator[tuple]:
    """Of (h, text, doc_id): the chains' entries (h, (text, doc_id)) and, without a text, the ids of copies; these are dealt out evenly."""
    chains, settled = Chains(), 0
    for key, text, doc_id in rows:
        for copy in chains.add(key, text, doc_id):
            settled += 1
            yield hash((copy, settled)), (None, (copy, key))
        if chains.chars > CHAIN_CHARS:
            yield from chains.entries()
            chains = Chains()
    yield from chains.entries()


def _own(entries: Iterable) -> Iterator[tuple]:
    """(doc_id, h) of the copies of a partition whose entries come in the order of fingerprints."""
    for key, group in groupby(entries, lambda e: e[0]):
        chains = Chains()
        for _, (text, x) in group:
            if text is None:
                yield x
            else:
                yield from ((copy, key) for copy in chains.add(key, text, x))


def copies(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, h of the rows of ``docs`` (doc_id, text, h) whose text a smaller id has; ``repeated`` has the fingerprints to look at."""
    rows = docs.join(counted_broadcast(repeated), "h", "left_semi").select("h", "text", "doc_id").rdd
    partitions = max(rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = rows.mapPartitions(_send).repartitionAndSortWithinPartitions(partitions, lambda key: key % partitions).mapPartitions(_own)
    kinds = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("h", LongType())])
    return docs.sparkSession.createDataFrame(owned, kinds, verifySchema=False)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], b["h"], pa.array([text_mask(x.as_py()) for x in b["text"]], pa.int32())], ["doc_id", "part", "h", "mask"])

    alone = scratch(docs.mapInArrow(judged, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, h long, mask int"), "masks")
    repeated = scratch(alone.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    again = copies(docs.select("doc_id", "text", "h"), repeated).distinct().select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    mask = F.when(F.col("_h").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(COPY)))
    return alone.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "part", mask.alias("mask"))


def _count(vector: list[int], seen: tuple[int, int, int, int]) -> list[int]:
    mask, good, toxic, n = seen
    vector[mask] += n
    vector[MASKS + mask] += n * good
    vector[2 * MASKS + mask] += n * toxic
    return vector


def mask_counts(masked: DataFrame, labels: DataFrame):
    """An RDD of (part, vector): for all, the good and the toxic documents, the number of each mask."""
    label = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = masked.join(label, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).count()
    pairs = known.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda seen: _count([0] * 3 * MASKS, seen), _count, lambda a, b: [x + y for x, y in zip(a, b)])


def steps(part: str, vector: list[int]) -> Iterator[tuple]:
    """The 600 rows of a part: every order of the filters, step by step."""
    all_, good, toxic = (vector[i : i + MASKS] for i in range(0, 3 * MASKS, MASKS))
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = len(list(permutations(FILTERS)))
    # Of the filters that a document fails each is the first in as many orders as any other.
    share = {f: sum(n * orders // m.bit_count() for m, n in enumerate(all_) if m & b) for f, b in bits.items()}
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order, 1):
            now = [m for m in range(MASKS) if m & bits[f] and not m & before]
            late = sum(all_[m] for m in range(MASKS) if m & bits[f] and m & before)
            before |= bits[f]
            kept = sum(n for m, n in enumerate(all_) if not m & before)
            yield part, "".join(order), i, kept, sum(all_[m] for m in now), late, all_[bits[f]], sum(good[m] for m in now), sum(toxic[m] for m in now), share[f]


SCHEMA = StructType([StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType()), *(StructField(c, LongType()) for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split())])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step with the counts of documents kept, removed, failing but removed before, failing nothing else, good ones and toxic ones lost, and the filter's removals over all orders."""
    rows = mask_counts(masks(docs), labels).flatMap(lambda x: steps(*x))
    return docs.sparkSession.createDataFrame(rows, SCHEMA, verifySchema=False)


def op11_filter_audit(spark, sf_dir):
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
      regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), t.doc_id IS NULL AND min(t.doc_id) OVER (PARTITION BY text) IS NOT NULL) AS e FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
      count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT o, i::INT AS step, o[i] AS f, o[1:i - 1] AS before FROM o, range(1, 6) g(i)),
x AS (SELECT part, o, step, f, n, good, toxic, fails, contains(fails, f) AS mine, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM m, s),
z AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mine AND NOT gone), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (mine AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (mine AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mine AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM z
"""
