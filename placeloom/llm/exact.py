"""Exact deduplication over an extendible-hash index on shared files, with built-in functions only.

Texts are equal when they are identical without ASCII white space. The index is a set of buckets
of keys (64-bit hashes of normalised texts). The directory begins with as many cells, by the
leading bits of a hash, as the count of keys calls for; as long as a bucket is overfull, the
directory doubles and the keys of such buckets are split by the next bit, so each bucket has a
depth of its own and stands for a contiguous range of keys. No depth is fixed: only a bucket whose
keys are all one hash can't be split, and its texts become a longer chain. Capacity grows with the
number of keys beyond MAX_BUCKETS buckets of CAPACITY, so the directory stays small enough to be
broadcast (it is counted before). Copies count as one key: a text that a third of all rows share
doesn't split anything.

Rows are sent to the owners of their buckets: an owner task compares the normalised bytes of the
texts that share a hash, which settles who is equal, who stays and how many there are; different
texts of one hash are linked into a chain. Copies of texts with more than COPIES copies are put
together ahead of that, on the map side, so no owner meets them one by one. The owners write the
index to the shared folder, and each row reads its verdict from its entry there, by hash and digest.

Defined cases: a null text counts as empty, and empty texts are equal; doc_id identifies a row,
so rows repeated under one doc_id share their verdict; null doc_ids come last among ties and are
kept only if the whole group has none; doc_id may be of any type that can be ordered; columns other
than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from placeloom.llm.common import SPACE, counted_broadcast, documents, save, scratch

#: Keys a bucket holds before it is split, buckets from which that number grows, and copies of a text that are put together ahead.
CAPACITY, MAX_BUCKETS, COPIES = 2_000, 100_000, 1_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def cell_of(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """bucket, low, high (its keys' range), depth, n_keys and home (its cell when the directory began), and the depth it began with.

    ``keys`` has distinct hashes (h). A bucket's number is its lowest key. Only counts reach the driver.
    """
    n = keys.count()
    began = depth = max(0, math.ceil(math.log2(max(1, n / capacity))))
    settled = []
    while True:
        cells = save(keys.groupBy(cell_of(F.col("h"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n_keys"), F.min("h").alias("low"), F.max("h").alias("high")), "cells").df
        overfull = (F.col("n_keys") > capacity) & (F.col("low") != F.col("high"))
        settled.append(cells.filter(~overfull).select(F.col("low").alias("bucket"), "low", "high", F.lit(depth).alias("depth"), "n_keys", cell_of(F.col("low"), began).alias("home")))
        split = cells.filter(overfull).select("cell")
        if not split.count():
            return scratch(reduce(DataFrame.union, settled), "directory"), began
        keys = keys.join(counted_broadcast(split), cell_of(F.col("h"), depth) == F.col("cell"), "left_semi")
        depth += 1


def exact_dedup(docs: DataFrame, capacity: int | None = None, copies: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, keep_id, group_size, kept, text_sha256), and the index it was found in.

    Of equal texts the one of most code points stays, then the one of the smallest doc_id.
    """
    text = normalised(F.col("text"))
    entries = scratch(docs.select("doc_id", F.xxhash64(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("text_sha256")), "entries")
    keys = save(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "keys")
    buckets, began = directory(keys.df.select("h"), capacity or max(CAPACITY, keys.df.count() // MAX_BUCKETS))
    length, doc_id = F.length(F.coalesce("text", F.lit(""))), F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        # A number that orders by code points and then by falling doc_id, of a type that hash aggregation holds in place.
        rank = length.cast("decimal(10,0)") * F.lit(Decimal(2**64)) - doc_id.cast("decimal(20,0)")
        best = lambda: (F.max_by("keep_id", "rank").alias("keep_id"), F.max("rank").alias("rank"))
    else:
        rank = F.struct((-length).alias("l"), doc_id.isNull().alias("z"), doc_id.alias("d"))
        best = lambda: (F.min_by("keep_id", "rank").alias("keep_id"), F.min("rank").alias("rank"))
    rows = docs.select(text.alias("bytes"), F.lit(1).cast("long").alias("group_size"), doc_id.alias("keep_id"), rank.alias("rank")).withColumn("h", F.xxhash64("bytes"))
    hot = save(keys.df.filter(F.col("n") > copies).select("h"), "hot-keys").df
    if hot.count():
        hot = counted_broadcast(hot)
        together = rows.join(hot, "h", "left_semi").groupBy("h", "bytes").agg(F.sum("group_size").alias("group_size"), *best())
        rows = rows.join(hot, "h", "left_anti").unionByName(together)
    owner = counted_broadcast(buckets.select("bucket", "low", "high", "home"))
    placed = rows.join(owner, (cell_of(F.col("h"), began) == F.col("home")) & F.col("h").between(F.col("low"), F.col("high")))
    owned = placed.select("bucket", "h", "bytes", "group_size", "keep_id", "rank").repartition("bucket")
    texts = owned.groupBy("bucket", "h", "bytes").agg(F.sum("group_size").alias("group_size"), *best())
    texts = texts.select("bucket", "h", F.sha2(F.col("bytes").cast("binary"), 256).alias("text_sha256"), "group_size", "keep_id")
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    index = scratch(texts.withColumn("link", F.row_number().over(chain)), "index")
    keys.drop()
    found = entries.join(index.select("h", "text_sha256", "group_size", "keep_id"), ["h", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"), index


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))[0]


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""
