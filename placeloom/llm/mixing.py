"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the whole budget. Sources that would need more than
``max_epochs`` passes are clamped there and their excess is dealt to the others by weight, until
no source is above its cap. A source's target is then met by whole repetitions of all its
documents plus a seeded fractional repetition: documents in the order of a seeded digest, the
last one taken in part, so that the words taken equal the rounded target.

Defined cases: a null or empty text has size 0 and is taken 0 times more than nothing; a null
source is a source of its own, last in order; repeated rows each count, and those at the end of a
source's fractional pass share what is left of it; an empty table gives an empty result; input columns named like an output column give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.common import counted_broadcast, documents, laid_out, n_words, scratch, set_aside

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Rows that a part of the seeded order should have about; a source of any size is dealt over many parts.
PART_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_rows, source_size, weight, target: one row per source of ``sizes`` (source, size).

    Weights repeat over the sources in code point order. Only two sums a round reach the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.array(*map(F.lit, weights))
    table = scratch(
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(each, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))),
        "sources",
    )
    cap = F.col("source_size") * F.lit(max_epochs)
    level = 0.0
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        total, clamped, free = table.agg(F.sum("source_size"), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not total or not free:
            break
        if (new := (share * total - clamped) / free) <= level:
            break
        level = new
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _spot(seed: str) -> Column:
    """A document's place in the seeded order of its source."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))


def cuts(sizes: DataFrame, targets: DataFrame, seed: str = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """_source, _all, _target, _whole and where the fractional pass of each source ends: _cut, _cut_size, _cut_words.

    ``sizes`` has doc_id, source, size. The seeded order is cut into parts by its leading digits;
    sums of parts tell in which one a source's pass ends, and only that part (of about
    ``part_rows`` distinct documents, however large the source) is looked at row by row.
    """
    rows = targets.agg(F.sum("source_rows")).first()[0] or 0
    digits = max(0, min(8, math.ceil(math.log(max(1, rows / part_rows), 16))))
    spots = sizes.select(F.col("source").alias("_s"), "size", _spot(seed).alias("_spot")).withColumn("_part", F.substring("_spot", 1, digits))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    known = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_all"), F.col("target").alias("_target"), whole.alias("_whole"))
    known = known.withColumn("_rest", F.round("_target").cast("long") - F.col("_whole") * F.col("_all"))
    parts = spots.groupBy("_s", "_part").agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_before", upto - F.col("_sum")).join(known, F.col("_s").eqNullSafe(F.col("_source")))
    last = parts.filter((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_sum")))
    last = counted_broadcast(scratch(last.select("_source", F.col("_part").alias("_last"), "_before", "_rest"), "last-parts"))
    inside = spots.join(last, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_last")))
    inside = inside.groupBy("_source", "_spot", "size").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    upto = F.col("_before") + F.sum(F.col("_n") * F.col("size")).over(Window.partitionBy("_source").orderBy("_spot", "size").rowsBetween(Window.unboundedPreceding, 0))
    start = F.col("_upto") - F.col("_n") * F.col("size")
    ends = inside.withColumn("_upto", upto).filter((start < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
    ends = ends.select(F.col("_source").alias("_of"), F.col("_spot").alias("_cut"), F.col("size").alias("_cut_size"), F.floor((F.col("_rest") - start) / F.col("_n")).cast("long").alias("_cut_words"))
    return scratch(known.join(ends, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of", "_rest"), "cuts")


def mix(docs: DataFrame, targets: DataFrame, seed: str = SEED, part_rows: int = PART_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, source, size and whatever else) with source_size, target and taken.

    Documents aren't shuffled: each compares its place with the end of its source's pass.
    ``sizes`` may hold the columns doc_id, source and size of ``docs``, written already.
    """
    ends = counted_broadcast(cuts(docs if sizes is None else sizes, targets, seed, part_rows))
    columns, needed = docs.columns, ("doc_id", "source", "size")
    docs = set_aside(docs, *needed).withColumn("_at", _spot(seed)).withColumnRenamed("source", "_mine")
    docs = docs.join(ends, F.col("_mine").eqNullSafe(F.col("_source")))
    size, at, cut = F.col("size"), F.col("_at"), F.col("_cut")
    before = (at < cut) | ((at == cut) & (size < F.col("_cut_size")))
    part = F.when(before, size).when((at == cut) & (size == F.col("_cut_size")), F.col("_cut_words")).otherwise(F.lit(0))
    taken = (F.col("_whole") * size + part).cast("long")
    return laid_out(docs.withColumnRenamed("_source", "_known").withColumnRenamed("_mine", "source"), columns, needed, source_size=F.col("_all"), target=F.col("_target"), taken=taken)


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: documents repeated as often as they are taken, the last time perhaps in part (its first words).

    Rows keep the columns of ``docs``; a document of no words stays once for each whole repetition.
    """
    columns, needed = docs.columns, tuple(c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns)
    sized = set_aside(docs, *needed).withColumn("size", n_words(F.col("text")))
    sizes = scratch(sized.select("doc_id", "source", "size"), "sizes")
    taken = mix(sized, source_targets(sizes), seed, sizes=sizes)
    size, left = F.greatest(F.col("size"), F.lit(1)), F.col("taken")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(left / size).cast("int") - 1)))
    some = taken.filter((left > 0) | (F.col("size") == 0)).select("*", copies.alias("_copy"))
    words = F.least(F.col("size"), left - F.col("_copy") * F.col("size"))
    # The first k words and the white space between them, cut from the text as it stands.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    some = some.withColumn("_words", words).withColumn("text", F.when((F.col("_words") < F.col("size")) & (F.col("_words") > 0), cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        some = some.withColumn("n_chars", F.length("text").cast("long"))
    return laid_out(some, columns, needed)


def op5_mixing(spark, sf_dir):
    sizes = scratch(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(sizes, source_targets(sizes)).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
k AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER r - 2.0::DOUBLE * source_size AS below, sum(w) OVER (ORDER BY source_size / w DESC, source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS rest
      FROM s WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT max((1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE - below) / rest) AS level FROM k),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, v),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1|' || d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken FROM x
"""
