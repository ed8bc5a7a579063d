"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last
return the columns of ``documents``; the last adds the token ids. ``run`` writes each stage's rows
to the shared folder and reads them again for the next.

Defined cases, in every stage: null ids, texts, languages and sources are kept as they are unless the
stage's operator drops the row for its words; null and empty texts have no words, so the quality rules
drop them, and later stages, given such rows, let them through (near dedup links them with
nothing, mixing repeats them by whole passes only, encoding gives no ids and a null text stays null). Rows
repeated under one doc_id share a verdict of the quality rules (all of them good, or none stays). Ties go to the smaller doc_id in near dedup and to
the seeded order in mixing. Long texts are read whole. Empty tables give empty tables. Further columns stay,
whatever their names; those named like an output column (ids, n_tokens) give way in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from placeloom.llm.common import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text."""
    cut = line_dedup.drop_recurring_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8."""
    return near_dedup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as they are taken, the last time perhaps in part."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their ids and n_tokens; their text is what the ids decode to, which is the text again."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("byte bpe", tokens)]

#: SQL can't replay merges or draw near duplicates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
