"""What the training-data operators share: the shared folder, scratch tables, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without executors of its own (``local[n]``, tests) may do without the setting; it gets a new folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_database(spark: SparkSession) -> str:
    """The database of this application's scratch tables; its folder is below the shared one."""
    name = "placeloom_" + re.sub(r"[^0-9A-Za-z]", "_", spark.sparkContext.applicationId)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


@dataclass(frozen=True)
class Table:
    """A scratch table and its rows; ``drop`` deletes its files, once nothing lazy needs them any more."""

    name: str
    df: DataFrame

    def drop(self) -> None:
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def save(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 0, part: str | None = None) -> Table:
    """Write a table into the shared folder and read it back: lineage ends there, lost executors don't matter.

    With ``bucket``, rows are dealt to ``buckets`` files by that column and sorted by it in each, so
    that joins and groupings of such tables need no exchange. With ``part``, one folder per value.
    """
    spark = df.sparkSession
    table = f"{scratch_database(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    if bucket:
        writer = writer.bucketBy(buckets, bucket).sortBy(bucket)
    if part:
        writer = writer.partitionBy(part)
    writer.saveAsTable(table)
    return Table(table, spark.table(table))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table that ``save`` writes, for results that are read later on."""
    return save(df, name).df


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that haven't been read yet are lost."""
    spark.sql(f"DROP DATABASE IF EXISTS {scratch_database(spark)} CASCADE")


#: Rows of a few plain columns (some tens of MB) that a join may broadcast once they have been counted.
BROADCAST_ROWS = 500_000


def counted_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written already, of few narrow columns) with a broadcast hint if it is counted to be small; else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def replace_columns(df: DataFrame, **new: Column) -> DataFrame:
    """Add columns; an input column of the same name (whatever its case) gives way."""
    taken = {k.lower() for k in new}
    return df.select(*(df[c] for c in df.columns if c.lower() not in taken), *(v.alias(k) for k, v in new.items()))


def set_aside(df: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns and one struct ``_rest`` of all others, whose names then clash with nothing."""
    rest = [df[c] for c in df.columns if c not in needed]
    return df.select(*needed, *([F.struct(*rest).alias("_rest")] if rest else []))


def laid_out(df: DataFrame, columns: list[str], needed: tuple[str, ...], **new: Column) -> DataFrame:
    """After ``set_aside``: ``columns`` in their order, those named in ``new`` (whatever their case) in their new form, the others of ``new`` last."""
    named = {k.lower(): (k, v) for k, v in new.items()}
    place = lambda c: named[c.lower()][1].alias(named[c.lower()][0]) if c.lower() in named else F.col(c) if c in needed else F.col("_rest").getField(c).alias(c)
    there = {c.lower() for c in columns}
    return df.select(*map(place, columns), *(v.alias(k) for low, (k, v) in named.items() if low not in there))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
