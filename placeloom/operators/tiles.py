"""All pairs of two tables, tile by tile: both are dealt into chunks, and each pair of chunks is one group of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["_by", "_m", "_q"]


def tiled(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType, sizes: tuple[int, int], keys: tuple[str, str], by: str | None = None) -> DataFrame:
    """The rows that ``work`` makes of each pair of chunks of about ``sizes`` rows, dealt by ``keys``; with ``by`` only rows that are alike in that column meet.

    A row travels once per chunk of the other side, pairs don't travel at all. The number of partitions
    is fixed, since few bytes make much work here.
    """
    spark = left.sparkSession
    by_column = F.lit(0).alias("_by") if by is None else F.col(by).alias("_by")
    chunks = lambda df, n, name: df.groupBy(by_column).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    n = F.broadcast(chunks(left, sizes[0], "_ms").join(chunks(right, sizes[1], "_qs"), "_by"))  # a row per value of ``by``
    own = lambda key, of: F.pmod(F.xxhash64(key), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    a = left.select(by_column, "*").join(n, "_by").select("_by", own(keys[0], F.col("_ms")).alias("_m"), every(F.col("_qs")).alias("_q"), *left.columns)
    b = right.select(by_column, "*").join(n, "_by").select("_by", every(F.col("_ms")).alias("_m"), own(keys[1], F.col("_qs")).alias("_q"), *right.columns)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = lambda df: df.repartition(parts, *KEYS).groupBy(*KEYS)
    return dealt(a).cogroup(dealt(b)).applyInArrow(work, schema)
