"""Reading and writing places, anchors, tags and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.schema import EVAL_CASE, RAW_ANCHOR, RAW_POI, TAGGED_POI
from placeloom.sources import json_array


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects, with ``ord``, the place in the array, and the values of folders; large files are read in ranges."""
    return json_array.read(spark, path, schema)


def _fields(schema: str) -> str:
    from pyspark.sql import types as T

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema))


def read_raw_places(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, RAW_POI)


def read_raw_anchors(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, RAW_ANCHOR)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tagged places; blank and malformed lines are left out."""
    return spark.read.schema(TAGGED_POI).option("mode", "DROPMALFORMED").json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an evaluation set; an error if the file is missing."""
    whole = spark.read.schema(f"city string, city_name string, cases array<struct<{_fields(EVAL_CASE)}>>").option("multiLine", "true").json(path)
    return whole.select("city", "city_name", F.explode("cases").alias("case")).select("city", "city_name", "case.*")


def write_json_arrays(df: DataFrame, path: str, part: str, order: str, force: bool = False) -> bool:
    """One JSON array file for each value of ``part``, in the order of ``order``, unless written already."""
    if not force and exists(df.sparkSession, path):
        return False
    json_array.write(df, path, part, order)
    return True


def append_lines(df: DataFrame, path: str) -> None:
    """Append a batch as JSON lines; each task's file is there as soon as the batch is committed."""
    df.write.mode("append").json(path)


def write_rows(df: DataFrame, path: str, force: bool = False, kind: str = "parquet") -> bool:
    """Write unless it has been written already; ``force`` replaces it. True if it was written."""
    if not force and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").format(kind).save(path)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished there, in any file system Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
