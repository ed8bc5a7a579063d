"""Incremental tagging: new places are tagged once and appended, with Structured Streaming's available-now trigger.

Which ids have been seen is the stream's own state (``dropDuplicates`` keeps it in the state store of
the checkpoint), so a batch neither reads nor joins what was tagged before. A batch is answered in slices of about SLICE
places, each committed to a log below the checkpoint before the next one begins. If a run is
killed half-way, the batch is run again by Spark, finds its committed slices in the log and asks the
model for the others only: no more than the one slice under way is asked twice.

Defined cases: ids that ``tagged`` holds before the first batch stay as they are; a null id is one id; of rows of one id any stands
for it; later versions of a place aren't tagged anew; no new places change nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.providers import Answer, offline_tagger
from placeloom.operators.tag import pending, tag
from placeloom.schema import CLEAN_POI, TAGGED_POI
from placeloom.sources.places import exists

#: Places whose answers are committed together.
SLICE = 2_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tag_batch(rows: DataFrame, number: int, tagged: str, log: str, answer: Answer = offline_tagger, slice_rows: int = SLICE) -> None:
    """Tag a batch of new places and append it; what an earlier attempt at this batch has answered or appended isn't asked or appended again."""
    spark, at = rows.sparkSession, f"{log}/{number}"
    again = exists(spark, f"{at}/rows")
    if again:
        rows.write.format("noop").mode("overwrite").save()  # the stream's state has to see every row of an attempt
        if exists(spark, f"{at}/done"):
            return
    else:
        fresh = pending(rows, spark.read.schema(TAGGED_POI).parquet(tagged)) if number == 0 else rows
        fresh.write.mode("overwrite").parquet(f"{at}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{at}/rows")
    slices = math.ceil(rows.count() / slice_rows)
    for i in range(slices):
        if not exists(spark, f"{at}/{i}"):
            some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)
            tag(some, answer).write.mode("overwrite").parquet(f"{at}/{i}")
    if slices:
        columns = [f.name for f in spark.read.schema(TAGGED_POI).parquet(tagged).schema]
        said = reduce(DataFrame.unionByName, (spark.read.parquet(f"{at}/{i}") for i in range(slices))).select(columns)
        # A first attempt may have appended the rows and died before it could say so.
        said = pending(said, spark.read.schema(TAGGED_POI).parquet(tagged)) if again else said
        said.write.mode("append").parquet(tagged)
    spark.range(0).write.mode("overwrite").parquet(f"{at}/done")


def tag_new_places(spark: SparkSession, places: str, tagged: str, checkpoint: str, answer: Answer = offline_tagger, slice_rows: int = SLICE) -> None:
    """Tag places (Parquet, CLEAN_POI) that came since the last call."""
    spark.createDataFrame([], TAGGED_POI).write.mode("append").parquet(tagged)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = spark.readStream.schema(CLEAN_POI).parquet(places).dropDuplicates(["id"])
    batch = lambda rows, number: tag_batch(rows, number, tagged, f"{checkpoint}-answers", answer, slice_rows)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
