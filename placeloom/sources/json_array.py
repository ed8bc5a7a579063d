"""Large JSON array files, read by many tasks and written without holding an array in a row.

A file is read as the pieces between its commas, in the byte ranges that Spark cuts files into. No task sees
what stands before its range, so states are merged by prefix sums, with one small row a range on the way:

1. each range is scanned for both cases, beginning outside and inside a string: the parity of its quotes
   and how much deeper the brackets lie after it in either case. Sums over the ranges before give where each range begins;
2. with that known, each range counts the elements that end in it and keeps the text of the (at most two)
   elements that it shares with its neighbours; sums give the first element's place in the array;
3. each range hands out the elements that lie in it as a whole; the shared ones are put together.

So elements never travel, but for one or two a range; no task holds more than an element and a batch of pieces.
A compressed file is one range. Files are known by 128 bits of hashes of their paths.

Defined cases: blank files and empty arrays have no rows; an element that is null, no object, or no JSON has a row of nulls
at its place; keys that the schema doesn't have are ignored; a file that begins with anything but an array is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.session import written

#: Ranges (of five numbers each) that are broadcast; beyond that, pieces go to the tasks of their ranges.
RANGES = 500_000
#: Characters of elements that a task hands over at once.
CHARACTERS = 1 << 20

_KEY = ["file_a", "file_b", "start"]
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _pieces(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """file_a, file_b, start (of the range), value (the text up to a comma) and the values of folders (folder_0 and so on, and their names); in the order of the file within a range."""
    raw = spark.read.option("lineSep", ",").text(path)
    folders = [c for c in raw.columns if c != "value"]
    at = F.col("_metadata.file_path")
    return raw.select(F.xxhash64(at).alias("file_a"), F.xxhash64(F.lit(1), at).alias("file_b"), F.col("_metadata.file_block_start").alias("start"), "value", *(F.col(c).alias(f"folder_{i}") for i, c in enumerate(folders))), folders


def _depths(piece: str) -> tuple[int, int, int]:
    """Quotes of a piece that end or begin a string, and how much deeper it gets if it begins outside, and inside, a string."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    outside, inside = ("".join(parts[i::2]) for i in (0, 1))
    return len(parts) - 1, *(s.count("[") + s.count("{") - s.count("]") - s.count("}") for s in (outside, inside))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, pa.RecordBatch, int]]:
    """Range, piece, and where it stands, for each piece."""
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in _KEY))
        for i, (key, piece) in enumerate(zip(keys, batch.column("value").to_pylist())):
            yield key, piece, batch, i


def _both_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_KEY, "odd", "outside", "inside"]
    state = lambda key, odd, d: pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, odd, *d)], names)
    current, odd, deeper = None, 0, [0, 0]
    for key, piece, _, _ in _rows(batches):
        if key != current:
            if current is not None:
                yield state(current, odd, deeper)
            current, odd, deeper = key, 0, [0, 0]
        quotes, *by = _depths(piece)
        for case in (0, 1):
            deeper[case] += by[case ^ odd]
        odd ^= quotes & 1
    if current is not None:
        yield state(current, odd, deeper)


def _elements(rows: Iterator[tuple[tuple, str, pa.RecordBatch, int]]) -> Iterator[tuple[tuple, int, str | None, bool, bool, tuple]]:
    """range, number in the range, text, whether it begins and whether it ends there, batch and row of its last piece; last of a range, its end with the elements that ended in it and no text."""
    current, last = None, None
    text: list[str] = []
    for key, piece, batch, i in rows:
        if key != current:
            if current is not None:
                if text:
                    yield current, ended, ",".join(text), begins, False, last
                yield current, ended, None, True, True, last
            depth, odd = (batch.column(c)[i].as_py() for c in ("depth", "in_string"))
            current, ended, text = key, 0, []
            begins = depth == 0 or (depth == 1 and not odd)
        quotes, *by = _depths(piece)
        before, depth = depth, depth + by[odd]
        odd ^= quotes & 1
        last = (batch, i)
        if before == 0:
            if not piece.strip():
                continue
            head, bracket, piece = piece.partition("[")
            if head.strip("﻿ \t\r\n") or not bracket:
                raise ValueError("a file must hold one JSON array")
        closed = depth == 0 and not odd
        text.append(piece[: piece.rindex("]")] if closed else piece)
        if closed or (depth == 1 and not odd):
            whole = ",".join(text)
            if whole.strip() or not begins:
                yield current, ended, whole, begins, True, last
                ended += 1
            text, begins = [], True
    if current is not None:
        if text:
            yield current, ended, ",".join(text), begins, False, last
        yield current, ended, None, True, True, last


def _edges(folders: list[str]):
    """Per range: the elements that end in it and the texts of those it shares with others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = []
        for key, number, text, begins, ends, (batch, i) in _elements(_rows(batches)):
            if text is not None:
                if not (begins and ends):
                    shared.append({"number": number, "text": text})
                continue
            kind = pa.list_(pa.struct([("number", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, number)), pa.array([shared], kind), *(batch.column(c).slice(i, 1) for c in folders)], [*_KEY, "ended", "shared", *folders])
            shared = []

    return work


def _whole(folders: list[str]):
    """The elements that lie in one range, with their places in the array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, texts, size, origin = [], [], 0, None

        def out():
            n = len(texts)
            own = [pa.concat_arrays([origin[0].column(c).slice(origin[1], 1)] * n) for c in folders]
            return pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int64()), pa.array(texts, pa.string())], [*folders, "ord", "text"])

        for _, number, text, begins, ends, at in _elements(_rows(batches)):
            if text is None:  # the end of a range
                if texts:
                    yield out()
                places, texts, size = [], [], 0
            elif begins and ends:
                origin = at
                places.append(at[0].column("first")[at[1]].as_py() + number)
                texts.append(text)
                size += len(text)
                if size >= CHARACTERS or len(texts) >= 10_000:
                    yield out()
                    places, texts, size = [], [], 0

    return work


def _meet(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pieces`` with the columns of their ``ranges``, a range's pieces together and in their order."""
    if ranges.count() <= RANGES:
        return pieces.join(F.broadcast(ranges), _KEY)
    numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
    return numbered.join(ranges, _KEY).repartition(*_KEY).sortWithinPartitions(*_KEY, "_at").drop("_at")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The values of folders, ``ord`` (place in the array, from 0) and ``text`` of each element of the array files at ``path``."""
    pieces, names = _pieces(spark, path)
    folders = [f"folder_{i}" for i in range(len(names))]
    kinds = [f"{c} {pieces.schema[c].dataType.simpleString()}" for c in folders]
    keys = ", ".join(f"{c} long" for c in _KEY)
    earlier = Window.partitionBy("file_a", "file_b").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))

    scanned = pieces.select(*_KEY, "value").mapInArrow(_both_cases, f"{keys}, odd long, outside long, inside long")
    begun = scanned.withColumn("in_string", (before("odd") % 2).cast("int"))
    states = begun.withColumn("deeper", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))).select(*_KEY, "in_string", before("deeper").cast("int").alias("depth"))
    states = written(states)
    edges = written(_meet(pieces, states).mapInArrow(_edges(folders), ", ".join([keys, "ended long", "shared array<struct<number:long,text:string>>", *kinds])))
    placed = edges.withColumn("first", before("ended"))
    states = states.join(placed.select(*_KEY, "first"), _KEY)
    whole = _meet(pieces, states).mapInArrow(_whole(folders), ", ".join([*kinds, "ord long", "text string"]))
    parts = placed.select("file_a", "file_b", "start", "first", *folders, F.explode("shared").alias("part")).withColumn("ord", F.col("first") + F.col("part.number"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part.text"))), lambda x: x["text"]), ",")
    across = parts.groupBy("file_a", "file_b", "ord").agg(text.alias("text"), *(F.first(c).alias(c) for c in folders))
    return whole.select(*folders, "ord", "text").unionByName(across.select(*folders, "ord", "text")).toDF(*names, "ord", "text")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of array files, with ``ord`` and the values of folders; columns by ``schema``."""
    found = elements(spark, path)
    *folders, _, _ = found.columns
    inner = [f"folder_{i}" for i in range(len(folders))]
    kind = T._parse_datatype_string(schema)
    items = found.toDF(*inner, "ord", "text").select(*inner, "ord", F.from_json("text", kind).alias("item"))
    return items.select(*inner, "ord", "item.*").toDF(*folders, "ord", *kind.names)


def write(df: DataFrame, path: str, part: str, order: str) -> None:
    """One array file for each value of ``part``, in the order of ``order`` (ties by the object's text), a line an element.

    A value's rows are sorted in its task (spilling) and written one by one; a file has one writer.
    """
    rows = df.select(part, F.col(order).alias("_order"), F.to_json(F.struct(order, *(c for c in df.columns if c not in (part, order)))).alias("_text"))
    by = Window.partitionBy(part).orderBy("_order", "_text")
    lines = rows.select(
        part, "_order", "_text", F.concat(F.when(F.row_number().over(by) == 1, "[").otherwise(","), "_text", F.when(F.lead(F.lit(1)).over(by).isNull(), "]").otherwise("")).alias("value")
    )
    lines.sortWithinPartitions(part, "_order", "_text").select("value", part).write.mode("overwrite").partitionBy(part).text(path)
