"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

Every byte is removed that a string of ``span`` bytes covers which also starts anywhere else, in the
same document or another; strings are judged on the input and never cross documents.

Suffixes are sampled consistently: of the ``gram``-byte strings inside a string of ``span`` bytes the
one of the least hash (the leftmost of equals) is its anchor, so equal strings have their anchor at
the same place, and the suffixes that start there have a common prefix of ``gram`` bytes or more.
Consecutive strings with one anchor form a run. The hash only chooses anchors; nothing is taken for
equal because of it.

A batch of documents gets a sparse suffix array: the first ``gram`` bytes of its sampled suffixes, each
once with the number of its occurrences. It is a table dealt to buckets by hash and in the order of bytes
only within a bucket, so neighbours of the whole order may lie in different buckets, and only prefixes of
exactly ``gram`` bytes are found in it. A merge-scan of two arrays is a join on these without an exchange; Spark
sorts both sides again. A new array is merge-scanned against all levels, and enters the family: arrays of equal size merge
(added up by suffix, written and sorted anew) into one twice as large, so each suffix is rewritten as often as the logarithm of the number
of batches. What has been merged is deleted.

The occurrences of matched suffixes are then extended to both sides. Runs whose bytes agree as a
whole (by 128-bit cryptographic digests) are removed whole. Where only parts of runs may agree, the
bytes of each distinct run are brought together by suffix; strings that sort as equal are compared
byte by byte. A suffix with very many distinct runs (the edge of a passage that a large share of
documents have) is instead compared by digests of its strings, in a distributed aggregation.

Defined cases: null and empty texts have no bytes; texts shorter than ``span`` lose nothing; very
long texts are sampled in overlapping pieces; repeated rows repeat their strings, so they lose
them; rows of one doc_id with different texts are told apart (by two 64-bit hashes of both); doc_id
may have any type that can be hashed, null included; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.common import BROADCAST_ROWS, Table, documents, save

SPAN, GRAM = 400, 64
#: Batches in which documents enter the index, and distinct runs from which a suffix is compared by strings.
BATCHES, MANY_RUNS = 4, 5_000
#: Bytes hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def fingerprints(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of ``size`` bytes in ``raw`` (of PIECE bytes at most)."""
    up, down = _powers()
    n = len(raw) - size + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    found = (sums[size:] - sums[:n]) * down[:n]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def runs(raw: bytes, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """anchor, first and last string with it, and the gram's fingerprint."""
    width = span - gram + 1
    step = PIECE - span + 1
    for start in range(0, max(0, len(raw) - span + 1), step):
        hashes = fingerprints(np.frombuffer(raw, np.uint8)[start : start + PIECE], gram)
        place = np.uint64((1 << 21) - 1)
        keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        n = len(keys) - width + 1
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchors = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(first[1:] - 1, n - 1)
        for p, a, b, h in zip(anchors[first].tolist(), first.tolist(), last.tolist(), hashes[anchors[first]].view(np.int64).tolist()):
            yield start + p, start + a, start + b, h


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(df: DataFrame, schema: str, work) -> DataFrame:
    """``work``: an iterator of batches to an iterator of lists of rows of ``schema``."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def mapped(batches):
        for rows in work(batches):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], list(names))

    return df.mapInArrow(mapped, schema)


ROW = ["row_a", "row_b"]


def occurrences(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """batch, row_a, row_b, p (anchor), off (anchor less first string), n_strings, run (digest), suffix: a row per run.

    ``docs`` has batch, row_a, row_b and text.
    """

    def work(batches):
        rows = []
        for batch in batches:
            for part, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("batch", *ROW, "text"))):
                raw = (text or "").encode()
                rows += [(part, a, b, p, p - x, y - x + 1, _digest(raw[x : y + span]), raw[p : p + gram]) for p, x, y, _ in runs(raw, span, gram)]
                if len(rows) > 50_000:
                    yield rows
                    rows = []
        yield rows

    return _arrow(docs.select("batch", *ROW, "text"), "batch int, row_a long, row_b long, p long, off long, n_strings long, run binary, suffix binary", work)


class SuffixIndexFamily:
    """Levels of suffix arrays; level k holds 2^k batches. ``matches`` has the suffixes found twice so far.

    All arrays are dealt to the same ``buckets``, and a suffix is one row of its array however often
    it occurs, so neither scans nor merges have hot keys.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.levels: dict[int, Table] = {}
        self.matches: Table | None = None

    def _array(self, counts: DataFrame) -> Table:
        return save(counts, "suffix-array", bucket="suffix", buckets=self.buckets)

    def add(self, batch: DataFrame) -> None:
        """Take in the sampled suffixes (suffix) of new documents."""
        new = self._array(batch.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")))
        found = [new.df.filter("n > 1").select("suffix"), *(new.df.join(old.df.hint("merge"), "suffix", "left_semi").select("suffix") for old in self.levels.values())]
        if self.matches is not None:
            found.append(self.matches.df)
        earlier, self.matches = self.matches, save(reduce(DataFrame.union, found).distinct(), "matches")
        if earlier is not None:
            earlier.drop()
        merged, k = [new], 0
        while k in self.levels:
            merged.append(self.levels.pop(k))
            k += 1
        if len(merged) > 1:
            new = self._array(reduce(DataFrame.union, (x.df for x in merged)).groupBy("suffix").agg(F.sum("n").alias("n")))
        for old in merged if len(merged) > 1 else ():
            old.drop()
        self.levels[k] = new

    def drop(self) -> None:
        for table in [*self.levels.values(), self.matches]:
            if table is not None:
                table.drop()


def _few(rows: DataFrame, of: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` whose ROW columns stand in ``of`` (a written table), if it is counted to be small enough to be broadcast; else all rows.

    A filter ahead of a join with ``of`` that keeps rows from being shuffled in vain; the join decides.
    """
    return rows.join(F.broadcast(of.select(*ROW)), ROW, "left_semi") if of.count() <= limit else rows


def _starts(held: list[tuple]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the runs in ``held`` (suffix, off, n_strings, bytes, ...) end to end, and for each string its start there, its run and the place of its anchor."""
    counts = np.array([x[2] for x in held])
    begin = np.concatenate([[0], np.cumsum([len(x[3]) for x in held])[:-1]])
    owner = np.repeat(np.arange(len(held)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return b"".join(x[3] for x in held), begin[owner] + inner, owner, np.array([x[1] for x in held])[owner] - inner


def _twice(held: list[tuple], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each string of the runs in ``held`` stands there twice or more, and the run it is in.

    Strings are sorted by fingerprints; neighbours of equal fingerprints are compared byte by byte,
    those at the same distance from each other in one comparison.
    """
    blob, start, owner, place = _starts(held)
    raw = np.frombuffer(blob, np.uint8)
    step = PIECE - span + 1
    every = np.concatenate([fingerprints(raw[x : x + PIECE], span) for x in range(0, max(1, len(raw) - span + 1), step)])
    keys = every[start] + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    x, y = order[same], order[same + 1]
    twice = np.zeros(len(keys), bool)
    by = np.lexsort((x, start[y] - start[x]))
    x, y = x[by], y[by]
    apart = (np.diff(start[x]) != 1) | (np.diff(start[y]) != 1)
    cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(x)] if len(x) else [0]
    for i, j in zip(cuts, cuts[1:]):
        a, b, n = start[x[i]], start[y[i]], j - i - 1 + span
        if blob[a : a + n] == blob[b : b + n]:
            twice[x[i:j]] = twice[y[i:j]] = True
        else:
            # Some fingerprint stands for several strings: all strings of these fingerprints are told apart by their bytes.
            for key in np.unique(keys[x[i:j]]):
                seen: dict[bytes, list[int]] = {}
                for s in np.flatnonzero(keys == key).tolist():
                    seen.setdefault(blob[start[s] : start[s] + span], []).append(s)
                for members in seen.values():
                    if len(members) > 1:
                        twice[members] = True
    return twice, owner


def _spans(mask: np.ndarray, first: int, span: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield first + a, first + b - 1 + span


PIECES = "gram long, off long, n_strings long, bytes binary, n long, row_a long, row_b long, p long, many long"
SPANS = "row_a long, row_b long, start long, end long"


def _compare(batches, span: int):
    """The repeated parts of runs that stand once, from rows sorted by gram."""

    def flush(held):
        twice, owner = _twice(held, span)
        cuts = np.searchsorted(owner, np.arange(len(held) + 1))
        rows = []
        for i in np.unique(owner[twice]).tolist():
            _, off, _, _, n, a, b, p = held[i]
            if n == 1:
                rows += [(a, b, *ends) for ends in _spans(twice[cuts[i] : cuts[i + 1]], p - off, span)]
        return rows

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "off", "n_strings", "bytes", "n", *ROW, "p"))):
            if size > PIECE and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _by_strings(pieces: DataFrame, span: int) -> DataFrame:
    """The same comparison for suffixes with very many runs: strings are counted by digest, first on the map side."""

    def work(rows):
        for batch in rows:
            for off, count, raw, n, a, b, p in zip(*(batch.column(c).to_pylist() for c in ("off", "n_strings", "bytes", "n", *ROW, "p"))):
                yield [(_digest(raw[i : i + span]), n, a, b, p - off + i) for i in range(count)]

    strings = _arrow(pieces, "string binary, n long, row_a long, row_b long, start long", work)
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("string")
    return strings.filter("n = 1").join(twice, "string", "left_semi").select(*ROW, "start", (F.col("start") + span).alias("end"))


def _cut(rows, span: int):
    """The bytes of the runs asked for, from their documents."""
    out, size = [], 0
    for batch in rows:
        for a, b, text, asked in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text", "wanted"))):
            raw = text.encode()
            for x in asked:
                first = x["p"] - x["off"]
                piece = raw[first : first + x["n_strings"] - 1 + span]
                out.append((x["gram"], x["off"], x["n_strings"], piece, x["n"], a, b, x["p"], x["many"]))
                size += len(piece)
                if size > (4 << 20):
                    yield out
                    out, size = [], 0
    yield out


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES, many_runs: int = MANY_RUNS) -> DataFrame:
    """row_a, row_b, start, end: spans of bytes to remove, perhaps overlapping. ``docs`` has row_a, row_b and text."""
    spark = docs.sparkSession
    batch = F.pmod(F.col("row_b"), F.lit(batches)).cast("int").alias("batch")
    every = save(occurrences(docs.select("*", batch), span, gram), "occurrences", part="batch")
    family = SuffixIndexFamily(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(batches):
        family.add(every.df.filter(F.col("batch") == i).select("suffix"))
    # A hash of the suffix is enough to find the occurrences of matches; what isn't a match finds no equal bytes below.
    matches = save(family.matches.df.select(F.xxhash64("suffix").alias("gram")).distinct(), "matched")
    family.drop()
    hashed = every.df.select(F.xxhash64("suffix").alias("gram"), "run", "off", "n_strings", *ROW, "p")
    small = matches.df.count() <= BROADCAST_ROWS
    matched = save(hashed.join(F.broadcast(matches.df) if small else matches.df, "gram", "left_semi").withColumn("id", F.monotonically_increasing_id()), "matched-runs")
    every.drop()
    matches.drop()
    place = [F.min_by(c, "id").alias(c) for c in (*ROW, "p")]
    entries = save(matched.df.groupBy("gram", "run", "off", "n_strings").agg(F.count(F.lit(1)).alias("n"), *place), "runs")
    whole = matched.df.join(entries.df.filter(F.col("n") > 1).select("gram", "run"), ["gram", "run"], "left_semi")
    first = F.col("p") - F.col("off")
    whole = save(whole.select(*ROW, first.alias("start"), (first + F.col("n_strings") - 1 + span).alias("end")), "whole-runs")
    matched.drop()
    mixed = entries.df.groupBy("gram").agg(F.count(F.lit(1)).alias("n_runs"), F.min("n").alias("least")).filter((F.col("n_runs") > 1) & (F.col("least") == 1))
    wanted = entries.df.join(mixed.select("gram", (F.col("n_runs") > many_runs).cast("long").alias("many")), "gram")
    wanted = save(wanted.groupBy(*ROW).agg(F.collect_list(F.struct("gram", "off", "n_strings", "n", "p", "many")).alias("wanted")), "wanted")
    asked = _few(docs, wanted.df).join(wanted.df, ROW).select(*ROW, "text", "wanted")
    pieces = save(_arrow(asked, PIECES, lambda rows: _cut(rows, span)), "pieces")
    entries.drop()
    wanted.drop()
    few = pieces.df.filter("many = 0").repartition("gram").sortWithinPartitions("gram")
    parts = save(_arrow(few, SPANS, lambda rows: _compare(rows, span)).union(_by_strings(pieces.df.filter("many = 1"), span)), "parts-of-runs")
    pieces.drop()
    return whole.df.union(parts.df)


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes by which equal rows are known."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("row_b"))


def remove_repeats(docs: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes."""
    rows = with_rows(docs)
    order = Window.partitionBy(*ROW).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = repeated_spans(rows, span, **options).distinct().withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = save(spans, "spans").df
    small = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS
    found = rows.join(F.broadcast(spans) if small else spans, ROW, "left")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    n = F.size("spans")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"]).cast("int")
    end = lambda i: F.when(i == n, F.octet_length(raw)).otherwise(F.get(F.col("spans"), i)["start"]).cast("int")
    left = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(raw, begin(i) + 1, end(i) - begin(i)).cast("string")), "")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.coalesce(removed, F.lit(0)).alias("n_removed"), F.coalesce(n, F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("spans").isNull(), raw).otherwise(left.cast("binary")).alias("kept"),
    )


def op4_suffix_array_dedup(spark, sf_dir):
    """The counts and digest of ``remove_repeats``, and text: what is left, with U+FFFD for bytes of characters that were cut apart.

    n_bytes is the size of the input; n_removed, n_spans and text tell what was removed.
    """
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
