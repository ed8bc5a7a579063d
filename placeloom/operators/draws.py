"""The rows of a table that each request draws by a digest of both keys, without a row per pair.

A draw by md5(request|row) needs the digest of every pair, but only a request's least ones. Each
request gets a bound that somewhat more digests than it wants lie below; tiles of requests and rows
work out the first 32 bits of all digests in numpy and return the pairs below the bound. Requests
that got fewer than they want are drawn again without a bound, so the result is exact in any case.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.operators.tiles import tiled
from placeloom.session import written

#: Rows and requests of a tile, and how many standard deviations above a request's number its bound is.
TILE, SPARE = (65_536, 1_024), 6.0
_ALL = 2**32 - 1
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Tails:
    """Ends of md5's one block, for numbers written in decimals, at each place in a word that they may begin at."""

    def __init__(self, numbers: np.ndarray):
        text = numbers.astype("S20").view(np.uint8).reshape(len(numbers), 20)
        self.sizes = np.count_nonzero(text, axis=1).astype(np.uint32)
        self.words = []
        for shift in range(4):
            ends = np.zeros((len(numbers), 28), np.uint8)
            ends[:, shift : shift + 20] = text
            ends[np.arange(len(numbers)), shift + self.sizes] = 0x80
            self.words.append(list(np.ascontiguousarray(ends.view("<u4").T)))

    def digests(self, head: str) -> np.ndarray:
        """The first 32 bits of md5(head + number) of all numbers."""
        raw = head.encode()
        whole, shift = divmod(len(raw), 4)
        words: list[int | np.ndarray] = [0] * 16
        for i, w in enumerate(np.frombuffer(raw.ljust(4 * whole + 4, b"\0"), "<u4").tolist()):
            words[i] = w
        for i, w in enumerate(self.words[shift]):
            if w.any():
                words[whole + i] = w | np.uint32(words[whole + i])
        words[14] = (self.sizes + np.uint32(len(raw))) * np.uint32(8)
        n = len(self.sizes)
        a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(61):  # the first word of the state is done then
            if i < 16:
                of = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                of = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                of = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                of = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            a += f
            if isinstance(words[of], int):
                a += np.uint32((_SINES[i] + words[of]) & _ALL)
            else:
                a += words[of]
                a += np.uint32(_SINES[i])
            np.left_shift(a, np.uint32(_TURNS[i]), out=t)
            a >>= np.uint32(32 - _TURNS[i])
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        b += np.uint32(_BEGIN[0])
        return b.byteswap()


def _below(rows: pa.Table, requests: pa.Table) -> pa.Table:
    """request_id, id of all pairs whose digest isn't above the request's bound."""
    ids, found = np.asarray(rows["id"]), ([], [])
    if len(ids) and len(requests):
        tails = Tails(ids)
        for key, bound in zip(requests["request_id"].to_pylist(), requests["bound"].to_pylist()):
            some = ids[tails.digests(f"{key}|") <= bound]
            found[0].append(np.full(len(some), key))
            found[1].append(some)
    return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found], ["request_id", "id"])


def drawn(requests: DataFrame, rows: DataFrame, n: Column, by: str) -> DataFrame:
    """The ``n`` (a column of requests) rows of least md5(request_id|id), then id, for each of ``requests``, among those alike in ``by``; with their rank.

    ``requests`` has request_id and one value of ``by`` for each, ``rows`` has id; keys are long and not null. All columns of both are kept. A key
    that comes more than once stands for as many rows, which are ranked together.
    """
    asked = requests.withColumn("_n", n).filter(F.col("_n") > 0)
    wanted = asked.groupBy("request_id", by).agg(F.max("_n").alias("_n"))
    held = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_of"))
    share = (F.col("_n") + SPARE * F.sqrt("_n") + 10) / F.col("_of")
    bounded = wanted.join(F.broadcast(held), by).select("request_id", by, F.least(F.lit(_ALL), F.ceil(share * _ALL)).cast("long").alias("bound"))
    slim = rows.select("id", by).distinct()
    below = lambda some: tiled(slim, some, _below, "request_id long, id long", TILE, ("id", "request_id"), by)
    pairs = written(below(bounded))
    few = bounded.filter(F.col("bound") < _ALL).join(wanted, ["request_id", by]).join(pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("_got")), "request_id", "left")
    short = written(few.filter(F.coalesce("_got", F.lit(0)) < F.col("_n")).select("request_id").distinct())
    if not short.isEmpty():
        again = bounded.join(short, "request_id").withColumn("bound", F.lit(_ALL).cast("long"))
        pairs = pairs.join(short, "request_id", "left_anti").unionByName(below(again))
    met = pairs.distinct().join(asked, "request_id").join(rows, ["id", by])
    digest = F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.col("id").cast("string")))
    order = F.row_number().over(Window.partitionBy("request_id").orderBy(digest, "id"))
    return met.withColumn("rank", order).filter(F.col("rank") <= F.col("_n")).drop("_n")
