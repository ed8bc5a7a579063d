"""An index of vectors: inverted lists around coarse centroids, residuals as product codes, exact distances for what is left.

Centroids are fitted by Lloyd rounds over a bounded sample (FIT_ROWS), each round one job whose tasks
send sums per centroid. What a vector differs by from its centroid is cut into
parts of PART_DIMS numbers, and each part becomes the number of the nearest of 256 codewords, fitted
per part in a task of its own. A search looks into the lists of the nearest centroids only, ranks
their members by tables of distances to codewords, and computes exact distances for the best
RERANK x k of them. How many lists it takes is measured when the index is written: as many as hold
RECALL of the true nearest vectors of sampled ones, found by brute force.

Work is dealt out by bundles of neighbouring lists, which return their best members per query, not those of each list; large
bundles and many queries of one are cut into chunks. Only
centroids and codewords are sent to all tasks: MOST_LISTS and 256 vectors at most.

Defined cases: vectors have one length and no nulls; a null city is found only by searches that don't ask for one;
copies are as many rows; with fewer than k vectors in the lists all are returned; an
index over no vectors finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.retrieve import squared_l2, top_k, vector_topk
from placeloom.operators.tiles import tiled
from placeloom.session import written

#: Vectors that centroids and codewords are fitted on, rounds of fitting, the largest number of lists, and numbers in a part of a vector.
FIT_ROWS, ROUNDS, MOST_LISTS, PART_DIMS = 65_536, 8, 4_096, 4
#: Sampled queries, neighbours of each and the share of these that the lists read must hold; exact distances per wanted row.
SAMPLED, NEIGHBOURS, RECALL, RERANK = 200, 20, 0.97, 10
#: Members of a bundle of lists and queries of it that meet in one group, and rough distances held at once.
CHUNK, QUERIES, ROUGH = 65_536, 1_024, 1 << 22


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))


@dataclass(frozen=True)
class Cells:
    """centroids [list, number], codewords [part, code, number], and how many lists a search reads."""

    centroids: np.ndarray
    codewords: np.ndarray
    probes: int

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """[part, row, number], the last part filled up with zeros."""
        return _parts(vectors, self.codewords.shape[2])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and its codes."""
        of = apart(vectors, self.centroids).argmin(1)
        rest = self.parts(vectors - self.centroids[of])
        return of, np.stack([apart(p, w).argmin(1) for p, w in zip(rest, self.codewords)], 1).astype(np.uint8)


def _parts(vectors: np.ndarray, dims: int) -> np.ndarray:
    short = -vectors.shape[1] % dims
    full = np.pad(vectors, ((0, 0), (0, short)))
    return full.reshape(len(full), -1, dims).transpose(1, 0, 2)


def fit_centroids(sample: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` centroids of ``sample`` (id, embedding), from its first rows by a hash; a list that loses its members keeps its centroid."""
    at = matrix(sample.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").toArrow()["embedding"])
    for _ in range(rounds):
        here = at

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(here), np.zeros(len(here), np.int64)
            for b in batches:
                if b.num_rows:
                    vectors = matrix(b["embedding"])
                    of = apart(vectors, here).argmin(1)
                    np.add.at(total, of, vectors)
                    count += np.bincount(of, minlength=len(here))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        parts = sample.select("embedding").mapInArrow(sums, "cell int, n long, total array<double>")
        added = parts.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        mean = added.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))), lambda v: v["x"]).alias("at")).toArrow()  # a row per list
        at = here.copy()
        at[np.asarray(mean["cell"])] = matrix(mean["at"])
    return at


def fit_codewords(sample: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[part, code, number]: each part's codewords are fitted in a task of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = matrix(b["embedding"])
                rest = _parts(vectors - centroids[apart(vectors, centroids).argmin(1)], PART_DIMS)
                for i, part in enumerate(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), b["id"], pa.array(list(part), pa.list_(pa.float64()))], ["part", "id", "x"])

    def lloyd(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = matrix(rows["x"])
        at = x[np.random.default_rng(7).permutation(len(x))[:256]]
        for _ in range(rounds):
            of = apart(x, at).argmin(1)
            total, count = np.zeros_like(at), np.bincount(of, minlength=len(at))
            np.add.at(total, of, x)
            at = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], at)
        at = np.concatenate([at, np.repeat(at[:1], 256 - len(at), axis=0)])
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "words": pa.array([at.reshape(-1)], pa.list_(pa.float64()))})

    made = sample.select("id", "embedding").mapInArrow(cut, "part int, id long, x array<double>").groupBy("part").applyInArrow(lloyd, "part int, words array<double>").orderBy("part").toArrow()
    return matrix(made["words"]).reshape(len(made), 256, PART_DIMS)


def write_cells(vectors: DataFrame, path: str, lists: int | None = None, recall: float = RECALL) -> "VectorIndex":
    """Write the index of ``vectors`` (id, embedding[, city]) and read it back. Without ``lists`` their number is twice the square root of the vectors'."""
    spark = vectors.sparkSession
    n = vectors.count()
    lists = max(1, min(lists or 2 * math.isqrt(n), MOST_LISTS, n))
    if not n:
        cells = Cells(np.zeros((1, 1)), np.zeros((1, 256, PART_DIMS)), 1)
    else:
        kept = vectors if n <= FIT_ROWS else vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / n))
        sample = written(kept.select("id", "embedding"))
        centroids = fit_centroids(sample, lists)
        cells = Cells(centroids, fit_codewords(sample, centroids), lists)
    city = F.col("city") if "city" in vectors.columns else F.lit(None).cast("string").alias("city")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of, codes = cells.encode(matrix(b["embedding"]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "cell", "code"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("id", city, "embedding").mapInArrow(encoded, f"id long, city string, embedding {kind}, cell int, code binary")
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/vectors")
    if n:
        asked = sample.orderBy(F.xxhash64(F.lit("asked"), "id"), "id").limit(SAMPLED).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
        near = vector_topk(vectors, asked, NEIGHBOURS).select("query_id", "id").join(spark.read.parquet(f"{path}/vectors").select("id", "cell"), "id").join(asked, "query_id").toArrow()  # SAMPLED x NEIGHBOURS rows
        order = apart(matrix(near["vector"]), centroids).argsort(1).argsort(1)
        needed = np.sort(order[np.arange(len(near)), np.asarray(near["cell"])]) + 1
        cells = Cells(centroids, cells.codewords, int(needed[max(0, math.ceil(recall * len(needed)) - 1)]))
    flat = lambda x: [float(v) for v in x.reshape(-1)]
    spark.createDataFrame([(len(cells.centroids), flat(cells.centroids), len(cells.codewords), flat(cells.codewords), cells.probes, n)], "lists int, centroids array<double>, parts int, codewords array<double>, probes int, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return read_cells(spark, path)


@dataclass(frozen=True)
class VectorIndex:
    """vectors (id, city, embedding, cell, code) in the order of lists, and the cells they lie in."""

    vectors: DataFrame
    cells: Cells


def read_cells(spark: SparkSession, path: str) -> VectorIndex:
    r = spark.read.parquet(f"{path}/cells").first()
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), Cells(np.array(r.centroids).reshape(r.lists, -1), np.array(r.codewords).reshape(r.parts, 256, -1), r.probes))


def search_cells(index: VectorIndex, queries: DataFrame, k: int, city: bool = False, probes: int | None = None) -> DataFrame:
    """query_id, id, distance, rank of the k nearest found for ``queries`` (query_id, vector[, city]); distances are exact."""
    cells, reads, best = index.cells, probes or index.cells.probes, RERANK * k
    own = F.col("city") if city else F.lit(None).cast("string")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = apart(matrix(b["vector"]), cells.centroids)
                some = np.argpartition(near, min(reads, near.shape[1]) - 1, axis=1)[:, :reads]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(some.astype(np.int32)), pa.list_(pa.int32()))], [*b.schema.names, "lists"])

    kind = queries.schema["vector"].dataType.simpleString()
    asked = written(queries.select("query_id", own.alias("city"), "vector").mapInArrow(probed, f"query_id long, city string, vector {kind}, lists array<int>"))
    wide = max(1, math.ceil(len(cells.centroids) * CHUNK / max(1, index.vectors.count())))  # lists of a bundle
    bundle = F.floor(F.col("cell") / wide).cast("int").alias("bundle")
    members = index.vectors.select(bundle, "id", "city", "cell", "code")
    of = lambda x: F.floor(x / wide).cast("int")
    hits = asked.select("query_id", "city", "vector", "lists", F.explode(F.array_distinct(F.transform("lists", of))).alias("bundle"))
    hits = hits.withColumn("lists", F.filter("lists", lambda x: of(x) == F.col("bundle")))

    def ranked(members: pa.Table, queries: pa.Table) -> pa.Table:
        """The best of a bundle's members for each query, by tables of distances to codewords; few queries at once."""
        found: tuple[list, list, list] = ([], [], [])
        if len(members) and len(queries):
            members = members.sort_by("cell")
            ids, of = np.asarray(members["id"]), np.asarray(members["cell"])
            codes = np.ascontiguousarray(np.frombuffer(b"".join(members["code"].to_pylist()), np.uint8).reshape(len(members), -1).T)
            cities, vectors, lists = np.array(members["city"].to_pylist(), object), matrix(queries["vector"]), queries["lists"].to_pylist()
            ends = np.append(np.flatnonzero(np.diff(of, prepend=of[0] - 1)), len(of))
            step = max(1, ROUGH // len(ids))
            for first in range(0, len(vectors), step):
                some = range(first, min(first + step, len(vectors)))
                rough = np.full((len(some), len(ids)), np.inf)
                asks: dict[int, list[int]] = {}
                for i in some:
                    for c in lists[i]:
                        asks.setdefault(c, []).append(i)
                for start, end in zip(ends[:-1], ends[1:]):
                    mine = np.array(asks.get(int(of[start]), []), int)
                    if len(mine):
                        rest = cells.parts(vectors[mine] - cells.centroids[of[start]])
                        rough[mine - first, start:end] = sum(apart(p, w)[:, c] for p, w, c in zip(rest, cells.codewords, codes[:, start:end]))
                for i in some:
                    row, at = rough[i - first], queries["city"][i].as_py()
                    keep = np.flatnonzero(np.isfinite(row) & (cities == at)) if city else np.flatnonzero(np.isfinite(row))
                    if len(keep) > best:
                        keep = keep[np.argpartition(row[keep], best - 1)[:best]]
                    for values, x in zip(found, (np.full(len(keep), queries["query_id"][i].as_py()), ids[keep], row[keep])):
                        values.append(x)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, kinds)], ["query_id", "id", "rough"])

    rough = tiled(members, hits, ranked, "query_id long, id long, rough double", (CHUNK, min(CHUNK, QUERIES)), ("id", "query_id"), "bundle")
    few = top_k(rough, best, F.col("rough"), F.col("id")).select("query_id", "id")
    exact = few.join(index.vectors.select("id", "embedding"), "id").join(queries.select("query_id", "vector"), "query_id")
    distance = F.round(squared_l2(F.col("embedding"), F.col("vector")), 9)
    return top_k(exact.select("query_id", "id", distance.alias("distance")), k, F.col("distance"), F.col("id"))
