"""Approximate nearest neighbours by a forest of random-projection trees with one shared queue.

A tree sends a vector left or right at every level by its projection on a random direction; all
nodes of a level share one direction, a node has a threshold of its own. Directions come from a
seed, thresholds are medians over a bounded sample of the vectors (FIT_BYTES), and every vector is
then put into a leaf of every tree. Largest inner products are smallest distances once
every vector gets one more component that lifts it to the largest length of all.

A query starts at all roots at once: one priority queue holds the branches of all trees, nearest
first by the sum of squared distances to the thresholds that lie between, and gives leaves until
these hold ``budget`` vectors. The leaves' members are then scored exactly, in double precision.
The budget isn't fixed: it is measured, as the smallest one at which at least RECALL of the true
neighbours of a sample of queries (QUERY_SAMPLE, found by brute force) are reached.

Work is dealt out by buckets of neighbouring leaves with CHUNK_ROWS members together; a leaf that
has more alone is cut into chunks, and so are the queries of a bucket. A task sees one chunk of each and returns
the best of a query's leaves in it. Only thresholds, directions and leaf sizes are sent to all
tasks: 2^MAX_DEPTH numbers a tree at most. Of vectors that are equal, one is indexed, with its
smallest k + 1 ids; of queries whose vectors are equal, one is searched. A floor for each query's
scores, from those of the sample that lie in its leaves, keeps leaves from sending what can't be among the nearest found.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
rows without an id; vectors of different lengths are never compared (each length has a forest of its own); a row repeated
under its id counts once; an id with several vectors is a candidate with each of them, and each of its
vectors is a query; a row's own id is never found; ties go to the smaller id; with fewer than k
candidates all are returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.common import save, scratch

K, QUERIES_BY, SEED, TREES = 20, 20, 12, 8
#: Distinct vectors of a leaf, levels of a tree, members and queries that a task scores against each other.
LEAF_ROWS, MAX_DEPTH, CHUNK_ROWS, CHUNK_QUERIES = 256, 12, 20_000, 20_000
#: Bytes of vectors that thresholds are fitted on, and rows of these from which floors are taken.
FIT_BYTES, FLOOR_ROWS = 32_000_000, 8192
#: Queries whose true neighbours are looked for, and the share of these that the budget has to reach.
QUERY_SAMPLE, RECALL = 256, 0.95


@dataclass(frozen=True)
class Forest:
    """directions [tree, level, component], thresholds [tree, node] (nodes of a level behind those of the one above), longest: the largest length of a vector."""

    directions: np.ndarray
    thresholds: np.ndarray
    longest: float

    @property
    def trees(self) -> int:
        return len(self.directions)

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.column_stack([vectors, rest])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        shadows = np.einsum("nc,tlc->tnl", self.lifted(vectors), self.directions, optimize=True)
        node = np.zeros(shadows.shape[:2], np.int64)
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (shadows[:, :, level] > np.take_along_axis(self.thresholds, at, 1))
        return node.T

    def shadows(self, queries: np.ndarray) -> np.ndarray:
        """[query, tree, level]: projections of queries, stretched to the largest length."""
        scale = self.longest / np.sqrt(np.einsum("ij,ij->i", queries, queries))
        return np.einsum("nc,tlc->ntl", queries * scale[:, None], self.directions[:, :, :-1], optimize=True)

    def search(self, shadows: np.ndarray, sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """(tree, leaf) nearest first, from one queue for all trees, until they hold ``budget`` vectors. shadows: of one query; sizes [tree, leaf]."""
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        found, held = [], 0
        shadows, thresholds, depth = shadows.tolist(), self.thresholds, self.depth
        while queue and held < budget:
            far, tree, level, node = heapq.heappop(queue)
            while level < depth:  # down on the query's own side; the other side waits in the queue
                gap = shadows[tree][level] - float(thresholds[tree, 2**level - 1 + node])
                side = gap > 0
                heapq.heappush(queue, (far + gap * gap, tree, level + 1, 2 * node + (not side)))
                level, node = level + 1, 2 * node + side
            found.append((tree, node))
            held += int(sizes[tree, node])
        return found


def fit(sample: np.ndarray, longest: float, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
    """A forest whose leaves hold about ``leaf_rows`` of ``rows`` vectors; its thresholds are medians over ``sample``."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows / leaf_rows)))), max(0, int(math.log2(max(1, len(sample) / 4)))))
    directions = np.random.default_rng(seed).normal(size=(trees, depth, sample.shape[1] + 1))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(directions, np.zeros((trees, 2**depth - 1)), longest)
    lifted = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            shadow, order = lifted @ directions[t, level], np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange(2**level + 1))
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    forest.thresholds[t, 2**level - 1 + i] = np.median(shadow[order[a:b]])
            node = 2 * node + (shadow > forest.thresholds[t, 2**level - 1 + node])
    return forest


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def scores_of(query: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Inner products whose last digit doesn't depend on what else is scored with them."""
    return (members * query).sum(axis=1)


def _pairs(queries: pa.Table, vectors: np.ndarray, reps: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, rep, score of each query's k best in its leaves, by score, then rep; ``leaf``, of the members, is sorted.

    A first pass by matrix products leaves out what can't be among the k best of a leaf or is below the floor.
    """
    asked, ids, floors = _matrix(queries["vector"]), np.asarray(queries["rep"]), np.asarray(queries["floor"])
    lists = queries["leaves"].combine_chunks()
    who, where = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
    order = np.argsort(where, kind="stable")
    some_q, some_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        first, last = np.searchsorted(leaf, where[part[0]] + np.arange(2)) if len(part) else (0, 0)
        if first == last:
            continue
        rough = asked[who[part]] @ vectors[first:last].T
        least = floors[who[part]]
        if last - first > k:
            least = np.maximum(least, np.partition(rough, last - first - k, axis=1)[:, last - first - k])
        q, m = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(rough).max(axis=1)))[:, None])
        some_q.append(who[part][q])
        some_m.append(m + first)
    q, m = np.concatenate(some_q), np.concatenate(some_m)
    scores = scores_of(asked[q], vectors[m])
    order = np.lexsort((reps[m], -scores, q))
    q, m, scores = q[order], m[order], scores[order]
    starts = np.searchsorted(q, q)
    best = np.arange(len(q)) - starts < k
    return ids[q[best]], reps[m[best]], scores[best]


def _buckets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each leaf (neighbours in a tree, CHUNK_ROWS members together), and of each bucket into how many chunks it is cut: more than one only if a leaf alone has more."""
    of, held = [], [0]
    for tree in sizes.tolist():
        for i, n in enumerate(tree):
            if of and (i == 0 or held[-1] + n > CHUNK_ROWS):
                held.append(0)
            held[-1] += n
            of.append(len(held) - 1)
    return np.array(of), np.maximum(1, -(-np.array(held) // CHUNK_ROWS))


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """rep, ids, vector: of equal vectors one, with the k + 1 smallest ids, the first of which is rep. A group sends no more than that from each task."""
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    some = vectors.withColumn("_n", F.dense_rank().over(smallest)).filter(F.col("_n") <= k + 1)
    return some.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")


def _sample(reps: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, by a hash of rep."""
    return reps if total <= rows else reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def true_neighbours(reps: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """query, rep, vector: the k distinct vectors nearest to each of a few queries (rep, vector), by brute force over all rows."""
    every = queries.append_column("leaves", pa.array([[0]] * len(queries), pa.list_(pa.int32()))).append_column("floor", pa.array(np.full(len(queries), -np.inf)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.asarray(b["rep"])
                ids, found, scores = _pairs(every, _matrix(b["vector"]), own, np.zeros(len(own), np.int64), k)
                at = np.argsort(own)
                rows = at[np.searchsorted(own, found, sorter=at)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(scores), b["vector"].take(pa.array(rows))], ["query", "rep", "score", "vector"])

    kind = reps.schema["vector"].dataType.simpleString()
    found = reps.select("rep", "vector").mapInArrow(work, f"query long, rep long, score double, vector {kind}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).select("query", "rep", "vector")


def measured_budget(forest: Forest, sizes: np.ndarray, queries: pa.Table, neighbours: pa.Table, recall: float = RECALL) -> int:
    """The smallest budget at which the shared queue reaches ``recall`` of the sampled queries' true neighbours."""
    if not len(queries):
        return 0
    rows = {q: i for i, q in enumerate(queries["rep"].to_pylist())}
    shadows = forest.shadows(_matrix(queries["vector"]))
    far = np.zeros((len(rows), forest.trees, 1))
    for level in range(forest.depth):
        gap = shadows[:, :, level, None] - forest.thresholds[None, :, 2**level - 1 : 2 ** (level + 1) - 1]
        other = gap * gap
        far = np.stack([far + np.where(gap > 0, other, 0.0), far + np.where(gap > 0, 0.0, other)], axis=3).reshape(len(rows), forest.trees, -1)
    flat, held = far.reshape(len(rows), -1), sizes.reshape(-1)
    order = np.argsort(flat, axis=1, kind="stable")
    reached = np.empty_like(order)
    np.put_along_axis(reached, order, np.cumsum(held[order], axis=1), 1)
    who = np.array([rows[q] for q in neighbours["query"].to_pylist()])
    leaves = forest.leaves(_matrix(neighbours["vector"])) + np.arange(forest.trees) * sizes.shape[1]
    needed = np.sort(reached[who[:, None], leaves].min(axis=1))
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)])


def _of_one_length(reps: DataFrame, queries: DataFrame, k: int, recall: float) -> DataFrame:
    """query (a rep of ``queries``), rep, ids, score: the k + 1 nearest distinct vectors found of all ``reps``, whose vectors have one length."""
    spark = reps.sparkSession
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest, width = reps.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.max(F.size("vector"))).first()
    rows = max(1024, FIT_BYTES // (4 * width))
    sample = _matrix(_sample(reps.select("rep", "vector"), rows, total).orderBy(F.xxhash64("rep"), "rep").select("vector").limit(2 * rows).toArrow()["vector"])
    forest, near, kind = fit(sample, longest, total), k + 1, reps.schema["vector"].dataType.simpleString()
    shape = (forest.trees, 2**forest.depth)
    floor_rows = sample[:FLOOR_ROWS]
    floor_leaves = forest.leaves(floor_rows) + np.arange(forest.trees) * shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.leaves(_matrix(b["vector"])) + np.arange(forest.trees) * shape[1]
                yield pa.RecordBatch.from_arrays([b["rep"], pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))], ["rep", "leaves"])

    # Leaves are numbered over all trees.
    members = save(reps.select("rep", "vector").mapInArrow(placed, "rep long, leaves array<int>"), "leaves")
    counts = members.df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    sizes = np.zeros(shape[0] * shape[1], np.int64)
    sizes[np.asarray(counts["leaf"])] = np.asarray(counts["count"])
    sizes = sizes.reshape(shape)
    some = queries.orderBy(F.xxhash64("rep"), "rep").limit(QUERY_SAMPLE).toArrow()
    budget = measured_budget(forest, sizes, some, true_neighbours(reps, some, near).toArrow() if len(some) else some, recall)

    def floor(scores: np.ndarray, hits: list[int]) -> float:
        """The last of the best scores of sampled vectors that lie in the leaves that were reached."""
        reached = np.zeros(sizes.size, bool)
        reached[hits] = True
        scores = scores[reached[floor_leaves].any(axis=1)]
        return float(np.partition(scores, len(scores) - near)[len(scores) - near]) if len(scores) >= near else -np.inf

    buckets, chunks_of = _buckets(sizes)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            if b.num_rows:
                vectors = _matrix(b["vector"])
                for rep, row, scores in zip(b["rep"].to_pylist(), forest.shadows(vectors), vectors @ floor_rows.T):
                    hits = np.sort([t * shape[1] + n for t, n in forest.search(row, sizes, budget)])
                    cuts = np.flatnonzero(np.diff(buckets[hits])) + 1
                    rows += [(rep, int(buckets[part[0]]), part, floor(scores, hits)) for part in np.split(hits, cuts)]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64()))], ["rep", "bucket", "leaves", "floor"])

    hits = save(queries.select("rep", "vector").repartition("rep").mapInArrow(searched, "rep long, bucket int, leaves array<int>, floor double"), "hits")
    asked = hits.df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("_q"))
    known = spark.createDataFrame([(i, int(x), int(chunks_of[x])) for i, x in enumerate(buckets)], "leaf int, bucket int, _m int")
    dealt = F.broadcast(scratch(known.join(asked, "bucket"), "buckets"))  # at most TREES * 2^MAX_DEPTH rows
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = members.df.join(reps.select("rep", "vector"), "rep").select("rep", "vector", F.explode("leaves").alias("leaf")).join(dealt, "leaf")
    left = left.select("bucket", spread(F.col("_m")).alias("m"), every(F.col("_q")).alias("q"), "leaf", "rep", "vector")
    right = hits.df.join(queries.select("rep", "vector"), "rep").join(F.broadcast(dealt.select("bucket", "_m", "_q").distinct()), "bucket")
    right = right.select("bucket", every(F.col("_m")).alias("m"), spread(F.col("_q")).alias("q"), "leaves", "rep", "vector", "floor")

    def scored(members: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(members) and len(queries):
            members = members.sort_by("leaf")
            vectors, own, leaf = _matrix(members["vector"]), np.asarray(members["rep"]), np.asarray(members["leaf"])
            for start in range(0, len(queries), 256):
                found.append(_pairs(queries.slice(start, 256), vectors, own, leaf, near))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], ["query", "rep", "score"])

    keys = ("bucket", "m", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= near)
    return found.join(reps.select("rep", "ids"), "rep").select("query", "rep", "ids", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of all rows of ``vectors`` (vec_id, vector) for those that ``queries`` is true for."""
    rows = vectors.select("vec_id", "vector", F.coalesce(queries, F.lit(False)).alias("_asked")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    reps = scratch(distinct_vectors(rows, k), "vectors")
    asking = scratch(rows.filter("_asked").select(F.col("vec_id").alias("query_id"), "vector").distinct().join(reps.select("rep", "vector"), "vector"), "asking")
    asked = scratch(asking.dropDuplicates(["rep"]).select("rep", "vector"), "asked")
    lengths = sorted(r[0] for r in reps.select(F.size("vector")).distinct().collect())
    of = lambda df, n: df if len(lengths) == 1 else df.filter(F.size("vector") == n)
    if not lengths:
        return asking.select("query_id", F.lit(1).alias("rank"), F.col("rep").alias("vec_id"), F.lit(0.0).alias("score"))
    found = reduce(DataFrame.unionByName, (_of_one_length(of(reps, n), of(asked, n), k, recall) for n in lengths))
    lists = found.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    one = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("i")))))
    mine = asking.join(lists.select("query", F.sort_array(one).alias("near")), F.col("rep") == F.col("query"))
    mine = mine.select("query_id", F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.i").alias("vec_id"), (-F.col("col.s")).alias("score"))


def op12_nearest_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, F.pmod("vec_id", F.lit(QUERIES_BY)) == 0)
