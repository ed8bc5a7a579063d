"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

A document's set of word shingles becomes a signature of 28 components of 16 bits, each from one
minimum hash. Two signatures are apart by the number of components that differ. The signature is
split into 7 chunks of 4 components; by the pigeonhole principle, signatures that differ in no
more than 13 components have a chunk with one difference at most. Enumerating that error (masking
each component of a chunk in turn) gives 28 keys a document, and all pairs under the distance of
13 share a key, whatever their distance elsewhere. At a similarity of 0.85 components differ with
probability 0.15, and a pair shares no key with probability 2e-7 (6e-6 at 0.8).

Documents of equal sets are one class and take part once. Members of a key's bucket aren't paired
with each other: they are compared with the bucket's centre, on full sets. Buckets whose members
then lie in one component are done; the others are compared with another centre. Members of buckets
that are still apart after that are compared across components, but only if they can be similar:
of two similar sets each has one of their common elements among its rarest ones (as many as may be
missing in the other, and one more), so pairs are joined on those elements, with bounds on sizes
and places. A large bucket of documents that share much but not enough mostly has rare elements of each
one's own, and makes hardly a pair. Where documents draw from a common pool of phrases they share rare elements, too:
a sketch of each set (the parity of its elements in each of 512 cells) goes with these, and the join writes
only pairs whose sketches allow the similarity. Before sets are fetched, a bitmap of each set refuses pairs
whose sets must differ in too many elements. Links, classes and components stay in tables.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle has one shingle, all its words; doc_id identifies a document: rows repeated
under one doc_id are one node; a null doc_id can't be linked with but joins the class of its equals, and of rows without doc_id
all stay if one does; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import counted_broadcast, documents, save, scratch
from placeloom.llm.components import components

CHUNKS, IN_CHUNK, BITS = 7, 4, 16
#: The signature distance under which all pairs are found, with one error allowed in a chunk.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Words of a shingle and percent of similarity, where a caller doesn't say otherwise.
SHINGLE, PERCENT = 5, 80
#: Rounds of comparisons with a centre before what is still apart is joined on its rarest elements.
CENTRES = 2
#: Cells of the bitmap by which pairs that cannot be similar are refused before their sets are fetched.
BITMAP = 2048
#: Cells of the sketch that refuses pairs in the join on rare elements, before they are written.
SKETCH = 512
#: Documents whose sets a task holds at once, and elements hashed at once; both bound a worker's memory.
ROWS, ELEMENTS = 128, 1 << 12

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**63, CHUNKS * IN_CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 2**63, CHUNKS * IN_CHUNK, dtype=np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; only A to Z are lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    found = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[j : j + n]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x94D049BB133111EB)
    return np.unique(found ^ (found >> np.uint64(29)))


def signature(found: np.ndarray) -> np.ndarray:
    """The chunks of a set's signature, as 64-bit integers of four components each."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(found), ELEMENTS):
        least = np.minimum(least, ((found[start : start + ELEMENTS, None] ^ _MASKS) * _FACTORS).min(axis=0))
    short = (least ^ (least >> np.uint64(32))) & np.uint64((1 << BITS) - 1)
    shifts = (np.uint64(1) << (np.arange(IN_CHUNK, dtype=np.uint64) * np.uint64(BITS)))
    return (short.reshape(CHUNKS, IN_CHUNK) * shifts).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _batches(df: DataFrame, schema: str, kinds: list[pa.DataType], row) -> DataFrame:
    """row(text) -> values, for each row of ``df`` (doc_id, text); doc_id comes first in the result."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = [row(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (set_a, set_b) and its signature (c0 to c6)."""

    def row(text):
        import xxhash

        found = shingles(text, size)
        digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
        return (len(found), *digest.tolist(), *(signature(found).tolist() if len(found) else [0] * CHUNKS))

    columns = ["n_shingles", "set_a", "set_b", *(f"c{i}" for i in range(CHUNKS))]
    return _batches(docs, ", ".join(f"{c} long" for c in columns), [pa.int64()] * len(columns), row)


def _keys(classes: DataFrame) -> DataFrame:
    """key, rep, n (size of the set): a chunk with one component masked, the mask's number in its place."""
    made = []
    for i in range(CHUNKS):
        for j in range(IN_CHUNK):
            mask = int((~np.uint64(((1 << BITS) - 1) << (j * BITS))).astype(np.int64))
            number = (i * IN_CHUNK + j + 1) << (j * BITS)
            made.append(F.col(f"c{i}").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(number)))
    return classes.select(F.explode(F.array_distinct(F.array(*made))).alias("key"), "rep", F.col("n_shingles").alias("n"))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which of BITMAP cells the elements of a set fall into, as 64-bit integers."""
    cells = np.zeros(BITMAP, bool)
    cells[(found & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(cells).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the elements of a set falls into each of SKETCH cells, as 64-bit integers."""
    cells = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(cells.astype(bool)).view(np.int64)


def _sizes(percent: int) -> Column:
    """Whether sets of x_n and y_n elements can be similar enough."""
    return F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent


def _may_link(percent: int, cells: int = BITMAP) -> Column:
    """Whether two sets (size x_n and bitmap or sketch x; y_n, y) can be similar enough: a cell that differs (filled by only one of
    them, or of another parity) stands for an element that only one has, so no similar pair is ever refused."""
    apart = reduce(lambda s, i: s + F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))), range(1, cells // 64), F.bit_count(F.get("x", F.lit(0)).bitwiseXOR(F.get("y", F.lit(0)))))
    return apart * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)


def _rarest(sets: DataFrame, members: DataFrame, percent: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """rep, component, n, e, at and the ``carried`` columns of ``sets``: the elements, and their places by rarity, of which each similar pair of ``members`` (rep, component) shares one.

    An element that one member alone has counts for the places, but is left out.
    """
    elements = sets.join(counted_broadcast(members), sets["doc_id"] == members["rep"]).select("rep", "component", "n", *carried, F.explode("found").alias("e"))
    counted = elements.join(elements.groupBy("e").agg(F.count(F.lit(1)).alias("c")), "e")
    ordered = counted.groupBy("rep", "component", "n").agg(*(F.first(c).alias(c) for c in carried), F.sort_array(F.collect_list(F.struct("c", "e"))).alias("es"))
    needed = F.floor((F.col("n") * percent + 99) / 100)
    first = ordered.select("rep", "component", "n", *carried, F.posexplode(F.slice("es", F.lit(1), (F.col("n") - needed + 1).cast("int"))).alias("at", "x"))
    return first.filter(F.col("x.c") > 1).select("rep", "component", "n", *carried, F.col("x.e").alias("e"), "at")


def _pairs_of(rare: DataFrame, percent: int) -> DataFrame:
    """rep, x_n, o, y_n: pairs of ``rare`` that share an element and can be similar by their sizes, places and sketches; one row for each shared element."""
    x = rare.select("e", "rep", "component", F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("sketch").alias("x"))
    y = rare.select("e", F.col("rep").alias("o"), F.col("component").alias("oc"), F.col("n").alias("y_n"), F.col("at").alias("y_at"), F.col("sketch").alias("y"))
    room = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    both = x.join(y, "e").filter((F.col("component") < F.col("oc")) & _sizes(percent) & room & _may_link(percent, SKETCH))
    return both.select("rep", "x_n", "o", "y_n")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, centres: int = CENTRES) -> DataFrame:
    """a, b: links between representatives of classes, enough for the components of all links."""
    keys = _keys(classes)
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_members")).filter(F.col("n_members") > 1).select("key")
    members = save(keys.join(buckets, "key"), "members")
    ids = scratch(members.df.select(F.col("rep").alias("_rep")).distinct(), "ids")
    some = docs.join(counted_broadcast(ids), docs["doc_id"] == ids["_rep"], "left_semi")

    def row(text):
        found = shingles(text, size)
        return found.view(np.int64), len(found), bitmap(found), sketch(found)

    longs = pa.list_(pa.int64())
    sets = scratch(_batches(some, "found array<long>, n long, bits array<long>, sketch array<long>", [longs, pa.int64(), longs, longs], row), "sets")

    def side(node: str, into: str, column: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(node), F.col(column).alias(into))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct ``pairs`` (a, x_n, b, y_n) those that are similar enough on their full sets; bitmaps go first."""
        likely = pairs.join(side("a", "x", "bits"), "a").join(side("b", "y", "bits"), "b").filter(_may_link(percent))
        likely = save(likely.select("a", "b"), "likely")
        both = F.size(F.array_intersect("x", "y"))
        rest = F.size("x") + F.size("y") - both
        found = scratch(likely.df.join(side("a", "x", "found"), "a").join(side("b", "y", "found"), "b").filter(both * 100 >= rest * percent).select("a", "b"), "confirmed")
        likely.drop()
        return found

    def ordered(pairs: DataFrame) -> DataFrame:
        """a < b with their sizes, each pair once, from rep, x_n, o, y_n."""
        turned = F.col("rep") > F.col("o")
        one = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
        return scratch(pairs.select(one("rep", "o").alias("a"), one("x_n", "y_n").alias("x_n"), one("o", "rep").alias("b"), one("y_n", "x_n").alias("y_n")).distinct(), "pairs")

    known = save(members.df.withColumn("component", F.col("rep")), "open")
    members.drop()
    found: DataFrame | None = None
    for turn in range(centres):
        # One centre for each bucket that has several components, by an order of its own each turn.
        rank = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
        picked = known.df.groupBy("key").agg(F.min(rank).alias("pick"))
        centre = known.df.join(picked, "key").filter(rank == F.col("pick")).select("key", F.col("rep").alias("o"), F.col("n").alias("y_n"), F.col("component").alias("oc"))
        pairs = known.df.withColumnRenamed("n", "x_n").join(centre, "key").filter((F.col("component") != F.col("oc")) & _sizes(percent))
        new = confirmed(ordered(pairs))
        found = new if found is None else found.union(new)
        labels = components(found)
        moved = known.df.drop("component").join(labels, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
        apart = moved.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter(F.col("c") != F.col("d")).select("key")
        earlier, known = known, save(moved.join(apart, "key"), "open")
        earlier.drop()
    # What is left after that: pairs across components that share one of their rarest elements.
    apart = scratch(known.df.select("rep", "component").distinct(), "apart")
    known.drop()
    rare = scratch(_rarest(sets, apart, percent, ("sketch",)), "rarest")
    new = confirmed(ordered(_pairs_of(rare, percent)))
    return new if found is None else found.union(new)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, centres: int = CENTRES) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for each row of ``docs``."""
    each = scratch(signed(docs, size), "signatures")
    chunks = [f"c{i}" for i in range(CHUNKS)]
    classes = each.filter(F.col("n_shingles") > 0).groupBy("set_a", "set_b", "n_shingles", *chunks).agg(F.min("doc_id").alias("rep"))
    classes = scratch(classes, "classes")
    nodes = classes.filter(F.col("rep").isNotNull())
    labels = components(links(docs, nodes, size, percent, centres))
    groups = classes.join(labels, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "rep", F.coalesce("component", "rep").alias("component"))
    rows = each.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b"], "left")
    own = F.col("n_shingles") == 0
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select(
        "doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, as they are: one document of each group of near duplicates."""
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def op3_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
