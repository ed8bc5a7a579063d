"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in its own order (an offset and a stride from a
digest of its name). The shards take turns; at its turn a shard claims the next slot in its order
that is still free, so all get nearly equally many, and when a shard is added or removed few slots
change hands. The table has a fixed number of slots, whatever the data; it is broadcast, and a
document finds its shard by one hash and one lookup, without a shuffle.

Defined cases: a null key hashes like any value, so all such rows share a shard; repeated keys
always share one; an empty table gives an empty result; input columns named slot or shard give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import documents, replace_columns

SLOTS = 65_537  # a prime; the table's rows
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The shard's number for each slot."""
    if not shards or slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, at least one for each shard, is needed")
    digest = [hashlib.blake2b(s.encode(), digest_size=16).digest() for s in shards]
    spot = [int.from_bytes(d[:8], "little") % slots for d in digest]
    stride = [int.from_bytes(d[8:], "little") % (slots - 1) + 1 for d in digest]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[spot[i]] >= 0:
                spot[i] = (spot[i] + stride[i]) % slots
            table[spot[i]] = i
            left -= 1
    return tuple(table)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard."""
    names = tuple(shards)
    table = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(names, slots))], "_slot int, _shard string")
    placed = replace_columns(df, slot=F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int"))
    joined = placed.join(F.broadcast(table), placed["slot"] == table["_slot"])
    return joined.select(*(placed[c] for c in placed.columns if c.lower() != "shard"), table["_shard"].alias("shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", parts: int = 4, **options) -> None:
    """One folder per shard, each written by ``parts`` tasks, so that no task holds a whole shard."""
    placed = assign_shards(df, key, **options)
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(parts))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    return assign_shards(documents(spark, sf_dir)).select("doc_id", "slot", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
