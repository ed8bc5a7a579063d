"""Tables sent to all tasks: stated queries or centres in blocks of a checked size, names once they have been counted."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; with a vector of 1,000 numbers each, a block takes about 40 MB.
BLOCK_ROWS = 5_000

#: Rows of one short string that are broadcast once they have been counted; some 20 MB.
NAME_ROWS = 200_000


def if_few(names: DataFrame, rows: int = NAME_ROWS) -> DataFrame:
    """``names`` with a broadcast hint if it is counted to have at most ``rows`` rows; else as it is, for a join that shuffles both sides."""
    return F.broadcast(names) if names.count() <= rows else names


def against(rows: DataFrame, table: DataFrame, key: str, on=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which is counted first and broadcast one block after the other.

    The rows stay where they are, and no more than a block is in memory, however large the table is.
    """
    n = max(1, math.ceil(table.count() / block_rows))
    parts = [table] if n == 1 else [table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.unionByName, (rows.join(F.broadcast(p), on) for p in parts))
