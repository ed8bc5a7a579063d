"""Which of many names a text contains, in one pass over it: an automaton with failure links, built from counted names.

The names of a shard (NAME_CHARS characters together) become a trie whose nodes point to their
longest proper suffix that is a node too, so a scan never goes back in the text and its time doesn't
depend on the number of names. Names are sent to the tasks shard by shard, texts stay where they are;
nothing but what is found is shuffled.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of names in one automaton, some 100 bytes of memory each in a task, and automata that texts are scanned with one after the other.
NAME_CHARS, SHARDS = 2_000_000, 16


class Automaton:
    """``found(text)`` gives the numbers of the names that it contains."""

    def __init__(self, names: list[str]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # the name that ends in a node
        for i, name in enumerate(names):
            node = 0
            for c in name:
                if (after := self.goto[node].get(c)) is None:
                    after = self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append(-1)
                node = after
            self.ends[node] = i
        self.fail, self.shorter = [0] * len(self.goto), [0] * len(self.goto)  # the longest suffix, and the longest one where a name ends
        queue = deque(self.goto[0].values())
        while queue:
            node = queue.popleft()
            for c, after in self.goto[node].items():
                queue.append(after)
                back = self.fail[node]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[after] = self.goto[back].get(c, 0)
            back = self.fail[node]
            self.shorter[node] = back if self.ends[back] >= 0 else self.shorter[back]

    def found(self, text: str) -> set[int]:
        goto, fail, ends, shorter = self.goto, self.fail, self.ends, self.shorter
        root, node, seen, nodes = goto[0], 0, set(), set()
        for c in text:
            while node and c not in goto[node]:
                node = fail[node]
            node = goto[node].get(c, 0) if node else root.get(c, 0)
            if node and node not in nodes:  # a node that was met has said all it can
                nodes.add(node)
                at = node if ends[node] >= 0 else shorter[node]
                while at and ends[at] not in seen:
                    seen.add(ends[at])
                    at = shorter[at]
        return seen


@lru_cache(maxsize=2)
def _automaton(key: str, names) -> Automaton:
    return Automaton(names.value)


def shards(names: DataFrame, most: int = SHARDS, chars: int | None = None) -> list[DataFrame] | None:
    """``names`` (name, distinct) by a hash, in parts of about ``chars`` characters; None if that makes more than ``most``."""
    total = names.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    n = -(-total // (chars or NAME_CHARS))
    if n > most:
        return None
    return [names] if n <= 1 else [names.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == i) for i in range(n)]


def contained(texts: DataFrame, parts: list[DataFrame], *keys: str) -> DataFrame:
    """keys, name: the names of all parts that each text (keys, text) contains, once per row."""
    context = texts.sparkSession.sparkContext
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema), "name string"])

    def scan(part: DataFrame) -> DataFrame:
        listed, key = context.broadcast(sorted(r.name for r in part.select("name").collect())), uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(key, listed), listed.value
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch["text"]):
                    if text.is_valid:
                        found = automaton.found(text.as_py())
                        rows += [i] * len(found)
                        hits += [names[x] for x in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in keys), pa.array(hits, pa.string())], [*keys, "name"])

        return texts.select(*keys, "text").mapInArrow(work, schema)

    return reduce(DataFrame.unionByName, map(scan, parts))
