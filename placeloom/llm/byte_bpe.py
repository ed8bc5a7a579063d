"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Instead of encoding word by word, all words that a task meets for the first time in some millions
of characters of its partition are laid out one after another, and an inverted index holds, for
each merge, the positions where it applies. The merges are replayed in rank order; each touches
only its positions and their neighbours, whose new pairs enter the index. Words met again come from
a cache of bounded size. The corpus of a replay is a partition, or as much of it as memory is to
hold: tasks share nothing, so no word count or vocabulary passes through the driver or a shuffle.

The result equals that of the tiktoken library for the same ranks and pattern, without special
tokens; ids decode to exactly the bytes that were encoded.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded alike; very
long texts are encoded whole; input columns named like an output column give way to it; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import documents, laid_out, set_aside

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words in a generation of a worker's cache, and characters of text whose new words are replayed together.
CACHED_WORDS, CHUNK_CHARS = 300_000, 4_000_000
#: Positions from which a merge is applied by array operations.
MANY_SPOTS = 24
EDGE, GONE = -1, -2

# Fixed value: the public word pattern of the vocabulary; with it, a blank before a word belongs to the word.
BLANK_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Cache(dict):
    """Ids of strings; what isn't asked for in a whole generation is forgotten."""

    older: dict[str, tuple[int, ...]] = {}

    def __contains__(self, key) -> bool:
        if dict.__contains__(self, key):
            return True
        if (found := self.older.get(key)) is None:
            return False
        self[key] = found
        return True

    def turn(self) -> None:
        """Begin a new generation once this one is full."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes with the ranks of one file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.width = len(self.bytes_of)
        self.decimal = [str(i) for i in range(self.width)]
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.merged = np.fromiter(map(pairs.__getitem__, self.keys.tolist()), np.int64, len(pairs))
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.cut_at_blanks = pattern == BLANK_FIRST
        self.apart = regex.compile(r"[\s\x1c-\x1f] [\s\x1c-\x1f]").search
        self.units, self.words = Cache(), Cache()

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, EDGE where there is none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.merged[at], EDGE)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word: every merge in rank order over all words at once.

        A merge with many positions is applied to all of them by array operations, one with few
        (or with overlapping ones, which go from left to right) position by position.
        """
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        symbols = np.full(int(ends[-1]) + 1, EDGE)
        inside = np.ones(len(symbols), bool)
        inside[0] = False
        inside[ends] = False
        symbols[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        index: dict[int, list] = {}  # rank -> positions (numbers, or arrays of them) of its left symbol
        queue: list[int] = []

        def enter(spots: np.ndarray, ranks: np.ndarray) -> None:
            spots, ranks = spots[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    held = index.get(rank := int(ranks[a]))
                    if held is None:
                        index[rank] = [spots[a:b]]
                        heapq.heappush(queue, rank)
                    else:
                        held.append(spots[a:b])

        enter(np.arange(len(symbols) - 1), self._merged(symbols[:-1], symbols[1:]))
        sym, nxt, prv, pair, width = memoryview(symbols), memoryview(after), memoryview(before), self.pairs.get, self.width
        marked = np.zeros(len(symbols) + 1, bool)
        while queue:
            rank = heapq.heappop(queue)
            held = index.pop(rank)
            if sum(1 if type(x) is int else len(x) for x in held) >= MANY_SPOTS:
                numbers = [x for x in held if type(x) is int]
                at = np.unique(np.concatenate([x for x in held if type(x) is not int] + [np.array(numbers, np.int64)]))
                at = at[symbols[at] >= 0]
                at = at[self._merged(symbols[at], symbols[after[at]]) == rank]
                right = after[at]
                marked[at] = True
                overlap = marked[right].any()
                marked[at] = False
                if not overlap:
                    symbols[at], symbols[right] = rank, GONE
                    beyond = after[right]
                    after[at], before[beyond] = beyond, at
                    left = before[at]
                    ranks = np.full(len(at), rank)
                    enter(np.concatenate([left, at]), np.concatenate([self._merged(symbols[left], ranks), self._merged(ranks, symbols[beyond])]))
                    continue
                some = at.tolist()
            else:
                some = set()
                for x in held:
                    some.add(x) if type(x) is int else some.update(x.tolist())
            for i in sorted(some):
                a, j = sym[i], nxt[i]
                if a < 0 or (b := sym[j]) < 0 or pair(a * width + b) != rank:
                    continue
                sym[i], sym[j] = rank, GONE
                k = nxt[i] = nxt[j]
                prv[k] = i
                h = prv[i]
                if (a := sym[h]) >= 0 and (new := pair(a * width + rank)) is not None:
                    if (spots := index.get(new)) is None:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    else:
                        spots.append(h)
                if (b := sym[k]) >= 0 and (new := pair(rank * width + b)) is not None:
                    if (spots := index.get(new)) is None:
                        index[new] = [i]
                        heapq.heappush(queue, new)
                    else:
                        spots.append(i)
        alive = symbols >= 0
        counts = np.add.reduceat(alive, np.concatenate([[0], ends[:-1]]))
        ids, found, start = symbols[alive].tolist(), [], 0
        for n in counts.tolist():
            found.append(tuple(ids[start : start + n]))
            start += n
        return found

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._units(text))
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _units(self, text: str) -> list[str]:
        """Parts of a text that can be split into words each by itself.

        A blank always belongs to what follows it, so the text may be cut before every blank;
        only where a blank stands between white space do words reach across.
        """
        if not self.cut_at_blanks or self.apart(text):
            return self.split(text)
        first, *rest = text.split(" ")
        units = [" " + x for x in rest]
        if first:
            units.insert(0, first)
        return units

    def _encode(self, held: list[list[str]]) -> Iterator[list[int]]:
        units, words = self.units, self.words
        fresh = [u for u in set(chain.from_iterable(held)) if u not in units]
        split = dict(zip(fresh, map(self.split, fresh)))
        new = [w for w in set(chain.from_iterable(split.values())) if w not in words]
        raw = [w.encode() for w in new]
        whole = [self.ranks.get(b) for b in raw]
        for w, r in zip(new, whole):
            if r is not None:
                words[w] = (r,)
        rest = [i for i, r in enumerate(whole) if r is None]
        for i, ids in zip(rest, self.replay([raw[i] for i in rest])):
            words[new[i]] = ids
        for u, parts in split.items():
            units[u] = words[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(words.__getitem__, parts)))
        for parts in held:
            yield list(chain.from_iterable(map(units.__getitem__, parts)))
        units.turn()
        words.turn()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _map(df: DataFrame, column: str, made: dict[str, tuple[str, pa.DataType]], row, path: str) -> DataFrame:
    """``df`` with the columns ``made`` (Spark type, Arrow type), from row(codec, values of ``column``) -> tuples."""
    kept = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]
    pattern = _pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = row(c, chain.from_iterable(part.column(column).to_pylist() for part in held))
            for part in held:
                values = zip(*islice(rows, part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(v, kind) for v, (_, kind) in zip(values, made.values()))], [*kept, *made])

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                held.append(batch.slice(start, 512))
                size += held[-1].column(column).nbytes
                if size >= CHUNK_CHARS:
                    yield from done(held)
                    held, size = [], 0
        yield from done(held)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"{k} {v[0]}" for k, v in made.items())])
    return df.mapInArrow(work, schema)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int) and n_tokens."""

    def row(c, texts):
        for ids in c.encode(x or "" for x in texts):
            yield ids, len(ids)

    return _map(docs, "text", {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64())}, row, path or vocabulary_path())


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with ids) with the decoded bytes."""

    def row(c, lists):
        for ids in lists:
            yield (c.decode(ids or ()),)

    return _map(encoded, "ids", {"decoded": ("binary", pa.binary())}, row, path or vocabulary_path())


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids and n_tokens, and with the text that the ids decode to in place of the text; a null one stays null."""

    def row(c, texts):
        texts = list(texts)
        for text, ids in zip(texts, c.encode(x or "" for x in texts)):
            yield None if text is None else c.decode(ids).decode(), ids, len(ids)

    made = {"_decoded": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64())}
    columns = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    rest = set_aside(docs.select(*columns), "text")
    return laid_out(_map(rest, "text", made, row, path or vocabulary_path()).drop("text").withColumnRenamed("_decoded", "text"), columns, ("text",), ids=F.col("ids"), n_tokens=F.col("n_tokens"))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and digests of the ids and of the bytes they decode to, without moving the ids to the JVM."""

    def row(c, texts):
        decimal = c.decimal
        for ids in c.encode(x or "" for x in texts):
            yield len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    made = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _map(docs, "text", made, row, path or vocabulary_path())


def op6_byte_bpe(spark, sf_dir):
    return token_digests(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
