"""Fill-in-middle transformation over ropes.

A text is a rope: a balanced tree whose leaves hold pieces of it and whose nodes cache how many
units (``[A-Za-z]+|[^A-Za-z]``) begin in them and how many code points they hold. A text is split
at two unit ranks, the subtrees are concatenated anew with sentinels between them, and the
transformation is undone by splitting the output's rope at its sentinels. A split or a
concatenation touches only the nodes of one path, however long the text is.

Which units end the prefix and the middle, and which form a document gets, follows from a digest of
its id alone, so reruns agree. A text that holds a sentinel stays plain, so the sentinels of a
transformed text are the only ones in it.

Defined cases: a null text counts as empty, and an empty one is plain; a null doc_id is digested
as the empty string; repeated rows get the same output; any text is one row's work in one task,
held there a few times over, and its letters may form one unit of any length; columns other than
those asked for stay as they are, those named like an output column give way; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placeloom.llm.common import documents

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED = "1"
#: Of 100 documents, how many may be transformed, and how many of these lead with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a leaf.
LEAF = 4096


def unit_starts(text: str, after_letter: bool = False) -> np.ndarray:
    """The places of ``text`` where a unit begins; ``after_letter``: what precedes the text is a letter."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = points | 32
    letter = (low >= 97) & (low <= 122)
    inside = np.empty_like(letter)
    inside[:1] = after_letter
    inside[1:] = letter[:-1]
    return np.flatnonzero(~(letter & inside))


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or an inner node (left, right). ``continues``: a leaf's first code point follows a letter."""

    units: int
    points: int
    text: str = ""
    continues: bool = False
    left: Rope | None = None
    right: Rope | None = None

    def pieces(self) -> Iterator[str]:
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                yield node.text
            else:
                open_ += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.pieces())


def leaf(text: str, continues: bool = False, units: int | None = None) -> Rope:
    return Rope(len(unit_starts(text, continues)) if units is None else units, len(text), text, continues)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of ``text``."""
    starts = unit_starts(text)
    edges = np.arange(0, len(text) + size, size)
    counts = np.diff(np.searchsorted(starts, edges)).tolist()
    nodes = [leaf(text[a : a + size], a > 0 and text[a - 1].isascii() and text[a - 1].isalpha(), n) for a, n in zip(edges.tolist(), counts)] or [leaf("")]
    while len(nodes) > 1:
        pairs = [join(*nodes[i : i + 2]) for i in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0]


def join(*ropes: Rope) -> Rope:
    """The concatenation; every unit stays one of its own."""
    whole = ropes[0]
    for r in ropes[1:]:
        whole = r if not whole.points else whole if not r.points else Rope(whole.units + r.units, whole.points + r.points, left=whole, right=r)
    return whole


def split_units(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """``r`` before and from the unit of this rank (counted from 0) on."""
    if rank >= r.units:
        return r, leaf("")
    if r.left is None:
        # Code points that continue a unit of an earlier leaf stay with it.
        at = int(unit_starts(r.text, r.continues)[rank]) if rank or r.continues else 0
        return leaf(r.text[:at], r.continues, rank), leaf(r.text[at:], False, r.units - rank)
    if rank < r.left.units:
        a, b = split_units(r.left, rank)
        return a, join(b, r.right)
    a, b = split_units(r.right, rank - r.left.units)
    return join(r.left, a), b


def split_points(r: Rope, at: int) -> tuple[Rope, Rope]:
    """``r`` before and from this code point (counted from 0) on."""
    if at >= r.points:
        return r, leaf("")
    if at <= 0:
        return leaf(""), r
    if r.left is None:
        before = leaf(r.text[:at], r.continues)
        last = r.text[at - 1]
        return before, leaf(r.text[at:], last.isascii() and last.isalpha(), r.units - before.units)
    if at < r.left.points:
        a, b = split_points(r.left, at)
        return a, join(b, r.right)
    a, b = split_points(r.right, at - r.left.points)
    return join(r.left, a), b


def draws(doc_id: object, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits that follow from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


@dataclass(frozen=True, slots=True)
class Filled:
    """A transformed text: its units, its form (plain, psm, spm), the code points of prefix and middle (None if plain), and the output."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def fill_in_middle(doc_id: object, text: str | None, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> Filled:
    """``text`` with its middle moved to the end, behind sentinels, or as it is."""
    text = text or ""
    whole, (h1, h2, h3, h4) = rope(text), draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= transformed:
        return Filled(whole.units, "plain", None, None, text)
    low, high = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    rest, suffix = split_units(whole, high)
    prefix, middle = split_units(rest, low)
    p, s, m = map(leaf, SENTINELS)
    form, parts = ("spm", (s, suffix, p, prefix)) if h4 % 100 < suffix_first else ("psm", (p, prefix, s, suffix))
    return Filled(whole.units, form, prefix.points, middle.points, str(join(*parts, m, middle)))


def restore(output: str, form: str) -> str:
    """The text again, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    rest, middle = split_points(rope(output), output.index(MIDDLE))
    one, two = split_points(rest, output.index(second))
    one, two, middle = (split_points(r, len(mark))[1] for r, mark in ((one, first), (two, second), (middle, MIDDLE)))
    return str(join(two, middle, one) if form == "spm" else join(one, middle, two))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


FIELDS = {"n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64())}


def _map(docs: DataFrame, made: dict[str, tuple[str, pa.DataType]], row, drop_text: bool) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in {m.lower() for m in made} and not (drop_text and c == "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [row(i, part["text"][k].as_py()) for k, i in enumerate(part["doc_id"].to_pylist())]
                columns = zip(*rows) if rows else ([] for _ in made)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, kind) for v, (_, kind) in zip(columns, made.values()))], [*kept, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{k} {v[0]}" for k, v in made.items())])
    return docs.mapInArrow(work, schema)


def transform_documents(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output (text)."""

    def row(doc_id, text):
        f = fill_in_middle(doc_id, text, seed, transformed, suffix_first)
        return f.n, f.form, f.prefix_chars, f.middle_chars, f.output

    return _map(docs, FIELDS | {"output": ("string", pa.string())}, row, False)


def transform_digests(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` without their text, with n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""

    def row(doc_id, text):
        f = fill_in_middle(doc_id, text, seed)
        return f.n, f.form, f.prefix_chars, f.middle_chars, sha(f.output), sha(restore(f.output, f.form))

    return _map(docs, FIELDS | {"output_sha256": ("string", pa.string()), "restored_sha256": ("string", pa.string())}, row, True)


def op13_fill_in_middle(spark, sf_dir):
    return transform_digests(documents(spark, sf_dir).select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || x[i:i + 7])::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
