"""Quality rules: base counts, and the divergence of a document's histograms from its language's.

A document has a histogram of character classes and one of the common words of its language. The
references are the sums of the histograms of all documents of that language that pass the base
rules and are long enough, if they are MIN_REFERENCE or more. A document is rejected if the Jensen-Shannon distance (base 2, from 0
to 1) of either histogram from its reference is above a threshold. Documents of fewer words than
the guard aren't judged by their histograms, as theirs are too thin.

Defined cases: a null text has no words, so it fails the base rules; a language that isn't in
COMMON_WORDS has its own reference, of characters only; documents whose language is null or has too
few good documents aren't judged by histograms; repeated rows are judged alike; an empty table
gives an empty result; input columns named like an output column give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import counted_broadcast, documents, scratch

MIN_WORDS, MAX_REPEATED = 20, 0.30
#: Words a document needs for its histograms to count, and the largest distances of a good document.
#: A short document's word histogram strays by chance, so its limit is wider by SLACK over its words.
GUARD_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, SLACK = 50, 0.30, 0.27, 5.0

#: Good documents that a language's reference needs, and the references (some 500 bytes each) that a join may broadcast.
MIN_REFERENCE, BROADCAST_REFERENCES = 10, 10_000

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he at from are or an this his but have had they which".split(),
    "fr": "de la le et les des en un une du que qui dans est pour au pas sur par plus ne se ce il avec ou son sa".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este".split(),
}
#: Documents that a task holds at once.
ROWS = 512
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
PUNCTUATION, SYMBOLS, SPACES = ".,;:!?'\"()-", "#*$%&|<>", " \t\n\x0b\x0c\r"


def _class_of_byte() -> np.ndarray:
    """The class of each byte that starts a character; 7 for the others."""
    found = np.full(256, 5)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, PUNCTUATION)):
        found[[ord(c) for c in chars]] = i
    found[128:192], found[192:] = 7, 6
    return found


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` words that stand in the text twice or more."""
    import xxhash

    n = len(words) - size + 1
    if n < 2:
        return 0
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    window = np.zeros(n, np.uint64)
    for j in range(size):
        window = window * np.uint64(0x9E3779B97F4A7C15) + (each[j : j + n] ^ (each[j : j + n] >> np.uint64(31)))
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    steps = np.zeros(len(words) + 1, np.int64)
    steps[starts] += 1
    steps[starts + size] -= 1
    return int((np.cumsum(steps) > 0).sum())


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _chars array<long>, _common array<long>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, common = _class_of_byte(), {k: [w.encode() for w in v] for k, v in COMMON_WORDS.items()}
    for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
        rows = []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            text = text or ""
            raw = text.encode()
            words = raw.split()
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            kinds = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=8) if raw else np.zeros(8, np.int64)
            seen = Counter(raw.lower().split()) if lang in common else {}
            hits = [seen.get(w, 0) for w in common.get(lang, ())]
            rows.append((len(words), int(len(text) - kinds[3]), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), kinds[:7].tolist(), [*hits, len(words) - sum(hits)]))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        found = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)]
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), *found], [*(n for n in batch.schema.names if n != "text"), *(f.split()[0] for f in FEATURES.split(", "))])


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts from a reference of equally many numbers; 0 if either is all zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x: F.transform(x, lambda v: v / total(x))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(share(counts), share(reference), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms)))).otherwise(0.0)


def measured(docs: DataFrame) -> DataFrame:
    """The columns doc_id and lang of ``docs`` with base counts and histograms; one pass over the texts."""
    slim = docs.select("doc_id", "lang", "text")
    return slim.mapInArrow(_measure, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang string, {FEATURES}")


def judged(features: DataFrame) -> DataFrame:
    """``features`` with base_failed, both distances and kept.

    The references are one row per language with enough good documents.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    rows = features.withColumn("base_failed", failed)
    good = rows.filter(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    bins = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))).cast("double") for i in range(n)))
    refs = good.groupBy(F.col("lang").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), bins("_chars", len(CLASSES)).alias("_ref_chars"), bins("_common", 1 + max(map(len, COMMON_WORDS.values()))).alias("_ref_common"))
    refs = scratch(refs.filter((F.col("_n") >= MIN_REFERENCE) & F.col("_key").isNotNull()).drop("_n"), "references")
    rows = rows.join(counted_broadcast(refs, BROADCAST_REFERENCES), rows["lang"] == refs["_key"], "left")
    common = F.slice("_ref_common", F.lit(1), F.size("_common"))
    apart = {c: F.coalesce(distance(F.transform(x, lambda v: v.cast("double")), ref), F.lit(0.0)) for c, x, ref in (("char_distance", F.col("_chars"), F.col("_ref_chars")), ("word_distance", F.col("_common"), common))}
    rows = rows.withColumns(apart)
    odd = (F.col("n_words") >= GUARD_WORDS) & ((F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE + SLACK / F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd).drop("_key", "_ref_chars", "_ref_common")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    features = scratch(measured(docs), "features")
    verdicts = judged(features).groupBy("doc_id").agg(F.bool_and("kept").alias("_kept")).filter("_kept").select(F.col("doc_id").alias("_id"))
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts["_id"]), "left_semi")


def op9_quality_rules(spark, sf_dir):
    features = scratch(measured(documents(spark, sf_dir)), "features")
    return judged(features).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """DuckDB SQL for op9: the same counts by regular expressions, the same distances by joins of histogram bins."""
    word = r"[^\x20\x09-\x0D]+"
    kinds = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\x22()\x2D]", r"[#$%&*+/<=>@\[\x5C\]^_`{|}~\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]")
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}'))"
    langs = ", ".join(f"('{k}', {i}, '{w}')" for k, ws in COMMON_WORDS.items() for i, w in enumerate(ws))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT r, lang, unnest(regexp_extract_all(t, '{word}')) AS w, generate_subscripts(regexp_extract_all(t, '{word}'), 1) AS i FROM d),
g AS (SELECT r, i, lead(i, 7) OVER o AS e, concat_ws(' ', w, {", ".join(f"lead(w, {j}) OVER o" for j in range(1, 8))}) AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, g FROM g WHERE e IS NOT NULL GROUP BY r, g HAVING count(*) > 1),
p AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT g.r, unnest(range(i, i + 8)) AS p FROM g JOIN f ON g.r = f.r AND g.g = f.g WHERE e IS NOT NULL) GROUP BY r),
l AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY r),
b AS (SELECT d.r, doc_id, lang, t, {count(word)}::BIGINT AS n_words, (length(t) - {count(kinds[3])})::BIGINT AS word_chars, {count(r"[#*$%&|<>]")}::BIGINT AS n_symbols,
      coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l ON d.r = l.r LEFT JOIN p ON d.r = p.r),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEATED)} * n_words AS base_failed FROM b),
v(lang, k, w) AS (VALUES {langs}),
h AS (SELECT w.r, v.k, count(*)::DOUBLE AS n FROM w JOIN v ON w.lang = v.lang AND translate(w.w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = v.w GROUP BY ALL),
c AS (SELECT r, 0 AS kind, unnest(range(7)) AS k, unnest([{", ".join(count(k) for k in kinds)}])::DOUBLE AS n FROM d
  UNION ALL SELECT r, 1, k, n FROM h UNION ALL SELECT x.r, 1, 99, n_words - coalesce(sum(n), 0) FROM x LEFT JOIN h ON x.r = h.r GROUP BY x.r, n_words),
gl AS (SELECT lang FROM x WHERE NOT base_failed AND n_words >= {GUARD_WORDS} AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}),
q AS (SELECT x.lang, kind, k, sum(n) AS n FROM c JOIN x ON c.r = x.r JOIN gl ON x.lang = gl.lang WHERE NOT base_failed AND n_words >= {GUARD_WORDS} GROUP BY ALL),
q1 AS (SELECT lang, kind, k, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM q),
dp AS (SELECT x.r, x.lang, z.kind, z.k, z.q FROM x JOIN q1 z ON x.lang = z.lang WHERE n_words >= {GUARD_WORDS}),
dk AS (SELECT dp.*, coalesce(c.n, 0) / s.n AS p FROM dp LEFT JOIN c ON dp.r = c.r AND dp.kind = c.kind AND dp.k = c.k JOIN (SELECT r, kind, sum(n) AS n FROM c GROUP BY ALL) s ON dp.r = s.r AND dp.kind = s.kind WHERE s.n > 0),
js AS (SELECT r, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js FROM dk GROUP BY ALL),
o AS (SELECT r, max(js) FILTER (kind = 0) AS jc, max(js) FILTER (kind = 1) AS jw FROM js GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {GUARD_WORDS} AND (coalesce(jc, 0) > {MAX_CHAR_DISTANCE} OR coalesce(jw, 0) > {MAX_WORD_DISTANCE} + {SLACK} / n_words)) AS kept
FROM x LEFT JOIN o ON x.r = o.r
"""


OP9_SQL = _sql()
