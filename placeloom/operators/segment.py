"""Words of texts that are written without spaces: the most probable path through a word graph, and a hidden Markov model for what the dictionary doesn't know.

A dictionary is a table (word, freq). Every run of ideographs is a graph whose edges are the
dictionary's words in it and its single characters; the path of the largest probability wins, ties
go to the longer first word. The graph falls apart at every place that no word spans, so only the
islands in between, which are as long as words overlap, are solved by dynamic programming, as one
fold each. Two or more single characters in a row are then cut by a model of four states (first,
middle, last, only character of a word) whose probabilities are counted from the dictionary.

All of it is joins by position and expressions: runs that are equal are cut once, edges come from an
equi-join with the dictionary, islands from a running maximum. Weights are whole millionths
of a natural logarithm, so sums are exact and ties are the same on every way of counting.

Defined cases: a null or empty text has no words; white space and punctuation separate; other runs of letters and digits are
words as they stand, in lower case; a word that is listed twice has both frequencies; words
without a positive frequency, and those that aren't ideographs throughout, count as not listed; with an empty dictionary the
model cuts every run by its smoothed, equal probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions.text import or_empty
from placeloom.operators.blocks import if_few

#: The parts of a logarithm that are told apart, and what is added to every count of the model.
SCALE, SMOOTH = 1_000_000, 0.5
STATES = ("first", "middle", "last", "only")
#: Which states may follow which, by their numbers.
FOLLOWS = {0: (1, 2), 1: (1, 2), 2: (0, 3), 3: (0, 3)}


def weight(probability: Column) -> Column:
    return F.round(F.log(probability) * SCALE).cast("long")


@dataclass(frozen=True)
class Dictionary:
    """words (word, weight), single (weight of a character that isn't listed), characters (c, emit: a weight per state), unseen (that of other characters) and steps ({(state, next): weight}, with -1 for the start)."""

    words: DataFrame
    single: int
    characters: DataFrame
    unseen: list[int]
    steps: dict[tuple[int, int], int]


def dictionary(listed: DataFrame) -> Dictionary:
    """The weights of a table (word, freq). A few sums reach the driver."""
    known = listed.filter(F.col("word").rlike(r"^\p{IsHan}+$") & (F.col("freq") > 0)).groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
    n = F.length("word")
    at = F.posexplode(characters(F.col("word"))).alias("i", "c")
    state = F.when(n == 1, 3).when(F.col("i") == 0, 0).when(F.col("i") == n - 1, 2).otherwise(1)
    each = known.select("word", "freq", at).select("c", "freq", state.alias("state"))
    counts = each.groupBy("c").agg(*(F.sum(F.when(F.col("state") == s, F.col("freq")).otherwise(0.0)).alias(f"n{s}") for s in range(4)))
    total, ones, inner, long, *held = known.agg(F.sum("freq"), F.sum(F.when(n == 1, F.col("freq"))), F.sum(F.when(n > 2, F.col("freq") * (n - 3))), F.sum(F.when(n > 2, F.col("freq")))).crossJoin(counts.agg(F.count(F.lit(1)), *(F.sum(f"n{s}") for s in range(4)))).first()
    total, ones, inner, long, (kinds, *sums) = total or 0.0, ones or 0.0, inner or 0.0, long or 0.0, [x or 0 for x in held]
    emit = F.array(*(weight((F.col(f"n{s}") + SMOOTH) / F.lit(sums[s] + SMOOTH * (kinds + 1))) for s in range(4)))
    only = (ones + SMOOTH) / (total + 2 * SMOOTH)
    several = total - ones
    on = (long + SMOOTH) / (several + 2 * SMOOTH)  # a word of several characters has one in its middle
    more = (inner + SMOOTH) / (inner + long + 2 * SMOOTH)  # and then another
    odds = {(-1, 0): 1 - only, (-1, 3): only, (2, 0): 1 - only, (2, 3): only, (3, 0): 1 - only, (3, 3): only, (0, 1): on, (0, 2): 1 - on, (1, 1): more, (1, 2): 1 - more}
    import math

    whole = lambda p: round(math.log(p) * SCALE)
    unseen = [whole(SMOOTH / (x + SMOOTH * (kinds + 1))) for x in sums]
    words = known.select("word", weight(F.col("freq") / F.lit(total or 1.0)).alias("weight"))
    return Dictionary(words, whole(1 / max(total, 1.0)), counts.select("c", emit.alias("emit")), unseen, {k: whole(p) for k, p in odds.items()})


def characters(text: Column) -> Column:
    """Its code points, in order, of a text that isn't empty."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def pieces(text: Column) -> Column:
    """The runs of ideographs and of other letters and digits, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def islands(runs: DataFrame, known: Dictionary) -> DataFrame:
    """run, start, edges: parts of runs that words hold together, with their words (at, n, weight) by place; at counts from the island's start.

    Every place of a run is in one island; one that no word spans is an island of its own.
    """
    lengths = F.broadcast(known.words.agg(F.coalesce(F.collect_set(F.length("word")), F.array().cast("array<int>")).alias("_n")))  # as many numbers as lengths exist
    place = F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("at")
    spans = runs.select("run", place).join(lengths).select("run", "at", F.explode(F.filter("_n", lambda n: n + F.col("at") <= F.length("run"))).alias("n"))
    found = spans.select("run", "at", "n", F.substr("run", F.col("at") + 1, F.col("n")).alias("word")).join(if_few(known.words), "word").select("run", "at", "n", "weight")
    alone = runs.select("run", place).select("run", "at", F.lit(1).alias("n"), F.lit(known.single).cast("long").alias("weight"))
    edges = found.unionByName(alone).groupBy("run", "at", "n").agg(F.max("weight").alias("weight"))  # a listed character outweighs an unlisted one: no frequency is below 1 in a total
    here = edges.groupBy("run", "at").agg(F.sort_array(F.collect_list(F.struct("n", "weight"))).alias("words"), (F.col("at") + F.max("n")).alias("reach"))
    before = Window.partitionBy("run").orderBy("at")
    begins = F.coalesce(F.max("reach").over(before.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("at"), F.lit(True))
    marked = here.withColumn("start", F.when(begins, F.col("at"))).withColumn("start", F.last("start", ignorenulls=True).over(before))
    return marked.groupBy("run", "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]).alias("edges"))


def best_path(edges: Column) -> Column:
    """The lengths of the words on the path of the largest weight; ``edges``: per place the words (n, weight) that begin there."""
    # From the last place to the first: the best weight of the rest, with the length of its first word. Held in reverse order, the end first.
    end = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n")))
    step = lambda done, words: F.concat(done, F.array(F.array_max(F.transform(words, lambda x: F.struct((x["weight"] + F.element_at(done, F.size(done) + 1 - x["n"])["w"]).alias("w"), x["n"].alias("n"))))))
    first = F.reverse(F.transform(F.aggregate(F.reverse(edges), end, step), lambda x: x["n"]))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("cut"))
    walk = F.aggregate(F.sequence(F.lit(0), F.size(edges) - 1), start, lambda s, i: F.when(i == s["next"], F.struct((i + F.get(first, i)).alias("next"), F.concat(s["cut"], F.array(F.get(first, i))).alias("cut"))).otherwise(s))
    return walk["cut"]


def _viterbi(emits: Column, known: Dictionary) -> Column:
    """The state of each character on the most probable path; ``emits``: an array of the states' weights per character."""
    step, low = known.steps, -(1 << 60)
    best = lambda options: F.array_max(F.array(*options))
    whole = lambda x: F.lit(x).cast("long")
    begin = F.struct(F.array(*(whole(step[-1, s]) + F.get(emits, F.lit(0))[s] if (-1, s) in step else whole(low) for s in range(4))).alias("w"), F.array().cast("array<array<int>>").alias("back"))

    def on(s: Column, emit: Column) -> Column:
        came = [best(F.struct((s["w"][p] + step[p, q]).alias("w"), F.lit(p).alias("p")) for p in range(4) if (p, q) in step) for q in range(4)]
        return F.struct(F.array(*(c["w"] + emit[q] for q, c in enumerate(came))).alias("w"), F.concat(s["back"], F.array(F.array(*(c["p"] for c in came)))).alias("back"))

    done = F.aggregate(F.slice(emits, 2, F.size(emits)), begin, on)
    last = F.when(done["w"][2] > done["w"][3], 2).otherwise(3)
    path = F.aggregate(F.reverse(done["back"]), F.array(last), lambda found, back: F.concat(found, F.array(F.get(back, F.element_at(found, -1)))))
    return F.reverse(path)


def unknown_words(runs: DataFrame, known: Dictionary) -> DataFrame:
    """run, start, n: the words of runs of characters, cut by the model."""
    each = runs.select("run", F.posexplode(characters(F.col("run"))).alias("i", "c"))
    seen = each.join(F.broadcast(known.characters), "c", "left")  # a row per character of Unicode at most
    emits = seen.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("emit", F.array(*(F.lit(x).cast("long") for x in known.unseen))).alias("e")))), lambda x: x["e"]).alias("emits"))
    states = emits.select("run", _viterbi(F.col("emits"), known).alias("states"))
    starts = F.filter(F.sequence(F.lit(0), F.size("states") - 1), lambda i: F.get("states", i).isin(0, 3))
    ends = F.concat(F.slice(F.col("starts"), 2, F.size("starts")), F.array(F.length("run")))
    cut = states.select("run", starts.alias("starts")).select("run", F.explode(F.arrays_zip(F.col("starts").alias("start"), ends.alias("end"))).alias("x"))
    return cut.select("run", F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n"))


def cut_runs(runs: DataFrame, known: Dictionary) -> DataFrame:
    """run, start, word of distinct runs of ideographs (run)."""
    parts = islands(runs, known)
    path = parts.select("run", "start", best_path(F.col("edges")).alias("cut"))
    starts = F.transform(F.sequence(F.lit(0), F.size("cut") - 1), lambda i: F.aggregate(F.slice("cut", F.lit(1), i), F.col("start"), lambda a, b: a + b))
    words = path.select("run", F.explode(F.arrays_zip(starts.alias("start"), F.col("cut").alias("n"))).alias("x")).select("run", "x.start", "x.n")
    # Single characters in a row have the same distance between their place and their number.
    ones = words.filter("n = 1").withColumn("group", F.col("start") - F.row_number().over(Window.partitionBy("run").orderBy("start")))
    rows = ones.groupBy("run", "group").agg(F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("n"))
    unknown = rows.filter("n > 1").withColumn("piece", F.substr("run", F.col("start") + 1, F.col("n")))
    cut = unknown_words(unknown.select(F.col("piece").alias("run")).distinct(), known).select(F.col("run").alias("piece"), F.col("start").alias("from"), F.col("n").alias("long"))
    cut = unknown.join(cut, "piece").select("run", (F.col("start") + F.col("from")).alias("start"), F.col("long").alias("n"))
    whole = words.filter("n > 1").unionByName(rows.filter("n = 1").select("run", "start", "n")).unionByName(cut)
    return whole.select("run", "start", F.substr("run", F.col("start") + 1, F.col("n")).alias("word"))


def segment(texts: DataFrame, known: Dictionary, text: str = "text", *keys: str) -> DataFrame:
    """keys, piece, start, word: the words of each text in the order of (piece, start)."""
    each = texts.select(*keys, F.posexplode(pieces(F.col(text))).alias("piece", "run"))
    han = F.col("run").rlike(r"^\p{IsHan}")
    cut = cut_runs(each.filter(han).select("run").distinct(), known)
    plain = each.filter(~han).select(*keys, "piece", F.lit(0).alias("start"), F.col("run").alias("word"))
    return each.filter(han).join(cut, "run").select(*keys, "piece", "start", "word").unionByName(plain)


def read_dictionary(spark, path: str) -> DataFrame:
    """word, freq of a text file with a word and its frequency on each line, in any number of columns after these; lines without a number are left out."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).try_cast("double").alias("freq"))
    return rows.filter((F.col("word") != "") & F.col("freq").isNotNull())
