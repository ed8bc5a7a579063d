"""Segmentation against all ways of cutting short strings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import segment

SCALE = 1_000_000


def whole(p):
    return round(math.log(p) * SCALE)


def cuts(s):
    if not s:
        yield ()
    for n in range(len(s), 0, -1):
        for rest in cuts(s[n:]):
            yield (s[:n], *rest)


def model(freq):
    """The model's weights, counted word by word."""
    n = [{}, {}, {}, {}]
    for w, f in freq.items():
        for i, c in enumerate(w):
            s = 3 if len(w) == 1 else 0 if i == 0 else 2 if i == len(w) - 1 else 1
            n[s][c] = n[s].get(c, 0) + f
    kinds, total = len(set("".join(freq))), sum(freq.values())
    ones = sum(f for w, f in freq.items() if len(w) == 1)
    long = sum(f for w, f in freq.items() if len(w) > 2)
    inner = sum(f * (len(w) - 3) for w, f in freq.items() if len(w) > 2)
    only, on, more = (ones + 0.5) / (total + 1), (long + 0.5) / (total - ones + 1), (inner + 0.5) / (inner + long + 1)
    emit = lambda s, c: whole((n[s].get(c, 0) + 0.5) / (sum(n[s].values()) + 0.5 * (kinds + 1)))

    def score(words):
        total = 0
        for w in words:
            if len(w) == 1:
                total += whole(only) + emit(3, w)
            else:
                total += whole(1 - only) + emit(0, w[0]) + emit(2, w[-1]) + sum(emit(1, c) for c in w[1:-1])
                total += whole(1 - on) if len(w) == 2 else whole(on) + whole(more) * (len(w) - 3) + whole(1 - more)
        return total

    return score


def plain(run, freq):
    total = sum(freq.values())
    weigh = lambda ws: sum(whole(freq.get(w, 1) / max(total, 1)) for w in ws)
    best = max((c for c in cuts(run) if all(len(w) == 1 or w in freq for w in c)), key=lambda c: (weigh(c), [len(w) for w in c]))
    out, held, score = [], "", model(freq)

    def flush():
        nonlocal held
        if len(held) == 1:
            out.append({(held,)})
        elif held:
            top = max(map(score, cuts(held)))
            out.append({c for c in cuts(held) if score(c) == top})
        held = ""

    for w in best:
        if len(w) == 1:
            held += w
        else:
            flush()
            out.append({(w,)})
    flush()
    return out


def agree(got, parts):
    """Whether the words got are, part by part, one of the best ways."""
    for ways in parts:
        taken = next((w for w in ways if tuple(got[: len(w)]) == w), None)
        if taken is None:
            return False
        got = got[len(taken) :]
    return not got


@pytest.mark.parametrize("seed", range(3))
def test_every_run_is_cut_best(spark, seed):
    r = random.Random(seed)
    letters = "江湖楼阁山水𠀀"
    freq = {"".join(r.choice(letters) for _ in range(r.choice((1, 2, 2, 3, 4)))): r.randrange(1, 50) for _ in range(25)} if seed else {}
    runs = sorted({"".join(r.choice(letters + "天") for _ in range(r.randrange(1, 11))) for _ in range(80)})
    known = segment.dictionary(spark.createDataFrame([*freq.items()], "word string, freq long"))
    out = {}
    for x in sorted(segment.cut_runs(spark.createDataFrame([(x,) for x in runs], "run string"), known).collect(), key=lambda x: (x.run, x.start)):
        out.setdefault(x.run, []).append(x.word)
    assert out.keys() == set(runs)
    for run, words in out.items():
        assert "".join(words) == run and agree(words, plain(run, freq)), (run, words, plain(run, freq))


def test_texts_and_cases(spark):
    known = segment.dictionary(spark.createDataFrame([("黄鹤楼", 50), ("鹤楼", 3), ("长江", 20), ("长江", 10), ("大桥", 20), ("江大", 4), ("bad", 9), ("零", 0), (None, 4), ("空", None)], "word string, freq long"))
    rows = [(1, "黄鹤楼在长江大桥 WiFi5G，长江大桥"), (2, None), (3, ""), (4, " ，"), (5, "abc"), (6, "黄鹤楼" * 400)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id int, text string, word string")
    out = {}
    for x in sorted(segment.segment(df, known, "text", "id").collect(), key=lambda x: (x.id, x.piece, x.start)):
        out.setdefault(x.id, []).append(x.word)
    assert out == {1: ["黄鹤楼", "在", "长江", "大桥", "wifi5g", "长江", "大桥"], 5: ["abc"], 6: ["黄鹤楼"] * 400}
    assert segment.segment(df.limit(0), known, "text", "id").count() == 0


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("长江 20 n\n大桥 7\n\nnothing\n", encoding="utf-8")
    assert sorted(map(tuple, segment.read_dictionary(spark, str(tmp_path / "words.txt")).collect())) == [("大桥", 7.0), ("长江", 20.0)]
    assert segment.dictionary(spark.range(0).select(F.lit("x").alias("word"), F.col("id").alias("freq"))).words.count() == 0
