"""The automaton against looking for each name."""

import random

import pytest

from placeloom.operators import group, itinerary, patterns


def test_automaton_finds_all_names():
    r = random.Random(8)
    for _ in range(300):
        names = sorted({"".join(r.choice("abá😀") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 30))})
        automaton = patterns.Automaton(names)
        for _ in range(20):
            text = "".join(r.choice("abá😀c") for _ in range(r.randrange(0, 40)))
            assert {names[i] for i in automaton.found(text)} == {n for n in names if n in text}
    assert patterns.Automaton([]).found("abc") == set()


@pytest.mark.parametrize("shards, chars", [(16, None), (16, 5), (0, None)])
def test_contained_and_shortest(spark, monkeypatch, shards, chars):
    if chars:
        monkeypatch.setattr(patterns, "NAME_CHARS", chars)
        monkeypatch.setattr(itinerary, "PIECE", 8)
    names = ["ring", "ri", "in", "", None, "ring", "old ring", "gear", "é"]
    texts = [(1, "the old ring"), (1, "the old ring"), (2, None), (3, ""), (4, "g" * 50 + "gear" + "é" * 20), (5, "none")]
    df = spark.createDataFrame([(*x, "clash") for x in texts], "id int, text string, name string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(map(tuple, itinerary.contained(df, known, "id", shards=99 if chars else shards).collect()))
    assert got == sorted({(i, n) for i, t in texts for n in names if n and t and n in t})
    assert itinerary.contained(df, known.limit(0), "id", shards=shards).count() == 0
    short = dict(map(tuple, group.shortest_substring(known, shards=99 if chars else shards).collect()))
    assert short == {"ring": "in", "ri": "ri", "in": "in", "old ring": "in", "gear": "gear", "é": "é"}
