"""The index in blocks against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import impact, index, retrieve


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    draw = lambda: words[min(59, int(r.expovariate(0.12)))]
    return [(i, " ".join(draw() for _ in range(r.choice((0, 1, 3, 8, 30, 200)))) or None, r.choice(("a", "b", None))) for i in range(n)]


SCHEMA = "id long, text string, city string"
ASKED = [(1, "w0 w1", "a"), (2, "w30 w3 w3 w40", "b"), (3, "w59", "a"), (4, "unknown", "a"), (5, "", "b"), (6, None, "a"), (7, " ".join(f"w{i}" for i in range(40)), "a"), (8, "w5", "nowhere")]


def rows(df):
    return sorted((x.query_id, x["rank"], x.id, round(x.score, 6)) for x in df.collect())


@pytest.mark.parametrize("city", [False, True])
def test_equals_scoring_everything(spark, tmp_path, monkeypatch, city):
    monkeypatch.setattr(impact, "RANGE_DOCS", 8)
    docs = spark.createDataFrame(corpus(1, 700), SCHEMA)
    queries = spark.createDataFrame([(*x, x[0] + 2) for x in ASKED], "query_id long, query string, city string, many int")
    made = impact.add_documents(docs, str(tmp_path), group="city")
    whole = index.bm25_index(docs)
    for k in (10, "many") if city else (1,):
        assert rows(retrieve.bm25_topk(made, queries, k, docs if city else None)) == rows(retrieve.bm25_topk(whole, queries, k, docs if city else None))


def test_batches_equal_a_rebuild(spark, tmp_path):
    data = corpus(2, 300)
    queries = spark.createDataFrame(ASKED, "query_id long, query string, city string")
    for a, b in ((0, 40), (40, 90), (90, 300), (300, 300)):
        made = impact.add_documents(spark.createDataFrame(data[a:b], SCHEMA), str(tmp_path / "grown"), group="city")
    whole = index.bm25_index(spark.createDataFrame(data, SCHEMA))
    assert rows(impact.top(made, queries, 15)) == rows(retrieve.bm25_topk(whole, queries, 15))
    segments = impact._segments(spark, str(tmp_path / "grown"))
    assert len({impact._class(r.docs) for r in segments}) == len(segments) and sum(r.docs for r in segments) == 300


def test_bounds_hold_and_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impact, "RANGE_DOCS", 8)
    docs = spark.createDataFrame(corpus(3, 1500), SCHEMA)
    queries = spark.createDataFrame([(1, "w45 w50", "a"), (2, "w58", "a"), (3, "w2 w20 w44", "a")], "query_id long, query string, city string")
    made = impact.add_documents(docs, str(tmp_path))
    asked = impact.asked_terms(made, queries)
    seen = impact.ranges_to_read(made, asked, queries, 3).collect()
    best = {(x.query_id, x.range): x.best for x in impact._scores(made, asked, impact.range_bounds(made, asked)).join(made.blocks.select("range", F.explode("postings.id").alias("id")).distinct(), "id").groupBy("query_id", "range").agg(F.max("score").alias("best")).collect()}
    assert all(best[x.query_id, x.range] <= x.bound + 1e-9 for x in seen)
    assert 0 < sum(x.n for x in seen if x.read) < 0.6 * sum(x.n for x in seen)


def test_empty_and_words(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, "长江", "a")], "query_id long, query string, city string")
    assert impact.top(impact.add_documents(none, str(tmp_path / "none")), queries, 3).count() == 0
    with pytest.raises(ValueError):
        impact.read(spark, str(tmp_path / "nowhere"))
    lexicon = spark.createDataFrame([("长江", 20), ("大桥", 20), ("江大", 1)], "word string, freq long")
    docs = spark.createDataFrame([(1, "长江大桥", "a"), (2, "江大", "a"), (3, "大桥", "b"), (4, "x y", "b"), (5, "z", "b")], SCHEMA)
    impact.add_documents(docs, str(tmp_path / "cut"), lexicon=lexicon)
    made = impact.add_documents(docs.withColumn("id", F.col("id") + 10), str(tmp_path / "cut"))
    assert [x.id for x in impact.top(made, queries, 5).orderBy("rank").collect()] == [1, 11]
    index.write_bm25_index(docs, str(tmp_path / "plain"), lexicon=lexicon)
    assert [x.id for x in retrieve.bm25_topk(index.Bm25Index.read(spark, str(tmp_path / "plain")), queries, 5).collect()] == [1]


def test_postings_travel_once(spark, tmp_path, monkeypatch):
    """Of the two tables written, the terms need the texts' exchange only, and the blocks one of postings by ranges of terms."""
    from pyspark.sql import readwriter

    plans, write = {}, readwriter.DataFrameWriter.parquet
    monkeypatch.setattr(readwriter.DataFrameWriter, "parquet", lambda self, at, *more, **how: (plans.update({at: self._df._jdf.queryExecution().executedPlan().toString()}), write(self, at, *more, **how))[1])
    docs = spark.createDataFrame(corpus(4, 200), SCHEMA)
    impact.add_documents(docs, str(tmp_path), group="city")
    parts, blocks = (next(p for at, p in plans.items() if f"{tmp_path}/{name}/" in at) for name in ("parts", "blocks"))
    assert parts.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in parts
    of_postings = [line for line in blocks.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert sum("rangepartitioning" in line for line in of_postings) == 1 and not any("hashpartitioning(term" in line for line in of_postings)
