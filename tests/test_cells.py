"""The index of vectors against brute force."""

import numpy as np
import pytest

from placeloom.operators import cells, retrieve


def ranked(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x["rank"])):
        out.setdefault(x.query_id, []).append((x.id, round(x.distance, 9)))
    return out


@pytest.mark.parametrize("city", [False, True])
def test_recall_and_exact_distances(spark, tmp_path, monkeypatch, city):
    monkeypatch.setattr(cells, "CHUNK", 30)
    r = np.random.default_rng(1)
    mid = r.normal(size=(20, 10)) * 3
    rows = [(i, [float(x) for x in mid[i % 20] + r.normal(size=10)], ("a", "b", None)[i % 3]) for i in range(900)] + [(900 + i, [1.0] * 10, "a") for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>, city string")
    queries = vectors.filter("id % 50 = 0").selectExpr("id AS query_id", "embedding AS vector", "coalesce(city, 'b') AS city")
    made = cells.write_cells(vectors, str(tmp_path))
    assert made.cells.probes < len(made.cells.centroids) and made.vectors.count() == 1200
    got, true = ranked(cells.search_cells(made, queries, 10, city)), ranked(retrieve.vector_topk(vectors, queries, 10, city))
    assert got.keys() == true.keys() and all(len(x) == 10 for x in got.values())
    distances = {q: {i: d for i, d in x} for q, x in true.items()}
    assert all(distances[q].get(i, d) == d for q, x in got.items() for i, d in x)
    assert sum(len({d for _, d in got[q]} & {d for _, d in true[q]}) / len({d for _, d in true[q]}) for q in true) >= 0.9 * len(true)
    # All lists and enough exact distances: the exact result.
    monkeypatch.setattr(cells, "RERANK", 200)
    assert ranked(cells.search_cells(made, queries, 10, city, probes=len(made.cells.centroids))) == true


def test_few_vectors(spark, tmp_path):
    kind = "id long, embedding array<float>"
    queries = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "query_id long, vector array<float>")
    none = cells.write_cells(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert cells.search_cells(none, queries.limit(0), 3).count() == 0
    two = cells.write_cells(spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [5.0, 1.0, 1.0])], kind), str(tmp_path / "two"))
    assert ranked(cells.search_cells(two, queries, 3, probes=2)) == {1: [(1, 0.0), (2, 26.0)]}


def test_a_query_gets_rows_per_bundle_not_per_list(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(2000)], "id long, embedding array<float>")
    queries = vectors.filter("id % 200 = 0").selectExpr("id AS query_id", "embedding AS vector")
    made = cells.write_cells(vectors, str(tmp_path))
    seen, top_k = [], cells.top_k
    monkeypatch.setattr(cells, "top_k", lambda df, *more: (seen.append(df), top_k(df, *more))[1])
    monkeypatch.setattr(cells, "RERANK", 2)
    found = ranked(cells.search_cells(made, queries, 5, probes=len(made.cells.centroids)))
    assert seen[0].count() == 10 * 2 * 5 and all(len(x) == 5 for x in found.values())
