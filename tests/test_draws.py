"""Draws by digests against ranking all pairs."""

import hashlib

import numpy as np
import pytest

from placeloom.operators import draws
from placeloom.plans.fixtures import oracle, view
from tests.compare import ROOT, check


def test_digests_are_md5():
    ids = np.array([0, 7, 10, -3, 99_999, 2**63 - 1, -(2**63), *range(300)])
    tails = draws.Tails(ids)
    for head in ("1|", "22|", "333|", "4444|", f"{-(2**63)}|"):
        assert tails.digests(head).tolist() == [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in ids]


def plain(requests, rows):
    found = []
    for key in {r[0] for r in requests}:
        pairs = sorted((hashlib.md5(f"{key}|{i}".encode()).hexdigest(), i, n) for k, city, n in requests if k == key for i, c in rows if c and c == city)
        found += [(key, i, rank) for rank, (_, i, n) in enumerate(pairs, 1) if rank <= n]
    return sorted(found)


@pytest.mark.parametrize("spare", [6.0, -9.0])
def test_equals_ranking_all_pairs(spark, monkeypatch, spare):
    """Also if the bounds are far too low, keys come more than once, or there are fewer rows than asked for."""
    monkeypatch.setattr(draws, "SPARE", spare)
    monkeypatch.setattr(draws, "TILE", (400, 7))
    requests = [(i, "abc"[i % 3], 5 + i % 60) for i in range(40)] + [(3, "a", 8), (100, "d", 5), (101, "nowhere", 5), (102, None, 5)]
    rows = [(i, "abc"[i % 3]) for i in range(3000)] + [(i, "a") for i in range(0, 300, 3)] + [(5000 + i, "d") for i in range(3)] + [(9, None)]
    got = draws.drawn(spark.createDataFrame(requests, "request_id long, city string, n int"), spark.createDataFrame(rows, "id long, city string"), draws.F.col("n"), "city")
    assert sorted((x.request_id, x.id, x["rank"]) for x in got.collect()) == plain(requests, rows)


def test_candidates_are_those_of_the_sql_without_a_row_per_pair(spark, monkeypatch):
    written, seen = draws.written, []
    monkeypatch.setattr(draws, "written", lambda df: seen.append(written(df)) or seen[-1])
    sf = f"{ROOT}/sf0.01"
    n = check(view(spark, sf, "cand_fx"), oracle("SELECT * FROM cand_fx", "cand_fx"), sf)
    assert n <= seen[0].count() < 2.5 * n < 0.3 * 30 * 1000
