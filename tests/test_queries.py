"""Every query against its oracle, and the properties of those that SQL can't express."""

import pytest

from placeloom.plans import catalog
from placeloom.plans.fixtures import SPATIAL, view
from tests.compare import ROOT, check

SF = f"{ROOT}/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    check(catalog.queries()[name](spark, SF), ORACLES[name], SF)


def _rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs_alike_twice(spark, name):
    first, again = (sorted(map(repr, _rows(spark, name))) for _ in range(2))
    assert first and first == again


def test_every_candidate_has_one_day_or_none(spark):
    cand = view(spark, SF, "cand_fx").select("request_id", "id", "days").collect()
    plan = _rows(spark, "spatial_plan")
    assert sorted((x.request_id, x.id) for x in plan) == sorted((x.request_id, x.id) for x in cand)
    most = {x.request_id: x.days for x in cand}
    assert all(x.day is None or 1 <= x.day <= most[x.request_id] for x in plan)
    dropped = {(x.request_id, x.id) for x in _rows(spark, "plan_dropped")}
    assert dropped == {(x.request_id, x.id) for x in plan if x.day is None}


def test_clusters_keep_their_limits(spark):
    from placeloom.operators.spatial import diameters

    assert max(x.size for x in _rows(spark, "cluster_size_cap")) <= SPATIAL.max_size
    at = view(spark, SF, "cand_fx").select("request_id", "id", "lat", "lng")
    members = catalog.queries()["geo_kmeans"](spark, SF).join(at, ["request_id", "id"])
    assert max(x.km for x in diameters(members, "request_id", "cluster_id").collect()) <= SPATIAL.max_km + 1e-9


def test_areas_hold_their_stops(spark):
    import numpy as np

    from placeloom.operators.geometry import inside

    stops = view(spark, SF, "cand_fx").select("request_id", "day", "lat", "lng").collect()
    ring = {}
    for x in sorted(_rows(spark, "fit_area"), key=lambda x: x.vertex):
        ring.setdefault((x.request_id, x.day), []).append((x.lat, x.lng))
    for key, area in ring.items():
        own = np.array([(x.lat, x.lng) for x in stops if (x.request_id, x.day) == key])
        assert inside(own, np.array(area)).all()


def test_entry_and_queries_match(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
