import random

import pytest

from tests import plain
from tripsearch.operators import features, outline


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["trip_id"], []).append(r["seq"])
    return {t: sorted(v) for t, v in out.items()}


def test_weight_simplification_matches_definition(make_points):
    rng = random.Random(11)
    trips = {
        f"T{n}": [(121 + rng.random() * 0.1, 31 + rng.random() * 0.1) for _ in range(n)]
        for n in (1, 4, 5, 6, 24, 25, 26, 44, 45, 75, 76, 79, 80, 151, 300)
    }
    assert kept(features.simplify_trips(make_points(trips))) == {t: plain.simplify(p) for t, p in trips.items()}
    wide = kept(features.simplify_trips(make_points(trips), rate="intended"))
    assert wide == {t: plain.simplify(p, middle=15) for t, p in trips.items()}


def test_straight_trip_keeps_first_point_of_each_chunk(make_points):
    path = [(121 + i * 0.001, 31.0) for i in range(160)]
    assert kept(features.simplify_trips(make_points({"T": path})))["T"] == plain.simplify(path)


def test_windows_are_bounded_by_chunks(make_points):
    plan = features.simplify_trips(make_points({"T": [(1, 2)] * 9}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


@pytest.mark.parametrize("epsilon,piece", [(1e-4, 2048), (1e-2, 2048), (0.2, 2048), (1e-2, 12), (0.2, 4)])
def test_outline_matches_definition(make_points, epsilon, piece):
    trips = plain.random_trips(12, 40, seed=2)
    trips |= {
        "line": [(i, i) for i in range(9)],
        "turn": [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)],
        "loop": [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
        "same": [(1, 1)] * 6,
        "one": [(3, 3)],
        "two": [(0, 0), (1, 1)],
    }
    got = kept(outline.outline_trips(make_points(trips), epsilon, piece_points=piece))
    assert got == {t: plain.outline(p, epsilon) for t, p in trips.items()}
