import pytest

from tests import plain
from tripsearch.operators import edit, ordered, tripcells
from tripsearch.operators.edit import edit_distances
from tripsearch.plans import similar

QUERY = [(121.1, 31.1), (121.3, 31.3), (121.2, 31.05), (121.35, 31.2)]
PLAIN = {
    "ordered": plain.ordered, "ordered_reuse": plain.ordered_reuse, "ordered_dp": plain.ordered_dp,
    "ordered_all": plain.ordered_all, "lcss": plain.lcss,
}


@pytest.mark.parametrize("measure", sorted(PLAIN))
@pytest.mark.parametrize("block,wide", [(2, 3), (512, 512)])
@pytest.mark.parametrize("m", [1, 4])
def test_ordered_measures(make_points, measure, block, wide, m):
    trips = plain.random_trips(14, 9, seed=4)
    got = {
        r["trip_id"]: (r["n"], r["value"])
        for r in ordered.ordered_scores(
            make_points(trips), QUERY[:m], measure, block_points=block, query_block=wide
        ).collect()
    }
    for trip, path in trips.items():
        assert got[trip][0] == len(path)
        assert got[trip][1] == pytest.approx(PLAIN[measure](path, QUERY[:m]), abs=1e-9), (trip, len(path))


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("m", [1, 2, 4])
def test_edit_distance(make_points, block, m):
    trips = plain.random_trips(20, 12, seed=8) | {"same": QUERY, "still": [QUERY[0]] * 4, "one": [(121.0, 31.0)]}
    got = {r["trip_id"]: r["value"] for r in edit_distances(make_points(trips), QUERY[:m], block).collect()}
    assert got == {t: pytest.approx(plain.edwp(p, QUERY[:m]), abs=1e-9) for t, p in trips.items()}


def test_ordered_never_beats_order_free(make_points):
    points = make_points(plain.random_trips(15, 20, seed=9))
    free = {r["trip_id"]: r["value"] for r in similar.scores(points, QUERY, "unordered").collect()}
    for r in similar.scores(points, QUERY, "ordered").collect():
        assert r["value"] <= free[r["trip_id"]] + 1e-12 <= len(QUERY) + 1e-9


def test_top_by_measure_puts_near_trips_first(make_points):
    trips = plain.random_trips(15, 8, seed=10)
    points = make_points(trips)
    for measure, largest in (("ordered", True), ("edwp", False), ("lcss", False), ("unordered", True)):
        f = {"edwp": plain.edwp, "unordered": plain.similarity}.get(measure) or PLAIN[measure]
        want = plain.top({t: f(p, QUERY) for t, p in trips.items()}, 4, largest)
        got = [(r["trip_id"], r["value"]) for r in similar.top_by_measure(points, QUERY, 4, measure).collect()]
        assert [t for t, _ in got] == [t for t, _ in want]
        assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-9)


def test_trip_as_query_finds_itself(make_points):
    points = make_points(plain.random_trips(10, 15, seed=12))
    best = similar.best_connected_to_trip(points, "T003", 3).collect()
    assert best[0]["trip_id"] == "T003" and len(best) == 3


def test_unknown_measure(make_points):
    with pytest.raises(ValueError):
        ordered.ordered_scores(make_points({"T": [(0, 0)]}), QUERY, "dtw")


SPARSE = {"cut off": [0, 1, 2, 9, 10, 30], "tail": [17, 18, 40], "ends": [0, 4999]}


def sparse_points(spark):
    """Trips whose points leave blocks empty, at the start, inside and at the end."""
    paths = plain.random_trips(len(SPARSE), 6, seed=31)
    rows, trips = [], {}
    for (trip, seqs), path in zip(SPARSE.items(), paths.values()):
        path = (path * 6)[: len(seqs)]
        trips[trip] = path
        rows += [(trip, s, x, y) for s, (x, y) in zip(seqs, path)]
    return spark.createDataFrame(rows, "trip_id string, seq bigint, lng double, lat double"), trips


@pytest.mark.parametrize("measure", [*sorted(PLAIN), "edwp"])
def test_trips_with_empty_blocks_are_all_scored(spark, measure):
    points, trips = sparse_points(spark)
    f = plain.edwp if measure == "edwp" else PLAIN[measure]
    scored = edit_distances(points, QUERY, 4, 3) if measure == "edwp" else ordered.ordered_scores(points, QUERY, measure, block_points=4, query_block=3)
    got = {r["trip_id"]: r["value"] for r in scored.collect()}
    assert got == {t: pytest.approx(f(p, QUERY), abs=1e-9) for t, p in trips.items()}


@pytest.mark.parametrize("measure", ["ordered", "lcss", "edwp"])
def test_a_trip_is_the_query(spark, make_points, measure):
    trips = plain.random_trips(12, 7, seed=21)
    longest = max(trips, key=lambda t: (len(trips[t]), t))
    f = plain.edwp if measure == "edwp" else PLAIN[measure]
    want = plain.top({t: f(p, trips[longest]) for t, p in trips.items()}, 5, measure == "ordered")
    got = [(r["trip_id"], r["value"]) for r in similar.top_by_trip(make_points(trips), longest, 5, measure).collect()]
    assert [t for t, _ in got] == [t for t, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-9)


def test_edit_distance_over_blocks_of_trip_and_query(make_points):
    trips = plain.random_trips(10, 30, seed=22)
    query = plain.random_trips(1, 40, seed=70)["T000"]
    points = make_points(trips)
    want = {t: pytest.approx(plain.edwp(p, query), abs=1e-9) for t, p in trips.items()}
    for trip_block, query_block in ((4, 1000), (1000, 5), (7, 3)):
        assert {r["trip_id"]: r["value"] for r in edit_distances(points, query, trip_block, query_block).collect()} == want


def test_walks_that_are_ended_early_never_belong_to_the_answer(make_points):
    trips = plain.random_trips(40, 25, seed=23)
    query = trips["T007"]
    points = make_points(trips)
    want = plain.top({t: plain.edwp(p, query) for t, p in trips.items()}, 3, False)
    for trip_block, query_block in ((1024, 1024), (5, 4)):
        got = [(r["trip_id"], r["value"]) for r in edit.nearest_by_edit(points, query, 3, trip_block, query_block).collect()]
        assert [t for t, _ in got] == [t for t, _ in want]
    # and some are in fact ended early
    asked, wide, _, start = ordered.query_blocks(points, query, 4)
    blocks, most = ordered.trip_blocks(points, 5)
    assert edit._distances(blocks, most, asked, wide, start, 3, want[-1][1] + 1e-8).count() < len(trips)


def test_the_plan_does_not_grow_with_the_query(make_points):
    points = make_points(plain.random_trips(5, 9, seed=24))
    plans = [
        ordered.ordered_scores(points, [(121 + i * 1e-4, 31.1) for i in range(m)], "lcss")._jdf.queryExecution().optimizedPlan().toString()
        for m in (3, 300)
    ]
    assert abs(len(plans[0]) - len(plans[1])) < 20


@pytest.mark.parametrize("measure", ["ordered", "lcss"])
@pytest.mark.parametrize("width", [0.02, 0.5])
def test_cells_bound_the_measures_and_answers_stay(make_points, measure, width):
    trips = plain.random_trips(25, 9, seed=12) | {"far": [(125.0, 35.0)] * 3, "one": [QUERY[0]]}
    points = make_points(trips)
    cells = tripcells.trip_cells(points, width)
    assert {r["trip_id"]: r["n"] for r in cells.groupBy("trip_id").agg({"n": "sum"}).toDF("trip_id", "n").collect()} == {t: len(p) for t, p in trips.items()}
    best = {r["trip_id"]: r["value"] for r in tripcells.best_possible(cells, QUERY, measure).collect()}
    scores = {t: PLAIN[measure](p, QUERY) for t, p in trips.items()}
    assert best.keys() == scores.keys()
    for t, value in scores.items():
        assert best[t] >= value - 1e-9 if measure == "ordered" else best[t] <= value + 1e-9
    got = [(r["trip_id"], r["value"]) for r in similar.top_by_measure(points, QUERY, 3, measure, cells).collect()]
    assert got == [(t, pytest.approx(v)) for t, v in plain.top(scores, 3, measure == "ordered")]


def test_only_trips_that_can_win_are_walked(make_points, monkeypatch):
    near = {f"n{i:02}": [(121.1 + i * 1e-4, 31.1), (121.3, 31.3), (121.2, 31.05), (121.35, 31.2)] for i in range(12)}
    points = make_points(near | {f"f{i:03}": [(124.0, 33.0 + i * 1e-3)] for i in range(200)})
    asked = []
    whole = similar.scores
    monkeypatch.setattr(similar, "scores", lambda p, *rest: (asked.append(p.select("trip_id").distinct().count()), whole(p, *rest))[1])
    got = similar.top_by_measure(points, QUERY, 2, "ordered", tripcells.trip_cells(points)).collect()
    assert [r["trip_id"] for r in got] == ["n00", "n01"] and sum(asked) <= len(near)
