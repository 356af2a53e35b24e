import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests import plain
from tripsearch.operators import bounds, enclosed, nearest, similarity
from tripsearch.operators.ordered import ordered_bounds
from tripsearch.plans import search, similar, workload
from tripsearch.storage import durable

DAYS = ["2024-01-01", "2024-01-02"]


@pytest.fixture(scope="module")
def world(spark):
    """40 trips over two days, and one that holds a third of all points in one cell."""
    trips = plain.random_trips(40, 12, seed=21)
    rng = random.Random(1)
    trips["HOT"] = [(121.2 + rng.random() * 1e-3, 31.2 + rng.random() * 1e-3) for _ in range(150)]
    day = {t: DAYS[i % 2] for i, t in enumerate(sorted(trips))}
    rows = [(t, i, x, y, day[t]) for t, p in trips.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "trip_id string, seq bigint, lng double, lat double, day string")
    return trips, day, durable(df.withColumn("day", F.col("day").cast("date")))


BATCH = [
    (1, [(121.1, 31.1), (121.3, 31.3)], None, 3),
    (2, [(121.2, 31.2)], "2024-01-02", 2),
    (3, [(121.05, 31.35), (121.3, 31.1), (121.2, 31.2)], "2024-01-01", 50),  # k beyond the number of trips
    (4, [(124.0, 33.0), (110.0, 20.0)], None, 2),  # far from every trip
    (5, [(121.2, 31.2)], "2023-05-05", 2),  # no trip that day
]


def table(spark, batch):
    rows = [
        (qid, i, x, y, None if d is None else datetime.date.fromisoformat(d), k)
        for qid, q, d, k in batch for i, (x, y) in enumerate(q)
    ]
    return spark.createDataFrame(rows, "qid int, qseq int, qlng double, qlat double, day date, k int")


def expected(trips, day, batch):
    out = []
    for qid, q, d, k in batch:
        scores = {t: plain.similarity(p, q) for t, p in trips.items() if d is None or day[t] == d}
        out += [(qid, i + 1, t) for i, (t, _) in enumerate(plain.top(scores, k))]
    return out


def ranks(df):
    return sorted((r["qid"], r["rank"], r["trip_id"]) for r in df.collect())


def test_single_query(world):
    trips, _, points = world
    query = BATCH[0][1]
    got = [(r["trip_id"], r["sim"]) for r in similarity.best_connected(points, query, 3).collect()]
    want = plain.top({t: plain.similarity(p, query) for t, p in trips.items()}, 3)
    assert [t for t, _ in got] == [t for t, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-9)


def test_ties_go_by_trip(make_points):
    points = make_points({"B": [(1, 1)], "A": [(1, 1)], "C": [(1, 1)]})
    assert [r["trip_id"] for r in similarity.best_connected(points, [(1.1, 1.0)], 2).collect()] == ["A", "B"]


def test_batch_wide(spark, world):
    trips, day, points = world
    assert ranks(search.best_connected_batch(points, table(spark, BATCH))) == expected(trips, day, BATCH)


def test_batch_beyond_the_wide_limit(spark, world):
    trips, day, points = world
    got = search.best_connected_batch(points, table(spark, BATCH), wide_points=3)
    assert ranks(got) == expected(trips, day, BATCH)


def test_points_are_not_shuffled_to_meet_a_small_batch(spark, world):
    _, _, points = world
    df = search.best_connected_pruned(points, table(spark, BATCH))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    asked = durable(table(spark, BATCH).withColumn("radius", F.lit(0.1)))
    plan = nearest.within_radius(points, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_growing_neighbours(spark, world):
    trips, day, points = world
    assert ranks(search.best_connected_lambda(points, table(spark, BATCH[:3]))) == expected(trips, day, BATCH[:3])


def test_empty_batch(spark, world):
    empty = table(spark, BATCH).where("qid < 0")
    assert search.best_connected_batch(world[2], empty).count() == 0
    assert search.best_connected_lambda(world[2], empty).count() == 0


def test_split_adds_up_the_parts(spark, world):
    trips, _, points = world
    q = [(121.1, 31.1), (121.3, 31.3), (121.2, 31.0), (121.25, 31.25), (121.0, 31.2)]
    total = {}
    for part in range(2):
        for t, s in plain.top({t: plain.similarity(p, q[part::2]) for t, p in trips.items()}, 4):
            total[t] = total.get(t, 0) + s
    got = search.best_connected_split(points, table(spark, [(7, q, None, 4)]), 2)
    assert [t for _, _, t in ranks(got)] == [t for t, _ in plain.top(total, 100)]
    assert ranks(search.best_connected_split(points, table(spark, [(7, q[:1], None, 4)]), 3, limit=2))


def neighbours(trips, day, q, d, lam):
    near = sorted(
        (round(plain.apart(p, q), 12), t, i)
        for t, path in trips.items() if d is None or day[t] == d for i, p in enumerate(path)
    )
    return near[:lam]


@pytest.mark.parametrize("lam", [1, 60, 1000])
def test_nearest_points(spark, world, lam):
    trips, day, points = world
    got = nearest.nearest_points(points, durable(table(spark, BATCH).withColumn("lam", F.lit(lam)))).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["nn"]):
        found.setdefault((r["qid"], r["qseq"]), []).append((r["trip_id"], r["seq"]))
    for qid, q, d, _ in BATCH:
        for i, p in enumerate(q):
            want = [(t, s) for _, t, s in neighbours(trips, day, p, d, lam)]
            assert found.get((qid, i), []) == want


@pytest.mark.parametrize("radius", [0.0, 0.03, 90.0])
def test_within_radius(spark, world, radius):
    trips, day, points = world
    asked = durable(table(spark, BATCH).withColumn("radius", F.lit(radius)))
    got = {(r["qid"], r["qseq"], r["trip_id"], r["seq"]) for r in nearest.within_radius(points, asked).collect()}
    want = {
        (qid, i, t, s)
        for qid, q, d, _ in BATCH for i, c in enumerate(q)
        for t, path in trips.items() if d is None or day[t] == d
        for s, p in enumerate(path) if plain.apart(p, c) <= radius
    }
    assert got == want


def test_bounds_enclose_the_similarity(spark, world):
    trips, day, points = world
    batch = BATCH[:3]
    asked = durable(table(spark, batch).withColumn("lam", F.lit(15)))
    found = durable(nearest.nearest_points(points, asked))
    limits = bounds.similarity_bounds(bounds.scanned_trips(found), bounds.look_radii(found)).collect()
    unseen = {r["qid"]: r["ub_ns"] for r in bounds.unseen_bound(bounds.look_radii(found)).collect()}
    low = {(r["qid"], r["trip_id"]): r["lb"] for r in ordered_bounds(found, asked).collect()}
    seen = set()
    for r in limits:
        query = batch[r["qid"] - 1][1]
        sim = plain.similarity(trips[r["trip_id"]], query)
        assert r["lb"] - 1e-9 <= sim <= r["ub"] + 1e-9
        assert low[r["qid"], r["trip_id"]] <= sim + 1e-9
        seen.add((r["qid"], r["trip_id"]))
    for qid, query, d, _ in batch:
        for t, path in trips.items():
            if (d is None or day[t] == d) and (qid, t) not in seen:
                assert plain.similarity(path, query) <= unseen[qid] + 1e-9


@pytest.mark.parametrize("lam,block", [(1, 512), (6, 3), (400, 64)])
def test_bounds_enclose_the_ordered_measure(spark, world, lam, block):
    """Both bounds, on queries in every order and trips that are reached only here and there."""
    trips, _, points = world
    rng = random.Random(lam)
    batch = [(i, [(121 + rng.random() * 0.4, 31 + rng.random() * 0.4) for _ in range(1 + i % 4)], None, 2) for i in range(8)]
    batch.append((8, [trips["HOT"][100], trips["HOT"][50], trips["HOT"][2]], None, 2))  # against the trip's order
    asked = durable(table(spark, batch).withColumn("lam", F.lit(lam)))
    found = durable(nearest.nearest_points(points, asked))
    got = enclosed.enclosing_bounds(found, asked, block).collect()
    assert {(r["qid"], r["trip_id"]) for r in got} == {(r["qid"], r["trip_id"]) for r in found.select("qid", "trip_id").distinct().collect()}
    for r in got:
        query = batch[r["qid"]][1]
        value = ordered_by_rows(trips[r["trip_id"]], query)
        assert r["lb"] - 1e-9 <= value <= r["ub"] + 1e-9
        if lam == 400:  # all points of the trips but the long one's are reached
            assert r["lb"] == pytest.approx(value, abs=1e-9) or r["trip_id"] == "HOT"


def ordered_by_rows(trip, query):
    best = [0.0] + [float("-inf")] * len(query)
    for p in trip:
        for j, q in enumerate(query, 1):
            best[j] = max(best[j], best[j - 1] + plain.gain(p, q))
    return best[-1]


def test_published_upper_bound_can_fall_short(spark, make_points):
    """The trip's nearest points lie against the query's order, and one that fits its order is not reached."""
    trip = [(121.1, 31.0), (121.5, 31.0), (121.11, 31.0)]
    points = durable(make_points({"T": trip, "U": [(123.0, 32.0)]}))
    query = [(121.5, 31.0), (121.09, 31.0)]
    asked = durable(table(spark, [(1, query, None, 1)]).withColumn("lam", F.lit(1)))
    found = durable(nearest.nearest_points(points, asked))
    value = ordered_by_rows(trip, query)
    (published,) = ordered_bounds(found, asked).collect()
    assert published["ub"] < value - 0.1
    (r,) = enclosed.enclosing_bounds(found, asked).collect()
    assert r["lb"] - 1e-9 <= value <= r["ub"] + 1e-9


@pytest.mark.parametrize("block", [4, 512])
def test_exact_scores_of_pairs(spark, world, block):
    trips, _, points = world
    asked = durable(table(spark, BATCH[:3]))
    pairs = durable(asked.select("qid").distinct().crossJoin(points.select("trip_id").distinct()))
    got = {(r["qid"], r["trip_id"]): r["value"] for r in enclosed.exact_scores(points, pairs, asked, block).collect()}
    want = {(qid, t): ordered_by_rows(p, q) for qid, q, _, _ in BATCH[:3] for t, p in trips.items()}
    assert got == {key: pytest.approx(value, abs=1e-9) for key, value in want.items()}


def test_best_ordered_batch(spark, world):
    trips, day, points = world
    got = [(r["qid"], r["rank"], r["trip_id"]) for r in similar.best_ordered_batch(points, table(spark, BATCH)).collect()]
    want = []
    for qid, query, d, k in BATCH:
        scores = {t: ordered_by_rows(p, query) for t, p in trips.items() if d is None or day[t] == d}
        want += [(qid, i + 1, t) for i, (t, _) in enumerate(plain.top(scores, k))]
    assert sorted(got) == sorted(want)
    assert similar.best_ordered_batch(points, table(spark, BATCH[4:])).count() == 0  # no trip that day


def test_best_ordered_batch_walks_few_trips(spark, world, monkeypatch):
    """Only trips whose upper bound reaches the k-th lower bound are walked whole."""
    _, _, points = world
    asked = []
    whole = enclosed.exact_scores
    monkeypatch.setattr(enclosed, "exact_scores", lambda p, pairs, q: (asked.append(pairs.count()), whole(p, pairs, q))[1])
    similar.best_ordered_batch(points, table(spark, [(1, [(121.2, 31.2), (121.2, 31.2)], None, 1)])).collect()
    assert asked[0] <= 10


def test_next_budgets_share_out_the_growth(spark):
    state = spark.createDataFrame([(1, 0, 2, 2, 0), (1, 1, 2, 2, 0)], "qid int, qseq int, k int, lam int, prev int")
    looks = spark.createDataFrame([(1, 0, 0.5, 2), (1, 1, 0.5, 2)], "qid int, qseq int, r double, returned bigint")
    got = [r.asDict() for r in bounds.next_budgets(state, looks, 1).collect()]
    assert [(g["prev"], g["lam"]) for g in got] == [(2, 6), (2, 6)]  # m * k * 2 = 8 more, 4 each
    zero = looks.withColumn("r", F.lit(0.0))  # no decay at all: shared out evenly
    assert [r["lam"] for r in bounds.next_budgets(state, zero, 1).collect()] == [6, 6]


def test_accuracy_of_a_trip_against_itself(world):
    _, _, points = world
    catalog = points.groupBy("trip_id", "day").agg(F.count("*").alias("n"))
    sample = workload.sample_queries(catalog, [3, 5, 7], 2)
    queries = durable(workload.queries_from_sample(points, sample, 2, 4))
    rows = workload.accuracy(points, queries, [1, 4]).collect()
    assert all(r["accuracy"] == pytest.approx(1.0) for r in rows if r["k"] == 1)
    assert all(r["accuracy"] < 1.0 for r in rows if r["k"] == 4)
    assert all(r["mean_sim"] == pytest.approx(r["accuracy"] * r["m"]) for r in rows)


def test_attach_points(world):
    trips, _, points = world
    best = similarity.best_connected(points, [(121.2, 31.2)], 2)
    got = search.attach_points(best, points)
    assert got.count() == sum(len(trips[r["trip_id"]]) for r in best.collect())


def test_waves_read_the_points_of_fewer_trips_than_survive(spark, world, monkeypatch):
    """With loose bounds many trips survive; waves end once the k-th score beats the next bound."""
    trips, day, points = world
    batch = table(spark, [(1, BATCH[0][1], None, 1), (2, BATCH[2][1], "2024-01-01", 2)])
    monkeypatch.setattr(search, "WAVE", 1)
    asked = durable(batch)
    # order-free bounds of all trips, loosened for the worse ones
    rows = []
    for qid, q, d, k in [(1, BATCH[0][1], None, 1), (2, BATCH[2][1], "2024-01-01", 2)]:
        for t, p in trips.items():
            if d is None or day[t] == d:
                rows.append((qid, t, k, plain.similarity(p, q) + (0.05 if t < "T020" else 1e-6)))
    survivors = spark.createDataFrame(rows, "qid int, trip_id string, k int, ub double")
    scored = search._refined(points, survivors, asked)
    assert 0 < scored.count() < len(rows)
    got = {(r["qid"], r["rank"], r["trip_id"]) for r in search._best(scored, asked).collect()}
    assert got == set(expected(trips, day, [(1, BATCH[0][1], None, 1), (2, BATCH[2][1], "2024-01-01", 2)]))


def test_every_answer_survives(spark, world):
    trips, day, points = world
    asked = durable(table(spark, BATCH))
    survivors, complete = search.pruned_survivors(points, asked, nearest.cell_counts(points))
    kept = {(r["qid"], r["trip_id"]) for part in (survivors, complete) for r in part.collect()}
    assert {(q, t) for q, _, t in expected(trips, day, BATCH)} <= kept
    assert {q for q, _ in kept} == {1, 2, 3, 4}  # query 3 asks for more trips than there are, query 5 for none
