import datetime
import random

from pyspark.sql import functions as F

from tests import plain
from tripsearch.operators import features
from tripsearch.operators import trips as T

START = datetime.datetime(2024, 1, 1)


def log(spark, users):
    rows = []
    for user, seconds in users.items():
        for i, s in enumerate(seconds):
            rows.append((user, len(rows), START + datetime.timedelta(seconds=s), 121.3 + i * 1e-4, 31.2))
    return spark.createDataFrame(rows, "obd_id string, event_id bigint, ts timestamp, lng double, lat double")


def cut(spark, seconds, gap, slot=600):
    got = T.cut_trips(log(spark, {"U": seconds}), gap, slot).orderBy("ts", "event_id").collect()
    return [(r["r"], r["seq"]) for r in got]


def test_gap_is_strict(spark):
    assert cut(spark, [0, 1500], 1500) == [(0, 0), (0, 1)]
    assert cut(spark, [0, 1501], 1500) == [(0, 0), (1, 0)]


def test_random_times_match_one_pass_definition(spark):
    rng = random.Random(3)
    for gap, slot in ((1500, 600), (100, 600), (5000, 7), (1500, 1500)):
        seconds = sorted(rng.randrange(200000) for _ in range(150))
        assert cut(spark, seconds, gap, slot) == plain.cut(seconds, gap)


def test_hot_user_is_spread_over_slots(spark):
    seconds = list(range(0, 86400, 30))  # one user, no break, next to small users
    users = {"HOT": seconds, "A": [5, 4000], "B": [7]}
    points = T.cut_trips(log(spark, users), 1500)
    hot = points.where("obd_id = 'HOT'")
    assert hot.agg(F.max("seq"), F.count("*"), F.max("r")).first()[:] == (len(seconds) - 1, len(seconds), 0)
    assert [r[0] for r in hot.orderBy("ts").select("seq").collect()] == list(range(len(seconds)))
    # the windows over points are per user and slot, never per user
    plan = points._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line]
    assert windows and all("slot" in line for line in windows)


def test_day_is_that_of_the_last_point(spark):
    points = T.cut_trips(log(spark, {"U": [86390, 86410]}), 1500)
    assert {r["day"] for r in points.collect()} == {datetime.date(2024, 1, 2)}


def test_catalog_and_users(spark):
    points = T.cut_trips(log(spark, {"A": [0, 10, 9000], "B": [0]}), 1500)
    catalog = T.trip_catalog(points)
    assert {(r["trip_id"], r["n"]) for r in catalog.collect()} == {("A r0", 2), ("A r1", 1), ("B r0", 1)}
    users = spark.createDataFrame([("A",), ("C",)], "obd_id string")
    assert [r["obd_id"] for r in T.known_users(users, catalog).collect()] == ["A"]


def test_continue_equals_one_run(spark):
    rng = random.Random(5)
    users = {u: sorted(rng.randrange(90000) for _ in range(40)) for u in ("A", "B", "C")}
    whole = log(spark, users)
    want = {(r["obd_id"], r["event_id"]): (r["r"], r["seq"]) for r in T.cut_trips(whole, 3000).collect()}
    carry = spark.createDataFrame([], "obd_id string, last_us bigint, r int, n bigint")
    got, edges = {}, [0, 20000, 21000, 50000, 90001]
    for low, high in zip(edges, edges[1:]):
        part = whole.where(
            (F.unix_timestamp("ts") >= F.unix_timestamp(F.lit(START)) + low)
            & (F.unix_timestamp("ts") < F.unix_timestamp(F.lit(START)) + high)
        )
        numbered, carry, late = T.continue_trips(part, carry, 3000)
        got.update({(r["obd_id"], r["event_id"]): (r["r"], r["seq"]) for r in numbered.collect()})
        carry = spark.createDataFrame(carry.collect(), carry.schema)
        assert late.isEmpty()
    assert got == want


def test_late_points_are_set_aside(spark):
    carry = spark.createDataFrame([("A", 1704067260000000, 2, 5)], "obd_id string, last_us bigint, r int, n bigint")
    numbered, newest, late = T.continue_trips(log(spark, {"A": [30, 90]}), carry, 1500)
    assert [(r["r"], r["seq"]) for r in numbered.collect()] == [(2, 5)]
    assert late.count() == 1
    assert newest.first()["n"] == 6


def test_path_length_over_block_edges(make_points):
    path = [(121 + i * 0.001, 31 + (i % 3) * 0.001) for i in range(50)]
    points = make_points({"T": path, "one": path[:1]})
    want = sum(plain.metres(a, b) for a, b in zip(path, path[1:]))
    for block in (1, 7, 50, 1024):
        total = features.with_hops(points, block).groupBy("trip_id").agg(F.sum("hop_m").alias("m"), F.count("*").alias("n"))
        got = {r["trip_id"]: (r["m"], r["n"]) for r in total.collect()}
        assert abs(got["T"][0] - want) < 1e-6 and got["T"][1] == 50
        assert got["one"] == (None, 1)
