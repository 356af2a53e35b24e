import datetime
import random
import tempfile

from pyspark.sql import functions as F

from tripsearch.operators.trips import cut_trips
from tripsearch.sources import tables
from tripsearch.streaming import live

START = datetime.datetime(2024, 1, 1)
SCHEMA = "obd_id string, event_id bigint, ts timestamp, lng double, lat double"


def feed(spark, batches):
    """One file per batch, read one file at a time."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def some_batches():
    rng = random.Random(2)
    rows, edges = [], [0, 5000, 9000, 30000, 60000]
    for user in ("A", "B", "C"):
        for s in sorted(rng.sample(range(60000), 60)):
            rows.append((user, len(rows), START + datetime.timedelta(seconds=s), 121.0, 31.0))
    in_part = lambda r, a, b: a <= (r[2] - START).total_seconds() < b
    return rows, [[r for r in rows if in_part(r, a, b)] for a, b in zip(edges, edges[1:])]


def test_numbering_in_batches_equals_one_log(spark):
    rows, batches = some_batches()
    folder = live.number_points(feed(spark, batches), 1500)
    got = spark.read.parquet(f"{folder}/points")
    assert got.select("batch").distinct().count() == len(batches)
    want = cut_trips(spark.createDataFrame(rows, SCHEMA), 1500)
    key = lambda df: sorted((r["obd_id"], r["event_id"], r["r"], r["seq"]) for r in df.collect())
    assert key(got) == key(want)


def test_late_points_come_out_as_late(spark):
    rows, batches = some_batches()
    moved = [r for r in batches[1] if r[0] == "A"][:3]
    batches = [batches[0], [r for r in batches[1] if r not in moved], batches[2], batches[3] + moved]
    folder = live.number_points(feed(spark, batches), 1500)
    late = {r["event_id"] for r in spark.read.parquet(f"{folder}/late").collect()}
    assert late == {r[1] for r in moved}
    want = cut_trips(spark.createDataFrame([r for r in rows if r not in moved], SCHEMA), 1500)
    key = lambda df: sorted((r["obd_id"], r["event_id"], r["r"], r["seq"]) for r in df.collect())
    assert key(spark.read.parquet(f"{folder}/points")) == key(want)


def test_a_batch_writes_the_carry_of_its_users_only(spark, monkeypatch):
    monkeypatch.setattr(live, "FULL_EVERY", 3)
    at = lambda s: START + datetime.timedelta(seconds=s)
    batches = [[("A", 0, at(0), 1.0, 1.0), ("B", 1, at(1), 1.0, 1.0)], [("A", 2, at(9000), 1.0, 1.0)], [("C", 3, at(9001), 1.0, 1.0)], [("A", 4, at(20000), 1.0, 1.0)], [("B", 5, at(20001), 1.0, 1.0)]]
    folder = live.number_points(feed(spark, batches), 1500)
    users = [sorted(r["obd_id"] for r in spark.read.parquet(f"{folder}/carry/{i}").collect()) for i in range(5)]
    assert users == [["A", "B"], ["A"], ["C"], ["A", "B", "C"], ["B"]]
    got = {r["event_id"]: (r["obd_id"], r["r"]) for r in spark.read.parquet(f"{folder}/points").collect()}
    assert got == {0: ("A", 0), 1: ("B", 0), 2: ("A", 1), 3: ("C", 0), 4: ("A", 2), 5: ("B", 1)}


def test_closed_and_open_trips_are_all_trips(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [("A", 0, at(0), 1.0, 1.0), ("A", 1, at(1500), 1.0, 1.0), ("A", 2, at(3001), 1.0, 1.0)]
    closing = [("B", 3, at(20000), 1.0, 1.0)]
    after, behind = [("B", 5, at(20010), 1.0, 1.0)], [("C", 4, at(10), 1.0, 1.0)]
    before = spark.conf.get(live._LOCAL_SESSIONS)
    found = live.summarize_trips(feed(spark, [rows, closing, after, behind]))
    shown = lambda df: sorted((r["obd_id"], (r["last_ts"] - r["first_ts"]).seconds, r["n"]) for r in df.collect())
    assert shown(found.closed(spark)) == [("A", 0, 1), ("A", 1500, 2)]
    assert shown(found.open(spark)) == [("B", 10, 2)]
    assert found.dropped == 1 and spark.conf.get(live._LOCAL_SESSIONS) == before


def test_index_is_appended(spark):
    _, batches = some_batches()
    stream = feed(spark, batches).withColumn("day", F.to_date("ts")).withColumn("trip_id", F.col("obd_id")).withColumn(
        "seq", F.col("event_id")
    )
    path = live.append_index(stream)
    assert tables.read_day(spark, path).count() == sum(map(len, batches))
    assert tables.read_day(spark, path, "2024-01-01").count() == sum(map(len, batches))
