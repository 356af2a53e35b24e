import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests import plain
from tripsearch.operators import edit, nearest, ordered
from tripsearch.operators.trips import clean_positions, trip_polyline
from tripsearch.plans import answers, ingest, similar
from tripsearch.sources import positions, requests, tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_raw_log(spark, folder):
    with open(f"{folder}/log.txt", "w") as f:
        f.write("1,x,P1,121.40,31.20,0,0,0,2015-04-01 00:00:10,extra\n")
        f.write("2,x,P1,200.00,31.20,0,0,0,2015-04-01 00:00:20\n")  # outside the country
        f.write("3,x,P2,bad,31.20,0,0,0,2015-04-01 00:00:20\n")
        f.write("4,x,P2,116.40,39.90,0,0,0,2015-04-01 00:00:20\n")  # another city
        f.write("5,x,P3\n")
    log = positions.read_raw_log(spark, folder)
    assert sorted(r["obd_id"] for r in log.collect()) == ["P1", "P1", "P2"]
    assert [r["obd_id"] for r in clean_positions(log).collect()] == ["P1"]


def test_raw_log_keeps_its_order_over_files_and_splits(spark, folder):
    """Splits of a file are dealt to tasks by size, and small files share a task; numbers still ascend as the log does."""
    os.makedirs(f"{folder}/two words")
    want = []
    for name, lines in (("a", 3000), ("b", 7), ("c d", 900), ("e", 0)):
        with open(f"{folder}/two words/{name}.txt", "w") as f:
            for i in range(lines):
                want.append(f"{name}{i}")
                f.write(f"1,x,{name}{i},121.40,31.20,0,0,0,2015-04-01 00:00:10\n" + "\n" * (i % 3))
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        log = positions.read_raw_log(spark, f"{folder}/two words")
        rows = log.collect()
        tasks = log.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
    assert tasks > 5
    assert len({r["event_id"] for r in rows}) == len(want)
    assert [r["obd_id"] for r in sorted(rows, key=lambda r: r["event_id"])] == want


def test_rejected_lines(spark, folder):
    with open(f"{folder}/log.txt", "w") as f:
        f.write("1,x,P1,121.40,31.20,0,0,0,2015-04-01 00:00:10\n\n")
        f.write("2,x,,bad,31.20,0,0,0,2015-04-01 00:00:20\n")
        f.write("3,x,P2,bad,31.20,0,0,0,2015-04-01 00:00:20\n")
        f.write("4,x,P2,NaN,39.90,0,0,0,2015-04-01 00:00:20\n")
        f.write("5,x,P3\n")
        f.write("6,x,P3,121.40,31.20,0,0,0,2015-04-01 25:00:20\n")
    rows = sorted(positions.rejected_lines(spark, folder).collect(), key=lambda r: r["event_id"])
    assert [(r["fields"][0], r["reason"]) for r in rows] == [
        ("2", "user"), ("3", "coordinates"), ("4", "coordinates"), ("5", "coordinates"), ("6", "time")
    ]
    assert positions.read_raw_log(spark, folder).count() == 1


def test_country_and_city_box_reach_the_scan(spark, folder):
    spark.createDataFrame(
        [("A", 1, "2015-04-01 00:00:00", 121.4, 31.2)], "obd_id string, event_id bigint, ts string, lng double, lat double"
    ).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/log")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = clean_positions(spark.read.parquet(f"{folder}/log"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(lng,119.48)" in pushed and "LessThanOrEqual(lat,32.52)" in pushed


def test_trip_text_files(spark, folder):
    os.makedirs(f"{folder}/P1")
    os.makedirs(f"{folder}/P2")
    for user, r, lines in (("P1", 0, 5), ("P1", 12, 3), ("P2", 1, 1)):
        with open(f"{folder}/{user}/r{r} 02.txt", "w") as f:
            f.writelines(f"{121 + i}\t31.5\t{1427846410 + i}\n" for i in range(lines))
    got = positions.read_trip_text(spark, folder).collect()
    assert {(r["trip_id"], r["dd"]) for r in got} == {("P1 r0", 2), ("P1 r12", 2), ("P2 r1", 2)}
    one = sorted((r["seq"], r["lng"], r["epoch"]) for r in got if r["trip_id"] == "P1 r0")
    assert one == [(i, 121.0 + i, 1427846410 + i) for i in range(5)]


def test_large_text_file_is_numbered_across_splits(spark, folder):
    os.makedirs(f"{folder}/P1")
    with open(f"{folder}/P1/r0 01.txt", "w") as f:
        f.writelines(f"{i}.0\t1.0\t{i}\n" for i in range(5000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        points = positions.read_trip_text(spark, folder)
        assert spark.read.text(folder, recursiveFileLookup=True).rdd.getNumPartitions() > 1
        assert points.where("seq = epoch").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_requests(spark):
    sent = [
        ("a", "p", '{"10":[3.0,4.0],"2":[1.0,2.0]}'),
        ("b", "t", "[[5.0,6.0],[7.0,8.5],[9,10]]"),
        ("c", "t", "not json"),
    ]
    got = requests.decode_requests(spark.createDataFrame(sent, "req_id string, kind string, body string"))
    assert sorted(r[:] for r in got.collect()) == [
        ("a", 0, 1.0, 2.0), ("a", 1, 3.0, 4.0), ("b", 0, 5.0, 6.0), ("b", 1, 7.0, 8.5), ("b", 2, 9.0, 10.0),
    ]


def test_answers_as_json(make_points):
    lines = trip_polyline(make_points({"A": [(1, 2), (3, 4), (5, 6)]}), block=2)
    bodies = requests.encode_answer(lines.withColumn("qid", F.lit(1)).withColumn("rank", F.lit(1))).orderBy("block")
    assert [r["body"] for r in bodies.collect()] == [
        '{"trip_id":"A","points":[[1.0,2.0],[3.0,4.0]]}', '{"trip_id":"A","points":[[5.0,6.0]]}',
    ]


def test_requests_are_answered_from_body_to_body(spark, make_points):
    points = make_points({"A": [(1, 2), (3, 4)], "B": [(1, 2.5)], "C": [(9, 9)]})
    sent = [("a", "p", '{"1":[3.0,4.0],"0":[1.0,2.0]}', None, 2), ("b", "t", "[[1.0,2.6]]", "2024-01-01", 1), ("c", "t", "not json", None, 2), ("d", "t", "[[9,9]]", "2020-01-01", 2)]
    table = spark.createDataFrame(sent, "req_id string, kind string, body string, day string, k int").withColumn("day", F.col("day").cast("date"))
    got = {(r["req_id"], r["rank"], r["block"], r["body"]) for r in answers.answer_requests(points, table).collect()}
    assert got == {
        ("a", 1, 0, '{"trip_id":"A","points":[[1.0,2.0],[3.0,4.0]]}'), ("a", 2, 0, '{"trip_id":"B","points":[[1.0,2.5]]}'),
        ("b", 1, 0, '{"trip_id":"B","points":[[1.0,2.5]]}'), ("c", None, None, '{"error":"no points"}'),
    }


def test_ingest_writes_every_table(spark, folder):
    raw = positions.read_events_log(spark, "/root/testdata/sf0.001")
    for _ in range(2):  # a second run replaces the first
        out = ingest.ingest(raw, f"{folder}/city", 172800)
    kept = out.read_kept(spark)
    trips = out.read_by_user(spark)
    simplified = out.read_simplified(spark, "shanghai")
    assert kept.count() == trips.count() == clean_positions(raw).count()
    assert 0 < simplified.count() < trips.count()
    day = simplified.select("day").first()["day"].isoformat()
    one_day = out.read_index(spark, "shanghai").where(F.col("day") == F.lit(day).cast("date"))
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert all(f"isnotnull({c}" in plan.split("PartitionFilters")[1] for c in ("city", "day")) and "run#" in plan.split("PartitionFilters")[1]
    assert one_day.count() == simplified.where(F.col("day") == F.lit(day).cast("date")).count()
    cells = one_day.where(
        (F.col("cx") != nearest.cell(F.col("lng"), nearest.BASE_CELL)) | (F.col("city") != "shanghai")
    )
    assert cells.count() == 0
    trip = trips.first()["trip_id"]
    line = tables.fetch_trip(trips, trip).collect()
    assert [r["seq"] for r in line] == list(range(len(line)))


def test_long_query_trip_is_not_put_in_columns(make_points):
    trips = plain.random_trips(12, 10, seed=3) | {"long": plain.random_trips(1, 200, seed=70)["T000"]}
    trips["long"] = (trips["long"] * 8)[:130]
    points = make_points(trips)
    got = similar.best_connected_to_trip(points, "long", 3).collect()
    query = [trips["long"][i] for i in plain.outline(trips["long"], 1e-4)]
    assert len(query) > 96
    want = plain.top({t: plain.similarity(p, query) for t, p in trips.items()}, 3)
    assert [r["trip_id"] for r in got] == [t for t, _ in want]


def test_ingest_leaves_other_cities_and_months(spark, folder):
    raw = positions.read_events_log(spark, "/root/testdata/sf0.001")
    later = raw.withColumn("ts", F.expr("ts + interval 2 months"))
    counts = lambda df: {(r["city"], r["month"]): r["n"] for r in df.groupBy("city", "month").agg(F.count("*").alias("n")).collect()}
    out = ingest.ingest(raw, f"{folder}/grown", 172800)
    first, by_user, index = counts(out.read_kept(spark)), counts(out.read_by_user(spark)), out.read_index(spark).count()
    ingest.ingest(raw, f"{folder}/grown", 172800, city_name="pudong")
    ingest.ingest(later, f"{folder}/grown", 172800)
    for _ in range(2):
        ingest.ingest(raw, f"{folder}/grown", 172800, city_name="pudong")
    after, after_by_user = counts(out.read_kept(spark)), counts(out.read_by_user(spark))
    assert {k: after[k] for k in first} == first and {k: after_by_user[k] for k in by_user} == by_user
    assert sum(n for (city, _), n in after.items() if city == "shanghai") == 2 * sum(first.values())
    assert sum(n for (city, _), n in after.items() if city == "pudong") == sum(first.values())
    assert out.read_index(spark).count() == 3 * index


def test_longer_trips_after_the_first_call(make_points):
    short, long = plain.random_trips(6, 5, seed=1), plain.random_trips(3, 40, seed=5)
    query = [(121.1, 31.1), (121.2, 31.3), (121.3, 31.2)]
    for trips in (short, short | {f"L{t}": p for t, p in long.items()}):
        points = make_points(trips)
        got = {r["trip_id"]: r["value"] for r in edit.edit_distances(points, query, 4).collect()}
        assert got == {r["trip_id"]: r["value"] for r in edit.edit_distances(points, query).collect()}
        rows = ordered.ordered_scores(points, query, "ordered", block_points=4, query_block=2).collect()
        assert len(rows) == len(trips) == len(got)
