"""Several logs in one folder: ids, trips over the end of a log, repeats, failures."""

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from tripsearch.operators.trips import clean_positions, cut_trips
from tripsearch.plans import ingest
from tripsearch.plans.ingest import TripTables
from tripsearch.sources import positions, runs, tables

GAP = 172800
RAW = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def log(spark, rows):
    start = datetime.datetime(2015, 4, 30)
    table = [(u, i, start + datetime.timedelta(seconds=s), 121.4 + s * 1e-6, 31.2) for i, (u, s) in enumerate(rows)]
    return spark.createDataFrame(table, "obd_id string, event_id bigint, ts timestamp_ntz, lng double, lat double")


def trips(df):
    return sorted((r["trip_id"], str(r["day"]), r["seq"], r["ts"]) for r in df.collect())


def whole(spark, raw, gap=GAP):
    return trips(cut_trips(clean_positions(raw), gap))


def test_logs_in_turn_are_one_log(spark, folder):
    raw = positions.read_events_log(spark, RAW)
    edges = ["2024-01-01", "2024-01-09", "2024-01-17 12:00:00", "2024-01-18", "2024-02-01"]
    parts = [raw.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(edges, edges[1:])]
    for i, part in enumerate(parts):
        out = ingest.ingest(part, folder, GAP, log=f"part {i}")
    want = whole(spark, raw)
    assert trips(out.read_by_user(spark)) == want
    index = out.read_index(spark).select("trip_id", "seq", "day")
    assert index.exceptAll(out.read_simplified(spark).select("trip_id", "seq", "day")).isEmpty() and index.count() > 0
    once = ingest.ingest(raw, f"{folder}/once", GAP)
    columns = ["trip_id", "day", "seq", "lng", "lat"]
    assert sorted(out.read_simplified(spark).select(*columns).collect()) == sorted(once.read_simplified(spark).select(*columns).collect())
    # logs can be repeated, the newest and an older one alike
    for i in (3, 1):
        ingest.ingest(parts[i], folder, GAP, log=f"part {i}")
        assert trips(out.read_by_user(spark)) == want
        assert out.read_kept(spark).count() == len(want)
    assert out.read_late(spark).count() == 0


def test_a_trip_over_midnight_of_the_months_end(spark, folder):
    april = log(spark, [("U1", 100), ("U1", 86390), ("U2", 80000), ("U2", 86399)])
    may = log(spark, [("U1", 86500), ("U1", 200000), ("U2", 95000), ("U3", 95000)])
    ingest.ingest(april, folder, 1500)
    out = TripTables(folder)
    assert {(r["trip_id"], str(r["day"])) for r in out.read_by_user(spark).collect()} == {("U1 r0", "2015-04-30"), ("U1 r1", "2015-04-30"), ("U2 r0", "2015-04-30"), ("U2 r1", "2015-04-30")}
    ingest.ingest(may, folder, 1500)
    got = {}
    for r in out.read_by_user(spark).collect():
        got.setdefault((r["trip_id"], str(r["day"])), []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {
        ("U1 r0", "2015-04-30"): [0], ("U1 r1", "2015-05-01"): [0, 1], ("U1 r2", "2015-05-02"): [0], ("U2 r0", "2015-04-30"): [0],
        ("U2 r1", "2015-04-30"): [0], ("U2 r2", "2015-05-01"): [0], ("U3 r0", "2015-05-01"): [0],
    }
    assert {h.log for h in runs.histories(spark, folder)["shanghai"][1]} == {"2015-04", "2015-05"}


def test_late_points_are_kept_apart(spark, folder):
    ingest.ingest(log(spark, [("U1", 5000), ("U2", 100)]), folder, 1500, log="a")
    out = ingest.ingest(log(spark, [("U1", 4000), ("U1", 5100), ("U2", 50), ("U3", 1)]), folder, 1500, log="b")
    assert sorted(r["obd_id"] for r in out.read_late(spark).collect()) == ["U1", "U2"]
    assert out.read_by_user(spark).count() == 4


def test_a_changed_earlier_log_is_refused(spark, folder):
    ingest.ingest(log(spark, [("U1", 100)]), folder, 1500, log="a")
    out = ingest.ingest(log(spark, [("U1", 9000)]), folder, 1500, log="b")
    before = trips(out.read_by_user(spark))
    with pytest.raises(ValueError, match="b were numbered after it"):
        ingest.ingest(log(spark, [("U1", 100), ("U1", 5000)]), folder, 1500, log="a")
    assert trips(out.read_by_user(spark)) == before


def test_readers_see_nothing_of_a_failed_run(spark, folder, monkeypatch):
    out = ingest.ingest(log(spark, [("U1", 100), ("U2", 86000)]), folder, 1500, log="a")
    before, index = trips(out.read_by_user(spark)), out.read_index(spark).count()

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    more = log(spark, [("U1", 9000), ("U2", 86500)])
    with monkeypatch.context() as patched:
        patched.setattr(tables, "write_point_index", fail)
        with pytest.raises(RuntimeError):
            ingest.ingest(more, folder, 1500, log="b")
    assert trips(out.read_by_user(spark)) == before and out.read_index(spark).count() == index
    ingest.ingest(more, folder, 1500, log="b")
    assert {r["trip_id"] for r in out.read_by_user(spark).collect()} == {"U1 r0", "U1 r1", "U2 r0"}


def test_logs_without_points(spark, folder):
    nothing = log(spark, [("U1", 1)]).where("lng < 0")
    out = ingest.ingest(nothing, folder, 1500)
    assert runs.histories(spark, folder) == {}
    ingest.ingest(log(spark, [("U1", 100)]), folder, 1500, log="a")
    ingest.ingest(nothing, folder, 1500, log="b")
    out_of_city = log(spark, [("U1", 300)]).withColumn("lng", F.lit(110.0))
    ingest.ingest(out_of_city, folder, 1500, log="c")
    ingest.ingest(log(spark, [("U1", 400)]), folder, 1500, log="d")
    assert [r["seq"] for r in out.read_by_user(spark).orderBy("seq").collect()] == [0, 1]


def test_reading_one_city_prunes_partitions(spark, folder):
    out = ingest.ingest(log(spark, [("U1", 100), ("U1", 90000)]), folder, 1500)
    ingest.ingest(log(spark, [("U1", 100)]), folder, 1500, city_name="pudong")
    plan = out.read_simplified(spark, "shanghai").where("day = date'2015-05-01'")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "run#" in filters and "day#" in filters and "city#" in filters
    assert out.read_simplified(spark).groupBy("city").count().count() == 2
