"""Range and nearest-point search through the ordered tables."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tests import plain
from tripsearch.operators import curve, pages
from tripsearch.sources import tables

DAYS = ["2024-01-01", "2024-01-02", "2024-01-05"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(41)
    rows = []
    for n in range(3000):
        hot = n % 3 == 0  # a third of all points on one spot
        x, y = (121.5, 31.2) if hot else (rng.uniform(120, 123), rng.uniform(30.5, 32.5)) if n % 50 else (rng.uniform(-180, 180), rng.uniform(-90, 90))
        rows.append((f"T{n % 200:03d}", n, x, y, DAYS[n % 7 % 3]))
    table = spark.createDataFrame(rows, "trip_id string, seq bigint, lng double, lat double, day string")
    return table.selectExpr("trip_id", "seq", "lng", "lat", "cast(day as date) as day").repartition(4)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def asked(spark, rows, last):
    table = spark.createDataFrame(rows, f"qid int, qseq int, qlng double, qlat double, day string, {last}")
    return table.withColumn("day", F.col("day").cast("date"))


def queries(last):
    rng = random.Random(42)
    out = [(1, 0, 121.5, 31.2, None, last(0)), (1, 1, 121.5, 31.2, DAYS[1], last(1)), (2, 0, -179.9, 89.9, None, last(2)), (3, 0, 121.0, 31.0, "2020-01-01", last(3))]
    return out + [(9, i, rng.uniform(120, 123), rng.uniform(30.5, 32.5), rng.choice([None, *DAYS]), last(i)) for i in range(12)]


def test_neighbouring_bits():
    def code(x, y):
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(curve.BITS))

    rng = random.Random(1)
    assert all(code(x, y) >> 2 * k == code(x >> k, y >> k) for x, y, k in ((rng.randrange(2**20), rng.randrange(2**20), rng.randrange(20)) for _ in range(50)))


def test_keys(spark, points):
    def code(x, y):
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(curve.BITS))

    cell = lambda v: max(0, min(2**curve.BITS - 1, int((v + 180) // curve.WIDTH)))
    assert all(r["zkey"] == code(cell(r["lng"]), cell(r["lat"])) for r in curve.with_key(points).limit(500).collect())


def test_range_search(spark, points):
    path = folder()
    tables.write_curve_index(points, path, page_rows=100)
    index = tables.read_day(spark, path)
    batch = queries(lambda i: [0.0, 0.05, 7.0, 0.4, 0.1, 0.002][i % 6])
    got = sorted((r["qid"], r["qseq"], r["trip_id"], r["seq"]) for r in curve.within_radius(index, asked(spark, batch, "radius double")).collect())
    want = sorted(
        (q[0], q[1], p["trip_id"], p["seq"]) for p in points.collect() for q in batch
        if (q[4] is None or q[4] == str(p["day"])) and plain.apart((p["lng"], p["lat"]), (q[2], q[3])) <= q[5]
    )
    assert got == want and want
    assert curve.within_radius(index, asked(spark, [], "radius double")).count() == 0


def test_many_ranges_are_merged_and_stay_exact(spark, points, monkeypatch):
    path = folder()
    tables.write_curve_index(points, path)
    batch = asked(spark, queries(lambda i: 0.05), "radius double")
    want = sorted(map(tuple, curve.within_radius(tables.read_day(spark, path), batch).collect()), key=repr)
    monkeypatch.setattr(curve, "MOST_RANGES", 2)
    assert sorted(map(tuple, curve.within_radius(tables.read_day(spark, path), batch).collect()), key=repr) == want


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet") and "zkey" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_small_disc_reads_few_rows_and_its_day_only(spark):
    """Pushed ranges skip pages, the day its partitions."""
    n = 60000
    table = spark.range(n).selectExpr(
        "concat('T', id % 500) as trip_id", "id as seq", "120 + (id * 7919 % 60000) / 20000 as lng", "30.5 + (id * 104729 % 60000) / 30000 as lat",
        "date_add(date'2024-01-01', cast(id % 2 as int)) as day",
    )
    path = folder()
    tables.write_curve_index(table, path, page_rows=200)
    read = []
    for radius in (0.01, 0.1, 2.0):
        found = curve.within_radius(tables.read_day(spark, path), asked(spark, [(1, 0, 121.3, 31.4, "2024-01-01", radius)], "radius double"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(zkey" in plan and "dynamicpruning" in plan
        read.append(rows_read(found))
    assert read[0] <= n / 50 and read[0] < read[1] < n / 4 <= read[2] <= n / 2


@pytest.mark.parametrize("bits", [3, 10])
def test_nearest_points(spark, points, bits):
    path = folder()
    tables.write_page_index(points, path, page_bits=bits)
    index, nodes = tables.read_page_index(spark, path)
    assert nodes.where("level = 0").agg(F.sum("n")).first()[0] == points.count()
    assert nodes.groupBy("level").count().orderBy(F.desc("level")).first()["count"] <= pages.ROOT
    batch = queries(lambda i: [5, 1, 40, 3, 2000][i % 5])
    got = {}
    for r in pages.nearest_points(index, nodes, asked(spark, batch, "lam int")).collect():
        got.setdefault((r["qid"], r["qseq"]), {})[r["nn"]] = (r["trip_id"], r["seq"])
    held = points.collect()
    for qid, qseq, x, y, day, lam in batch:
        near = sorted((round(plain.apart((p["lng"], p["lat"]), (x, y)), 12), p["trip_id"], p["seq"]) for p in held if day is None or day == str(p["day"]))[:lam]
        assert got.get((qid, qseq), {}) == {i + 1: (t, s) for i, (_, t, s) in enumerate(near)}


def test_the_descent_reads_few_pages(spark, points):
    path = folder()
    spread = points.where("lng <> 121.5")
    tables.write_page_index(spread, path, page_bits=4)
    index, nodes = tables.read_page_index(spark, path)
    found = pages.nearest_points(index, nodes, asked(spark, [(1, 0, 121.3, 31.4, None, 3)], "lam int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(page" in plan
    assert nodes.where("level = 0").count() > 100 and found.count() == 3


def test_empty_index(spark, points):
    path = folder()
    tables.write_page_index(points, path)
    index, nodes = tables.read_page_index(spark, path)
    assert pages.nearest_points(index, nodes, asked(spark, [], "lam int")).count() == 0
    assert pages.nearest_points(index.where("false"), nodes.where("false"), asked(spark, [(1, 0, 1.0, 2.0, None, 3)], "lam int")).count() == 0
