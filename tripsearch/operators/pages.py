"""Nearest points through a directory of packed pages.

Points are sort-tile packed: range partitioned by day and longitude into strips, sorted by latitude inside, and cut
into pages of ``PAGE`` rows. The directory is a small table of nodes: the box and count of every page, and of every
``FAN`` pages, and so on up to at most ``ROOT`` nodes.

A query point descends level by level. The counts of the nodes at hand, nearest farthest corner first, tell a
distance within which the wanted number of points is sure to lie; nodes that begin beyond it are left, the others give their
children by a join. So each level keeps only the nodes around the answer, and in the end a few pages are read, by page number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.operators.curve import in_ranges
from tripsearch.storage import durable

PAGE_BITS = 10
FAN_BITS = 5
#: Most nodes of the top level; every query point starts with all of them.
ROOT = 64
_SLACK = 1e-9


def strips(points: DataFrame, page_bits: int = PAGE_BITS) -> int:
    """Strips of longitude, over all days, that make pages about as wide as high."""
    n, days = points.agg(F.count("*"), F.count_distinct("day")).first()
    return max(1, math.ceil(math.sqrt(n * max(1, days) / 2**page_bits)))


def packed(points: DataFrame, page_bits: int = PAGE_BITS) -> DataFrame:
    """``points`` in pages: adds ``page``. The number holds the strip and the place in it, so it has to be written as it is."""
    rows = points.repartitionByRange(strips(points, page_bits), "day", "lng", "lat").sortWithinPartitions("day", "lat", "lng")
    return rows.withColumn("page", F.shiftright(F.monotonically_increasing_id(), page_bits))


def directory(index: DataFrame) -> DataFrame:
    """Nodes (level, node, parent, x0, x1, y0, y1, n, first_day, last_day) over a written table of pages; level 0 has a node per page and day."""
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"),
           F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")]
    corners = index.select("page", "day", F.col("lng").alias("x0"), F.col("lng").alias("x1"), F.col("lat").alias("y0"), F.col("lat").alias("y1"),
                           F.lit(1).cast("bigint").alias("n"), F.col("day").alias("first_day"), F.col("day").alias("last_day"))
    level, number = durable(corners.groupBy(F.col("page").alias("node"), "day").agg(*box).drop("day"), "pages"), 0
    nodes = []
    while True:
        nodes.append(level.withColumns({"level": F.lit(number), "parent": F.shiftright("node", FAN_BITS)}))
        if level.count() <= ROOT:
            break
        level, number = durable(level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*box), "pages"), number + 1
    out = nodes[0]
    for part in nodes[1:]:
        out = out.unionByName(part)
    return out


def write_directory(index: DataFrame, path: str) -> None:
    directory(index).write.mode("overwrite").partitionBy("level").parquet(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _outside(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - value, value - high, F.lit(0.0))


def _kept(found: DataFrame) -> DataFrame:
    """Of the nodes of each query point those that may hold one of its ``lam`` nearest points, with the ``reach`` that is sure to hold them."""
    dx, dy = _outside(F.col("qlng"), F.col("x0"), F.col("x1")), _outside(F.col("qlat"), F.col("y0"), F.col("y1"))
    fx = F.greatest(F.abs(F.col("qlng") - F.col("x0")), F.abs(F.col("qlng") - F.col("x1")))
    fy = F.greatest(F.abs(F.col("qlat") - F.col("y0")), F.abs(F.col("qlat") - F.col("y1")))
    sure = F.col("qday").isNull() | ((F.col("first_day") == F.col("qday")) & (F.col("last_day") == F.col("qday")))
    of_point = Window.partitionBy("qid", "qseq")
    held = F.sum(F.when(sure, F.col("n")).otherwise(0)).over(of_point.orderBy("far", "node").rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.where(F.col("qday").isNull() | F.col("qday").between(F.col("first_day"), F.col("last_day")))
        .withColumns({"near": F.sqrt(dx * dx + dy * dy), "far": F.sqrt(fx * fx + fy * fy)})
        .withColumn("held", held)
        .withColumn("reach", F.coalesce(F.min(F.when(F.col("held") >= F.col("lam"), F.col("far"))).over(of_point), F.lit(float("inf"))))
        .where(F.col("near") <= F.col("reach") + _SLACK)
    )


def nearest_points(index: DataFrame, nodes: DataFrame, query_points: DataFrame) -> DataFrame:
    """The ``lam`` nearest points of every query point (qid, qseq, qlng, qlat, day, lam) in a table of pages with its directory.

    Returns (qid, qseq, trip_id, seq, lng, lat, d, nn); equal distances go by trip and seq.
    """
    asked = query_points.withColumnRenamed("day", "qday").select("qid", "qseq", "qlng", "qlat", "qday", "lam")
    box = ["x0", "x1", "y0", "y1", "n", "first_day", "last_day"]
    top, most = nodes.agg(F.max("level")).first()[0], query_points.agg(F.max("lam")).first()[0]
    if top is None or most is None:
        nothing = asked.join(index.select("trip_id", "seq", "lng", "lat").where("false"), F.lit(True)).where("false")
        return nothing.select("qid", "qseq", "trip_id", "seq", "lng", "lat", F.lit(0.0).alias("d"), F.lit(1).alias("nn"))
    root = nodes.where(F.col("level") == top).select("node", *box).collect()  # at most ROOT rows
    literal = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("node", *box)]) for r in root])
    found = asked.withColumn("r", F.explode(literal)).select(*asked.columns, "r.*")
    for level in range(top, 0, -1):
        kept = durable(_kept(found).select(*asked.columns, F.col("node").alias("parent")), "descent")
        below = nodes.where(F.col("level") == level - 1).select("parent", "node", *box)
        found = kept.join(below, "parent").drop("parent")
    pages = durable(_kept(found).select(*asked.columns, F.col("node").alias("page"), F.col("first_day").alias("day"), "reach"), "descent")
    read = index.where(in_ranges("page", pages.select(F.col("page").alias("lo"), F.col("page").alias("hi")), 62))
    nearest = Window.partitionBy("qid", "qseq").orderBy("d", "trip_id", "seq")
    d = geo.degrees_apart(F.col("lng"), F.col("lat"), F.col("qlng"), F.col("qlat"))
    return (
        read.join(pages, ["page", "day"]).withColumn("d", d).where(F.col("d") <= F.col("reach") + _SLACK)
        .select("qid", "qseq", "lam", "trip_id", "seq", "lng", "lat", F.round("d", 12).alias("d"))
        .withColumn("nn", F.row_number().over(nearest))
        .where(F.col("nn") <= int(most))  # a constant bound lets each task keep only its own nearest
        .where(F.col("nn") <= F.col("lam"))
        .drop("lam")
    )
