"""Distance-limited and nearest-point joins between query points and trip points.

Both are equi-joins on grid cells: a query point is listed in the 3 x 3 cells around it,
with cells as wide as the search radius, so only points near a query point meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.storage import durable

BASE_CELL = 0.005
LEVELS = 17  # widths 0.005 .. 327 degrees: the 3 x 3 cells of the top level hold everything


def cell(value: Column, width: Column | float) -> Column:
    width = width if isinstance(width, Column) else F.lit(float(width))
    return F.floor(value / width).cast("bigint")


def around(index: Column) -> Column:
    return F.explode(F.array(index - 1, index, index + 1))


def _ring(query_points: DataFrame, width: Column | float) -> DataFrame:
    """Query points repeated for the 3 x 3 cells around them."""
    return query_points.withColumn("cx", around(cell(F.col("qlng"), width))).withColumn(
        "cy", around(cell(F.col("qlat"), width))
    )


def _same_day() -> Column:
    return F.col("qday").isNull() | (F.col("qday") == F.col("day"))


def level_width(level: Column) -> Column:
    return F.lit(BASE_CELL) * F.pow(F.lit(2.0), level)


def level_for(radius: Column) -> Column:
    """The finest level whose cells are at least ``radius`` wide."""
    steps = F.ceil(F.log2(F.greatest(radius, F.lit(BASE_CELL)) / BASE_CELL) + 1e-9)
    return F.least(steps, F.lit(LEVELS - 1)).cast("int")


def meet(points: DataFrame, query_points: DataFrame) -> DataFrame:
    """Pairs (query columns.., trip_id, seq, lng, lat, d) of points in the 3 x 3 cells around
    each query point at the query point's own ``level``, on the query's day.

    The query table is a written one: its levels and its bounding box are read first, the
    box goes into the scan, and neither join side is hinted. The query side is broadcast
    while it is small by its real size; beyond that the join shuffles on cells and skewed
    cells are split at run time.
    """
    reach = level_width(F.col("level")) * 2
    facts = query_points.agg(
        F.collect_set("level"),
        F.min(F.col("qlng") - reach), F.max(F.col("qlng") + reach),
        F.min(F.col("qlat") - reach), F.max(F.col("qlat") + reach),
        F.min("day"), F.max("day"), F.count_if(F.col("day").isNull()),
    ).first()
    levels, dated = sorted(facts[0]), facts[7] == 0
    if not levels:
        levels, near = [0], points.where(F.lit(False))
    else:
        near = points.where(F.col("lng").between(facts[1], facts[2]) & F.col("lat").between(facts[3], facts[4]))
        if dated:
            near = near.where(F.col("day").between(facts[5], facts[6]))
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(i) for i in levels]))
    width = level_width(F.col("level"))
    cells = (
        near.select("trip_id", "seq", "day", "lng", "lat", level.alias("level"))
        .withColumn("cx", cell(F.col("lng"), width))
        .withColumn("cy", cell(F.col("lat"), width))
    )
    away = geo.degrees_apart(F.col("lng"), F.col("lat"), F.col("qlng"), F.col("qlat"))
    ring = _ring(query_points, width)
    if dated:
        pairs = cells.join(ring, ["level", "cx", "cy", "day"])
    else:
        pairs = cells.join(ring.withColumnRenamed("day", "qday"), ["level", "cx", "cy"]).where(_same_day())
        pairs = pairs.drop("qday")
    return pairs.drop("cx", "cy", "level", "day").withColumn("d", away)


def within_radius(points: DataFrame, query_points: DataFrame) -> DataFrame:
    """Pairs of query points (.., radius) and trip points with d <= radius."""
    leveled = query_points.withColumn("level", level_for(F.col("radius")))
    return meet(points, leveled).where(F.col("d") <= F.col("radius"))


def cell_counts(points: DataFrame) -> DataFrame:
    """Points per (day, level, cell) for every level: the density table beside the point table.

    Points are counted per base cell first; the coarser levels add up those counts.
    """
    base = points.groupBy(
        "day", cell(F.col("lng"), BASE_CELL).alias("bx"), cell(F.col("lat"), BASE_CELL).alias("by")
    ).agg(F.count("*").alias("n"))
    shrink = F.pow(F.lit(2.0), F.col("level"))
    return (
        base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        .groupBy("day", "level", F.floor(F.col("bx") / shrink).cast("bigint").alias("cx"),
                 F.floor(F.col("by") / shrink).cast("bigint").alias("cy"))
        .agg(F.sum("n").alias("n"))
    )


def search_levels(query_points: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``level``: cells at which the 3 x 3 ring is sure to hold the ``lam`` nearest points.

    If the ring of a finer level holds lam points, the lam-th lies within 2 * sqrt(2) of its
    cells, and cells two levels up are wider than that. The top level always qualifies, so a
    query point with fewer than lam points in reach gets them all.
    """
    rings = _ring(
        query_points.withColumnRenamed("day", "qday")
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))),
        level_width(F.col("level")),
    )
    return (
        rings.join(counts, ["level", "cx", "cy"])
        .where(_same_day())
        .withColumn("day", F.col("qday"))
        .groupBy(*query_points.columns, "level").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= F.col("lam")) | (F.col("level") == LEVELS - 1))
        .groupBy(*query_points.columns)
        .agg(F.least(F.min("level") + 2, F.lit(LEVELS - 1)).alias("level"))
    )


def nearest_points(points: DataFrame, query_points: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The ``lam`` nearest trip points of every query point (qid, qseq, qlng, qlat, day, lam).

    Returns (qid, qseq, trip_id, seq, lng, lat, d, nn); equal distances go by trip and seq.
    """
    if counts is None:
        counts = cell_counts(points)
    leveled = durable(search_levels(query_points, counts), "search-levels")
    most = leveled.agg(F.max("lam")).first()[0] or 0
    nearest = Window.partitionBy("qid", "qseq").orderBy("d", "trip_id", "seq")
    return (
        meet(points, leveled)
        .select("qid", "qseq", "lam", "trip_id", "seq", "lng", "lat", F.round("d", 12).alias("d"))
        .withColumn("nn", F.row_number().over(nearest))
        .where(F.col("nn") <= int(most))  # a constant bound lets each task keep only its own nearest
        .where(F.col("nn") <= F.col("lam"))
        .drop("lam")
    )
