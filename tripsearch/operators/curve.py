"""Range search through a table ordered by a space-filling curve.

Every point has a Z-order key: the bits of its cell of ``WIDTH`` degrees on both axes, interleaved. Cells of any
coarser level are stretches of keys, so a disc is covered by the 3 x 3 cells at the level whose cells are as wide
as its radius: at most nine key ranges. The ranges of a batch, merged and coarsened to at most ``MOST_RANGES``, go into
the scan as filters on the key, so files, row groups and pages away from all discs are not read; then points and discs meet by an
equi-join on (level, cell).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.storage import durable

BITS = 20
WIDTH = 360.0 / 2**BITS
#: Ranges that a scan is filtered by. More are merged with what lies between them; the join is exact either way.
MOST_RANGES = 256
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def cell_of(degrees: Column) -> Column:
    """Number of the finest cell on one axis, 0 to 2**BITS - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(2**BITS - 1), F.floor((degrees + 180.0) / WIDTH))).cast("bigint")


def interleaved(x: Column, y: Column) -> Column:
    """The bits of two cell numbers in turn; those of cells at a coarser level are the same shifted by two bits a level."""

    def spread(v: Column) -> Column:
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def with_key(points: DataFrame) -> DataFrame:
    return points.withColumn("zkey", interleaved(cell_of(F.col("lng")), cell_of(F.col("lat"))))


def in_ranges(value: str, ranges: DataFrame, bits: int) -> Column:
    """Whether a column lies in one of ``ranges`` (lo, hi; inclusive), widened to at most MOST_RANGES stretches of equal low bits.

    Only that many ranges reach the driver, whatever their number: the table counts by itself how many are left
    when 0, 2, 4 .. low bits are ignored.
    """
    cut = F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(2)))
    coarse = ranges.select("lo", "hi", cut.alias("cut")).select("cut", F.expr("shiftright(lo, cut)").alias("lo"), F.expr("shiftright(hi, cut)").alias("hi"))
    coarse = durable(coarse.distinct(), "ranges")
    few = coarse.groupBy("cut").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_RANGES).agg(F.min("cut")).first()[0]
    if few is None:
        return F.lit(False) if coarse.isEmpty() else F.lit(True)
    merged: list[list[int]] = []
    for r in coarse.where(F.col("cut") == few).orderBy("lo").collect():
        lo, hi = r["lo"] << few, ((r["hi"] + 1) << few) - 1
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return reduce(lambda a, b: a | b, [F.col(value).between(lo, hi) for lo, hi in merged])


def disc_cells(query_points: DataFrame) -> DataFrame:
    """Query points (qid, qseq, qlng, qlat, day, radius) repeated for the 3 x 3 cells that cover their disc, with ``level``, ``cell`` and its key range."""
    steps = F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(WIDTH)) / WIDTH) + 1e-9)
    leveled = query_points.withColumn("level", F.least(steps, F.lit(BITS)).cast("int"))
    for axis, degrees in (("cx", "qlng"), ("cy", "qlat")):
        own = F.expr(f"shiftright({axis}, level)")
        leveled = leveled.withColumn(axis, cell_of(F.col(degrees))).withColumn(axis, F.explode(F.array(own - 1, own, own + 1)))
    last = F.expr(f"shiftright({2**BITS - 1}L, level)")
    inside = leveled.where((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") <= last) & (F.col("cy") <= last))
    found = inside.withColumn("cell", interleaved(F.col("cx"), F.col("cy"))).drop("cx", "cy")
    return found.withColumns({"lo": F.expr("shiftleft(cell, 2 * level)"), "hi": F.expr("shiftleft(cell + 1, 2 * level) - 1")})


def within_radius(index: DataFrame, query_points: DataFrame) -> DataFrame:
    """Pairs (query columns.., trip_id, seq, lng, lat, d) with d <= radius, read from a table with ``zkey`` and partitions by day.

    Dated and undated queries are two joins: the former meets only its days, which also prunes the partitions at run time.
    """
    cells = durable(disc_cells(query_points), "disc-cells")
    near = index.where(in_ranges("zkey", cells.select("lo", "hi"), 2 * BITS))
    away = geo.degrees_apart(F.col("lng"), F.col("lat"), F.col("qlng"), F.col("qlat"))
    facts = cells.agg(F.collect_set("level"), F.count("day"), F.count_if(F.col("day").isNull())).first()
    levels, dated, undated = sorted(facts[0]), facts[1], facts[2]
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(v) for v in levels]))
    asked = cells.drop("lo", "hi")
    met = near.select("trip_id", "seq", "lng", "lat", "day", "zkey", level.alias("level")) if levels else near.withColumn("level", F.lit(0))
    met = met.withColumn("cell", F.expr("shiftright(zkey, 2 * level)")).drop("zkey")
    parts = []
    if dated or not undated:
        parts.append(met.join(asked.where(F.col("day").isNotNull()), ["day", "level", "cell"]))
    if undated:
        parts.append(met.drop("day").join(asked.where(F.col("day").isNull()), ["level", "cell"]))
    columns = [*query_points.columns, "trip_id", "seq", "lng", "lat"]
    pairs = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return pairs.withColumn("d", away).where(F.col("d") <= F.col("radius"))
