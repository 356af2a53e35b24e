"""Index from grid cells to trips: for every trip and cell it enters, how many points it has there and the box they lie in.

A trip of many points has few rows here, so what a trip can earn at best by an order-aware measure is read off
the index instead of the points: no point of a cell is nearer to a query point than the cell's box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.operators import ordered

CELL = 0.02


def trip_cells(points: DataFrame, width: float = CELL) -> DataFrame:
    """(trip_id, cx, cy, n, west, east, south, north, last); ``last`` is the largest ``seq`` in the cell."""
    cell = lambda name, of: F.floor(F.col(of) / width).cast("bigint").alias(name)
    return points.groupBy("trip_id", cell("cx", "lng"), cell("cy", "lat")).agg(
        F.count("*").alias("n"), F.min("lng").alias("west"), F.max("lng").alias("east"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.max("seq").alias("last"),
    )


def _gap(x: float, y: float) -> tuple[Column, Column]:
    """How far a place lies from a box along each axis; 0 inside."""
    beside = lambda at, low, high: F.greatest(F.col(low) - F.lit(at), F.lit(at) - F.col(high), F.lit(0.0))
    return beside(x, "west", "east"), beside(y, "south", "north")


def best_possible(cells: DataFrame, query: list[tuple[float, float]], measure: str) -> DataFrame:
    """(trip_id, value, last): no trip's score is better than ``value``, by ``ordered`` or ``lcss``. One aggregation over the index.

    ``ordered`` earns at most exp(-d) at a query point, d being the distance to the trip's nearest box; a common subsequence
    holds only query points that come within the threshold of some box.
    """
    near = ordered.LCSS_THRESHOLD
    best = []
    for i, (x, y) in enumerate(query):
        dx, dy = _gap(float(x), float(y))
        best.append((F.min(dx * dx + dy * dy) if measure == "ordered" else F.max(((dx <= near) & (dy <= near)).cast("int"))).alias(f"b{i}"))
    held = cells.groupBy("trip_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"), *best)
    total = F.lit(0)
    for i in range(len(query)):
        total = total + (geo.closeness(F.sqrt(f"b{i}")) if measure == "ordered" else F.col(f"b{i}"))
    if measure == "ordered":
        return held.select("trip_id", total.alias("value"), "last")
    shorter = F.least(F.col("n"), F.lit(len(query)))
    either_single = (F.col("n") == 1) | F.lit(len(query) == 1)
    value = F.when(either_single, 0.0).otherwise(1 - F.least(total, shorter) / shorter)
    return held.select("trip_id", value.alias("value"), "last")
