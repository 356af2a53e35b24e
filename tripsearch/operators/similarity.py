"""Order-free similarity of trips to query points, and the k best-connected trips.

D(q, R) is the smallest distance of a trip's points to q, Sim(Q, R) the sum of exp(-D).
A query batch is a table (qid, qseq, qlng, qlat, day, k); a NULL day searches every day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo

SIM_DIGITS = 9


def _squared(x: float, y: float) -> str:
    """Squared distance of a point to (x, y), as text: one expression, however many there are, is one call to the planner."""
    dx, dy = f"(lng - {float(x)!r}D)", f"(lat - {float(y)!r}D)"
    return f"({dx} * {dx} + {dy} * {dy})"


def _total(names: list[str]) -> str:
    """The similarity from the squared distances of all query points."""
    return " + ".join(["0.0D", *[f"exp(-sqrt({name}))" for name in names]])


def trip_similarity(points: DataFrame, query: list[tuple[float, float]], day=None, more: Sequence[Column] = ()) -> DataFrame:
    """(trip_id, sim) of every trip with one query: one scan, one partial aggregate. ``more`` are named aggregates to add.

    Squared distances are minimised column by column, so no point is paired with the query
    in rows and only one small row per trip and task is shuffled.
    """
    if day is not None:
        points = points.where(F.col("day") == F.lit(day).cast("date"))
    names = [f"d{i}" for i in range(len(query))]
    nearest = [F.expr(f"min({_squared(x, y)}) as {name}") for name, (x, y) in zip(names, query)]
    total = F.expr(_total(names))
    scored = points.groupBy("trip_id").agg(*nearest, *more).withColumn("sim", total)
    return scored.select("trip_id", "sim", *scored.columns[1 + len(query) : -1])


def top_trips(scores: DataFrame, k: int, value: str = "sim", largest: bool = True) -> DataFrame:
    """The k best trips as (trip_id, value), values rounded so ties break by trip_id."""
    rounded = scores.select("trip_id", F.round(value, SIM_DIGITS).alias(value))
    order = F.desc(value) if largest else F.asc(value)
    return rounded.orderBy(order, "trip_id").limit(k)


def best_connected(points: DataFrame, query: list[tuple[float, float]], k: int, day=None) -> DataFrame:
    """The k trips that best connect the query points."""
    return top_trips(trip_similarity(points, query, day), k)


def rank_within(scores: DataFrame, keys: list[str], value: str = "sim", limit: Column | int | None = None) -> DataFrame:
    """Rank (trip_id, value) inside each key, keeping the first ``limit`` when given."""
    ordered = Window.partitionBy(*keys).orderBy(F.desc(value), "trip_id")
    ranked = scores.withColumn(value, F.round(value, SIM_DIGITS)).withColumn(
        "rank", F.row_number().over(ordered)
    )
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def batch_similarity_wide(points: DataFrame, queries: list, keys: list[str]) -> DataFrame:
    """(keys.., k, trip_id, sim) for a small batch given as rows of the query table.

    Every query point is one min() column, NULL on other days; the caller bounds the batch.
    """
    grouped: dict[tuple, list] = {}
    for row in queries:
        grouped.setdefault(tuple(row[key] for key in keys), []).append(row)
    nearest, scores = [], []
    days = {row["day"] for row in queries}
    for g, (ids, rows) in enumerate(grouped.items()):
        names = [f"d{g}_{i}" for i in range(len(rows))]
        for name, row in zip(names, rows):
            away = _squared(row["qlng"], row["qlat"])
            if row["day"] is not None:
                away = f"case when day = date'{row['day']}' then {away} end"
            nearest.append(F.expr(f"min({away}) as {name}"))
        key_cols = [F.lit(v).alias(key) for key, v in zip(keys, ids)]
        scores.append(F.struct(*key_cols, F.lit(rows[0]["k"]).cast("int").alias("k"), F.expr(_total(names)).alias("sim")))
    if None not in days:
        points = points.where(F.col("day").isin(sorted(days)))
    return (
        points.groupBy("trip_id").agg(*nearest)
        .select("trip_id", F.inline(F.array(*scores)))
        .where(F.col("sim").isNotNull())
    )


def merge_parts(scores: DataFrame) -> DataFrame:
    """Add up the partial similarities of a trip: (qid, trip_id, sim)."""
    return scores.groupBy("qid", "trip_id").agg(F.sum("sim").alias("sim"))
