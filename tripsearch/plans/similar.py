"""Trips similar to a given trip, and ranking by any measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsearch.operators import bounds, edit, enclosed, nearest, ordered, outline, similarity, tripcells
from tripsearch.plans import search
from tripsearch.storage import durable

MEASURES = ("unordered", *ordered.MEASURES, "edwp")
DISTANCES = ("lcss", "edwp")
SEED_FACTOR = 4


Query = list[tuple[float, float]] | DataFrame


def scores(points: DataFrame, query: Query, measure: str, last: int | None = None) -> DataFrame:
    """(trip_id, value) of every trip by one of MEASURES. A table (qseq, qlng, qlat) as the query may have any length; not for ``unordered``."""
    if measure == "unordered":
        return similarity.trip_similarity(points, query).withColumnRenamed("sim", "value")
    if measure == "edwp":
        return edit.edit_distances(points, query)
    return ordered.ordered_scores(points, query, measure, last=last).select("trip_id", "value")


def best_possible(points: DataFrame, query: list[tuple[float, float]], measure: str) -> DataFrame:
    """(trip_id, value, last) no worse than the trip's score, from one scan without ordering; ``last`` is the trip's largest ``seq``.

    Dropping the order can only help: ``ordered`` is at most the order-free similarity, and
    a common subsequence is no longer than the number of query points the trip passes.
    """
    if measure == "ordered":
        return similarity.trip_similarity(points, query, more=[F.max("seq").alias("last")]).withColumnRenamed("sim", "value")
    near = ordered.LCSS_THRESHOLD
    passed = [
        F.max(((F.abs(F.col("lng") - x) <= near) & (F.abs(F.col("lat") - y) <= near)).cast("int")).alias(f"p{i}")
        for i, (x, y) in enumerate(query)
    ]
    shorter = F.least(F.col("n"), F.lit(len(query)))
    total = F.lit(0)
    for i in range(len(query)):
        total = total + F.col(f"p{i}")
    either_single = (F.col("n") == 1) | F.lit(len(query) == 1)
    value = F.when(either_single, 0.0).otherwise(1 - F.least(total, shorter) / shorter)
    held = points.groupBy("trip_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), *passed)
    return held.select("trip_id", value.alias("value"), "last")


def trip_as_query(points: DataFrame, trip_id: str) -> DataFrame:
    """All points of a trip as a query, written once."""
    own = points.where(F.col("trip_id") == trip_id)
    return durable(own.select(F.col("seq").alias("qseq"), F.col("lng").alias("qlng"), F.col("lat").alias("qlat")), "query-trip")


def top_by_trip(points: DataFrame, trip_id: str, k: int, measure: str = "ordered") -> DataFrame:
    """The k best trips by an order-aware measure or a distance to a whole trip of any length."""
    query = trip_as_query(points, trip_id)
    if measure == "edwp":
        return edit.nearest_by_edit(points, query, k)
    return similarity.top_trips(scores(points, query, measure), k, "value", measure not in DISTANCES)


def top_by_measure(
    points: DataFrame, query: list[tuple[float, float]], k: int, measure: str = "ordered", cells: DataFrame | None = None
) -> DataFrame:
    """The k best trips by a measure: nearest first for distances, most similar first otherwise.

    For ``ordered`` and ``lcss`` the array walk is kept to trips that can still make it: the
    k-th score among the most promising trips rules out every trip whose best possible score
    is worse. Ties stay in, so the answer is exact. With ``cells``, the index of ``tripcells``, best possible scores are
    read from the index, and points are read of the walked trips only.
    """
    largest = measure not in DISTANCES
    if measure == "edwp" and query:
        return edit.nearest_by_edit(points, query, k)
    if measure not in ("ordered", "lcss") or not query or len(query) > search.WIDE_POINTS:
        return similarity.top_trips(scores(points, query, measure), k, "value", largest)
    hopes = best_possible(points, query, measure) if cells is None else tripcells.best_possible(cells, query, measure)
    hopes = durable(hopes, "best-possible")
    last = hopes.agg(F.max("last")).first()[0]
    first = similarity.top_trips(hopes, SEED_FACTOR * k, "value", largest).select("trip_id")

    def walked(trips: DataFrame) -> DataFrame:
        return scores(points.join(trips.select("trip_id"), "trip_id", "left_semi"), query, measure, last)

    seeds = durable(walked(first), "seed-scores")
    floor = similarity.top_trips(seeds, k, "value", largest).agg(
        F.count("*").alias("n"), (F.min("value") if largest else F.max("value")).alias("value")
    ).first()
    if floor["n"] == k:
        slack = 1e-8
        keep = F.col("value") >= floor["value"] - slack if largest else F.col("value") <= floor["value"] + slack
        hopes = hopes.where(keep)
    rest = hopes.join(first, "trip_id", "left_anti")
    return similarity.top_trips(seeds.unionByName(walked(rest)), k, "value", largest)


def best_connected_to_trip(
    points: DataFrame, trip_id: str, k: int = 3, day=None, counts: DataFrame | None = None
) -> DataFrame:
    """Outline a trip with a fine tolerance and search with the points that remain.

    The query stays a table, so a trip of any length can be one.
    """
    trip = points.where(F.col("trip_id") == trip_id)
    query = durable(
        outline.outline_trips(trip, outline.SEARCH_EPSILON).select(
            F.lit(0).alias("qid"), F.col("seq").cast("int").alias("qseq"), F.col("lng").alias("qlng"), F.col("lat").alias("qlat"),
            F.lit(day).cast("date").alias("day"), F.lit(k).alias("k"),
        ), "query-trip",
    )
    return search.best_connected_batch(points, query, counts=counts).orderBy("rank").select("trip_id", "sim")


def best_ordered_batch(points: DataFrame, queries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(qid, rank, trip_id, value): exact k best trips by the ``ordered`` measure of a table of queries, each with its own day and k.

    Nothing but the nearest points of the query points is looked at until the answer is enclosed: their trips have bounds on
    both sides, and a trip that no query point has reached earns at most the sum of the tails. A query is through when its
    k-th lower bound reaches that sum or when it has seen all points; the others look further. Only trips whose
    upper bound reaches the k-th lower bound are walked whole.
    """
    queries = durable(queries, "queries")
    if counts is None:
        counts = durable(nearest.cell_counts(points), "cell-counts")
    points = search.on_asked_days(points, queries)
    batch = queries.select("qid", "k").distinct()
    largest = batch.agg(F.max("k")).first()[0] or 0
    asked = queries.withColumn("lam", (F.col("k") * SEED_FACTOR).cast("bigint"))
    kept = []
    while not asked.isEmpty():
        found = durable(nearest.nearest_points(points, asked, counts), "near")
        asked = asked.join(found.select("qid").distinct(), "qid", "left_semi")  # the others have no point to find
        looks = bounds.look_radii(found).join(asked.select("qid", "qseq", "lam"), ["qid", "qseq"])
        looks = looks.withColumn("all_seen", F.col("returned") < F.col("lam"))
        limits = durable(enclosed.enclosing_bounds(found, asked), "enclosed")
        settled = durable(bounds.settled_queries(looks, bounds.kth_lower_bound(limits, batch, largest)), "settled")
        kept.append(bounds.refine_survivors(limits.join(settled.select("qid"), "qid", "left_semi"), settled))
        further = asked.join(settled, "qid", "left_anti").withColumn("lam", F.col("lam") * SEED_FACTOR)
        asked = durable(further, "asked")
    if not kept:
        return batch.where(F.lit(False)).select("qid", F.lit(0).alias("rank"), F.lit("").alias("trip_id"), F.lit(0.0).alias("value"))
    survivors = durable(reduce(DataFrame.unionByName, kept), "survivors")
    scored = enclosed.exact_scores(points, survivors, queries).join(batch, "qid")
    ranked = similarity.rank_within(scored, ["qid"], "value", limit=largest)
    return ranked.where(F.col("rank") <= F.col("k")).select("qid", "rank", "trip_id", "value")
