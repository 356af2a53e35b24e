"""Measuring searches: sampled query trips, accuracy, trip lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.plans.search import best_connected_batch


def trips_by_length(catalog: DataFrame) -> DataFrame:
    """(n, trips): how many trips have n points."""
    return catalog.groupBy("n").agg(F.count("*").alias("trips"))


def sample_queries(catalog: DataFrame, lengths: list[int], per_length: int) -> DataFrame:
    """A repeatable sample of trips of exactly each length: (trip_id, day, n, pick).

    Trips are drawn in the order of a hash of their id.
    """
    drawn = Window.partitionBy("n").orderBy(F.md5(F.col("trip_id").cast("binary")), "trip_id")
    return (
        catalog.where(F.col("n").isin(lengths))
        .select("trip_id", "day", "n", F.row_number().over(drawn).alias("pick"))
        .where(F.col("pick") <= per_length)
    )


def queries_from_sample(points: DataFrame, sample: DataFrame, per_length: int, k: int) -> DataFrame:
    """Query table of the sampled trips, each searching its own day."""
    return points.join(sample.drop("day"), "trip_id").select(
        (F.col("n") * per_length + F.col("pick") - 1).cast("int").alias("qid"),
        F.col("seq").cast("int").alias("qseq"),
        F.col("lng").alias("qlng"), F.col("lat").alias("qlat"), "day",
        F.lit(k).alias("k"),
    )


def accuracy(points: DataFrame, queries: DataFrame, ks: list[int], counts: DataFrame | None = None) -> DataFrame:
    """(m, k, queries, accuracy, mean_sim) averaged over the queries of m points.

    accuracy is the mean of sum(sim) / (m * returned); mean_sim leaves out m. One search for
    the largest k serves every k, since its first k rows are the smaller answer.
    """
    sizes = queries.groupBy("qid").agg(F.count("*").alias("m"))
    answers = best_connected_batch(points, queries, counts=counts)
    levels = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    per_query = (
        answers.select("qid", "rank", "sim", levels)
        .where(F.col("rank") <= F.col("k"))
        .groupBy("qid", "k").agg(F.avg("sim").alias("mean_sim"))
    )
    return (
        per_query.join(sizes, "qid")
        .groupBy("m", "k")
        .agg(
            F.count("*").alias("queries"),
            F.avg(F.col("mean_sim") / F.col("m")).alias("accuracy"),
            F.avg("mean_sim").alias("mean_sim"),
        )
    )
