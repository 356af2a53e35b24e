"""Candidates and similarity bounds from a partial look around the query points.

``scanned`` holds (qid, qseq, trip_id, d): the trips seen from each query point with their
exact distance. ``radii`` holds (qid, qseq, r, all_seen): how far each query point has
looked, and whether no trip at all lies beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo


def scanned_trips(pairs: DataFrame) -> DataFrame:
    """Smallest distance per query point and trip."""
    return pairs.groupBy("qid", "qseq", "trip_id").agg(F.min("d").alias("d"))


def look_radii(nearest: DataFrame) -> DataFrame:
    """(qid, qseq, r, returned): farthest neighbour of each query point, and how many came."""
    return nearest.groupBy("qid", "qseq").agg(F.max("d").alias("r"), F.count("*").alias("returned"))


def candidates(scanned: DataFrame) -> DataFrame:
    """Union of the trips seen from any point of a query."""
    return scanned.select("qid", "trip_id").distinct()


def unseen_bound(radii: DataFrame) -> DataFrame:
    """(qid, ub_ns): no trip outside the candidates can be more similar than this."""
    return radii.groupBy("qid").agg(F.sum(geo.closeness(F.col("r"))).alias("ub_ns"))


def similarity_bounds(scanned: DataFrame, radii: DataFrame) -> DataFrame:
    """(qid, trip_id, seen, lb, ub) of every candidate.

    lb sums the query points that saw the trip; ub adds exp(-r) for those that did not,
    as the total of all tails less the tails of the points that did see it.
    """
    tails = radii.groupBy("qid").agg(F.sum(geo.closeness(F.col("r"))).alias("all_tails"))
    return (
        scanned.join(radii.select("qid", "qseq", "r"), ["qid", "qseq"])
        .groupBy("qid", "trip_id")
        .agg(
            F.count("*").alias("seen"),
            F.sum(geo.closeness(F.col("d"))).alias("lb"),
            F.sum(geo.closeness(F.col("r"))).alias("seen_tails"),
        )
        .join(tails, "qid")
        .select("qid", "trip_id", "seen", "lb",
                (F.col("lb") + F.col("all_tails") - F.col("seen_tails")).alias("ub"))
    )


def kth_lower_bound(bounds: DataFrame, batch: DataFrame, largest_k: int) -> DataFrame:
    """(qid, kth_lb) where at least k trips were seen; ``batch`` holds (qid, k)."""
    ordered = Window.partitionBy("qid").orderBy(F.desc("lb"), "trip_id")
    return (
        bounds.select("qid", "trip_id", "lb")
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= largest_k)
        .join(batch, "qid")
        .where(F.col("rank") == F.col("k"))
        .select("qid", F.col("lb").alias("kth_lb"))
    )


def next_budgets(state: DataFrame, looks: DataFrame, round_no: int) -> DataFrame:
    """Neighbours to fetch per query point in the next round.

    ``state`` is (qid, qseq, k, lam, prev), ``looks`` is (qid, qseq, r, returned). A query
    gets m * k * 2^round more neighbours, shared out half by how fast a point's tail decays
    (r / (2 lam) * exp(-r)) and half by how many neighbours the last growth brought in.
    """
    whole = Window.partitionBy("qid")

    def share(name: str):
        total = F.sum(name).over(whole)
        return F.when(total > 0, F.col(name) / total).otherwise(F.lit(1.0) / F.col("m"))

    return (
        state.join(looks, ["qid", "qseq"])
        .withColumn("m", F.count("*").over(whole))
        .withColumn("decay", F.col("r") / (2 * F.col("lam")) * geo.closeness(F.col("r")))
        .withColumn("ratio", F.col("returned") / (F.col("lam") - F.col("prev")))
        .withColumn("grow", F.col("m") * F.col("k") * float(2 ** round_no))
        .select(
            "qid", "qseq", "k", F.col("lam").alias("prev"),
            F.floor(F.col("lam") + F.col("grow") * (0.5 * share("decay") + 0.5 * share("ratio")))
            .cast("bigint").alias("lam"),
        )
    )


def settled_queries(radii: DataFrame, kth: DataFrame) -> DataFrame:
    """(qid, kth_lb) of the queries no unseen trip can change; kth_lb is NULL below k trips."""
    looks = radii.groupBy("qid").agg(F.bool_or("all_seen").alias("all_seen"))
    return (
        looks.join(unseen_bound(radii), "qid").join(kth, "qid", "left")
        .where(F.col("all_seen") | (F.col("kth_lb") >= F.col("ub_ns")))
        .select("qid", "kth_lb")
    )


def refine_survivors(bounds: DataFrame, kth: DataFrame) -> DataFrame:
    """Candidates whose upper bound still reaches the k-th lower bound of their query."""
    slack = 1e-9  # sums differ in the last digits with the order of addition
    return (
        bounds.join(kth, "qid", "left")
        .where(F.col("kth_lb").isNull() | (F.col("ub") >= F.col("kth_lb") - slack))
        .select("qid", "trip_id")
    )
