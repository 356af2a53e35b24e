"""Search requests answered from body to body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsearch.operators.trips import trip_polyline
from tripsearch.plans import search
from tripsearch.sources import requests as R
from tripsearch.storage import durable


def answer_requests(points: DataFrame, requests: DataFrame, counts: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """(req_id, rank, trip_id, sim, block, body) for requests (req_id, kind, body, day, k).

    Bodies are decoded, all requests are searched as one batch, and every answer trip comes as JSON, long trips in several
    blocks. ``shown`` is the table whose points are sent, by default the searched one. A request without readable points gets one row
    with an error body and no rank.
    """
    decoded = R.decode_requests(requests.select("req_id", "kind", "body")).where(F.col("qlng").isNotNull() & F.col("qlat").isNotNull())
    queries = durable(
        decoded.join(requests.select("req_id", "day", "k"), "req_id")
        .select(F.col("req_id").alias("qid"), "qseq", "qlng", "qlat", "day", F.col("k").cast("int").alias("k")), "request-points",
    )
    found = durable(search.best_connected_batch(points, queries, counts=counts), "answers")
    source = points if shown is None else shown
    lines = trip_polyline(source.join(found.select("trip_id").distinct(), "trip_id", "left_semi"))
    pieces = found.join(lines, "trip_id")
    bodies = R.encode_answer(pieces).join(found, ["qid", "rank"])
    unread = requests.join(queries.select(F.col("qid").alias("req_id")).distinct(), "req_id", "left_anti").select(
        "req_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("rank", "int"), ("trip_id", "string"), ("sim", "double"), ("block", "bigint"))],
        F.to_json(F.struct(F.lit("no points").alias("error"))).alias("body"),
    )
    return bodies.select(F.col("qid").alias("req_id"), "rank", "trip_id", "sim", "block", "body").unionByName(unread)
