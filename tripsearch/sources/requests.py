"""Search requests and answers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_requests(requests: DataFrame) -> DataFrame:
    """(req_id, kind, body) -> (req_id, qseq, qlng, qlat).

    Kind ``p`` is an object of numbered points, taken in the order of its keys; kind ``t``
    is an array of points.
    """
    numbered = F.transform(
        F.map_entries(F.from_json("body", "map<string,array<double>>")),
        lambda e: F.struct(e["key"].try_cast("int").alias("number"), e["key"].alias("key"), e["value"].alias("p")),
    )
    listed = F.from_json("body", "array<array<double>>")
    points = F.when(F.col("kind") == "p", F.transform(F.array_sort(numbered), lambda e: e["p"])).otherwise(listed)
    return requests.select("req_id", F.posexplode(points).alias("qseq", "p")).select(
        "req_id", "qseq",
        F.get("p", F.lit(0)).alias("qlng"), F.get("p", F.lit(1)).alias("qlat"),
    )


def object_body(path: Column) -> Column:
    """JSON object of numbered points from an array of (lng, lat) structs."""
    entries = F.transform(
        path, lambda p, i: F.struct(i.cast("string").alias("k"), F.array(p["lng"], p["lat"]).alias("v"))
    )
    return F.to_json(F.map_from_entries(entries))


def array_body(path: Column) -> Column:
    """JSON array of points from an array of (lng, lat) structs."""
    return F.to_json(F.transform(path, lambda p: F.array(p["lng"], p["lat"])))


def encode_answer(pieces: DataFrame) -> DataFrame:
    """Result pieces (qid, rank, trip_id, block, path) -> one JSON row per piece of a trip.

    Long trips stay in several rows, so no answer row grows with its trip.
    """
    return pieces.select(
        "qid", "rank", "block",
        F.to_json(F.struct(
            F.col("trip_id"), F.transform("path", lambda p: F.array(p["lng"], p["lat"])).alias("points")
        )).alias("body"),
    )
