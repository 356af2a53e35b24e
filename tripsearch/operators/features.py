"""Per-point features and the weight-based trip simplification.

Trips are worked on in chunks of consecutive points, so every window is over one chunk
(at most ``chunk_points`` rows) and a single exchange by (trip, chunk) serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo

# Fixed values of the method: chunk and segment sizes, reach of the accumulated heading
# change, trips and chunks too short to simplify, points kept per chunk by chunk length.
CHUNK_POINTS = 75
SEGMENT_POINTS = 6
HEADING_REACH = 3
SHORT_TRIP = 5
SHORT_CHUNK = 5
KEEP_UP_TO_25 = 8
KEEP_UP_TO_44 = 15
KEEP_BEYOND = 25


def chunk_features(points: DataFrame, chunk_points: int = CHUNK_POINTS, wrap: bool = False) -> DataFrame:
    """Add chunk, chunk_n, heading, nhc, ahc, hc, hop_prev, hop_next and nd to each point.

    heading  bearing to the next point of the chunk, 0 at its end
    nhc      heading change from the previous point, 0 at both ends of the chunk
    ahc      nhc summed over three points either side; hc = |nhc| + |ahc|
    nd       metres to the previous plus to the next point of the chunk
    """
    inside = Window.partitionBy("trip_id", "chunk")
    ordered = inside.orderBy("seq")
    nearby = ordered.rowsBetween(-HEADING_REACH, HEADING_REACH)
    lng, lat = F.col("lng"), F.col("lat")
    change = F.col("heading") - F.col("heading_prev")
    if wrap:
        change = F.pmod(change + 180.0, F.lit(360.0)) - 180.0
    return (
        points.withColumn("chunk", F.floor(F.col("seq") / chunk_points).cast("bigint"))
        .withColumns({
            "lng_next": F.lead("lng").over(ordered),
            "lat_next": F.lead("lat").over(ordered),
            "chunk_n": F.count("*").over(inside),
        })
        .withColumns({
            "heading": F.coalesce(geo.heading(lng, lat, F.col("lng_next"), F.col("lat_next")), F.lit(0.0)),
            "hop_next": F.coalesce(geo.haversine_m(lng, lat, F.col("lng_next"), F.col("lat_next")), F.lit(0.0)),
        })
        .withColumns({
            "heading_prev": F.lag("heading").over(ordered),
            "hop_prev": F.coalesce(F.lag("hop_next").over(ordered), F.lit(0.0)),
        })
        .withColumn(
            "nhc",
            F.when(F.col("lng_next").isNull() | F.col("heading_prev").isNull(), 0.0).otherwise(change),
        )
        .withColumn("ahc", F.sum("nhc").over(nearby))
        .withColumn("hc", F.abs("nhc") + F.abs("ahc"))
        .withColumn("nd", F.col("hop_prev") + F.col("hop_next"))
        .drop("lng_next", "lat_next", "heading_prev")
    )


def _points_to_keep(n: Column, rate: str) -> Column:
    middle = KEEP_UP_TO_44 if rate == "intended" else KEEP_BEYOND
    return F.floor(
        F.when(n <= 25, n / KEEP_UP_TO_25).when(n < 45, n / middle).otherwise(n / KEEP_BEYOND)
    )


def segment_weights(features: DataFrame, rate: str = "as_run") -> DataFrame:
    """Add segment, seg_w (share of the chunk's weight), headcount and rank_in_seg.

    A segment weighs its length in metres times its mean heading change, where the signed
    change of its first point counts once more. ``rate='intended'`` keeps n/15 points of
    chunks of 26 to 44 points instead of n/25.
    """
    segment = Window.partitionBy("trip_id", "chunk", "segment")
    ordered = segment.orderBy("seq")
    heaviest = segment.orderBy(F.desc("weight"), "seq")
    chunk = Window.partitionBy("trip_id", "chunk")
    is_first = F.col("pos_in_seg") == 1
    share = F.when(F.col("chunk_w") != 0, F.col("seg_raw") / F.col("chunk_w")).otherwise(F.col("seg_raw"))
    return (
        features
        .withColumn("segment", F.floor(F.pmod(F.col("seq"), F.lit(CHUNK_POINTS)) / SEGMENT_POINTS).cast("bigint"))
        .withColumn("weight", F.col("nd") * F.col("hc"))
        .withColumn("pos_in_seg", F.row_number().over(ordered))
        .withColumn("rank_in_seg", F.row_number().over(heaviest))
        .withColumn("seg_m", F.sum(F.when(is_first, 0.0).otherwise(F.col("hop_prev"))).over(segment))
        .withColumn(
            "seg_turn",
            (F.sum(F.when(is_first, F.col("nhc")).otherwise(0.0)).over(segment)
             + F.sum(F.abs("nhc")).over(segment)) / F.count("*").over(segment),
        )
        .withColumn("seg_raw", F.col("seg_m") * F.col("seg_turn"))
        .withColumn("chunk_w", F.sum(F.when(is_first, F.col("seg_raw")).otherwise(0.0)).over(chunk))
        .withColumn("seg_w", share)
        .withColumn("headcount", F.floor(F.col("seg_w") * _points_to_keep(F.col("chunk_n"), rate)))
    )


def simplify_trips(points: DataFrame, rate: str = "as_run", wrap: bool = False) -> DataFrame:
    """Keep the heaviest points of each trip; ``seq`` stays the original position.

    Trips of up to 5 points and chunks of under 5 are kept whole. In every other chunk the
    first point is added unless the first selected point lies at the same place.
    """
    chunk = Window.partitionBy("trip_id", "chunk")
    by_seq = chunk.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("lng", "lat")
    weighted = segment_weights(chunk_features(points, CHUNK_POINTS, wrap), rate)
    whole = (F.col("chunk_n") < SHORT_CHUNK) | ((F.col("chunk") == 0) & (F.col("chunk_n") <= SHORT_TRIP))
    opens_chunk = F.pmod(F.col("seq"), F.lit(CHUNK_POINTS)) == 0
    return (
        weighted
        .withColumn("selected", F.col("rank_in_seg") <= F.col("headcount"))
        .withColumn("first_selected", F.first(F.when(F.col("selected"), place), ignorenulls=True).over(by_seq))
        .where(
            whole | F.col("selected")
            | (opens_chunk & (F.col("first_selected").isNull() | (F.col("first_selected") != place)))
        )
        .select(*points.columns)
    )


def with_hops(points: DataFrame, block: int = 1024) -> DataFrame:
    """Metres from each point to the next point of its trip (NULL at the end).

    Blocks of consecutive points overlap by one point, so a trip of any length is walked by
    many tasks and no hop is lost at a block edge.
    """
    seq, home = F.col("seq"), F.floor(F.col("seq") / block).cast("bigint")
    opens_later_block = (F.pmod(seq, F.lit(block)) == 0) & (seq > 0)
    overlapped = points.withColumn("home", home).withColumn(
        "block", F.explode(F.when(opens_later_block, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    ordered = Window.partitionBy("trip_id", "block").orderBy("seq")
    hop = geo.haversine_m(F.col("lng"), F.col("lat"), F.lead("lng").over(ordered), F.lead("lat").over(ordered))
    return (
        overlapped.withColumn("hop_m", hop)
        .where(F.col("home") == F.col("block"))
        .select(*points.columns, "hop_m")
    )


def path_lengths(points: DataFrame) -> DataFrame:
    """(trip_id, n, length_m) per trip."""
    return with_hops(points).groupBy("trip_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("hop_m"), F.lit(0.0)).alias("length_m")
    )
