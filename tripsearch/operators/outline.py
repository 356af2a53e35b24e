"""Douglas-Peucker outline of trips.

Pieces of at most ``piece_points`` points are solved inside one row, with an explicit
stack folded over the piece's array. A longer trip is first split in rounds: each round
finds the farthest point of every open piece with one aggregation over all points, so no
task ever holds more than one bounded piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.functions.folds import let
from tripsearch.storage import durable

EPSILON = 1e-2
SEARCH_EPSILON = 1e-4


def _farthest(path: Column, start: Column, end: Column) -> Column:
    """(index, distance) of the first farthest point strictly between two positions."""

    def ends(a: Column, b: Column) -> Column:
        dx, dy = b["lng"] - a["lng"], b["lat"] - a["lat"]
        return F.struct(
            a["lng"].alias("x"), a["lat"].alias("y"), dx.alias("dx"), dy.alias("dy"),
            F.sqrt(dx * dx + dy * dy).alias("length"),
        )

    def away(chord: Column) -> Column:
        x, y, dx, dy, length = (chord[name] for name in ("x", "y", "dx", "dy", "length"))
        inner = F.slice(path, start + 2, F.greatest(end - start - 1, F.lit(0)))
        to_line = F.transform(inner, lambda p: F.abs(dx * (y - p["lat"]) - (x - p["lng"]) * dy) / length)
        to_point = F.transform(inner, lambda p: geo.degrees_apart(p["lng"], p["lat"], x, y))
        return F.when(length > 0, to_line).otherwise(to_point)

    chord = let(F.get(path, start), lambda a: let(F.get(path, end), lambda b: ends(a, b)))
    return let(
        let(chord, away),
        lambda d: let(
            F.coalesce(F.array_max(d), F.lit(0.0)),
            lambda top: F.struct(
                (start + F.array_position(d, top).cast("int")).alias("at"), top.alias("top")
            ),
        ),
    )


def outline_positions(path: Column, epsilon: float) -> Column:
    """Positions (0-based) of the points of ``path`` that the outline keeps."""
    n = F.size(path)
    start = F.struct(
        F.lit(0).alias("at"),
        F.when(n > 1, F.array(n - 1)).otherwise(F.expr("cast(array() as array<int>)")).alias("ends"),
        F.array(F.lit(0)).alias("kept"),
    )

    def step(state: Column, _: Column) -> Column:
        end = F.get(state["ends"], F.size(state["ends"]) - 1)
        closed = F.struct(
            end.alias("at"),
            F.slice(state["ends"], 1, F.size(state["ends"]) - 1).alias("ends"),
            F.concat(state["kept"], F.array(end)).alias("kept"),
        )
        split = lambda far: F.struct(
            state["at"].alias("at"),
            F.concat(state["ends"], F.array(far["at"])).alias("ends"),
            state["kept"].alias("kept"),
        )
        return F.when(F.size(state["ends"]) == 0, state).otherwise(
            let(
                _farthest(path, state["at"], end),
                lambda far: F.when(far["top"] > epsilon, split(far)).otherwise(closed),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(2 * n - 3, F.lit(1))), start, step)["kept"]


def _piece_outline(pieces: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """Kept rows of bounded pieces; whole rows travel in the piece's array, so nothing is joined back."""
    others = [name for name in pieces.columns if name not in (*keys, "seq", "lng", "lat")]
    paths = pieces.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "lng", "lat", F.struct(*others).alias("rest")) if others
                                    else F.struct("seq", "lng", "lat"))).alias("path")
    )
    kept = F.transform(outline_positions(F.col("path"), epsilon), lambda i: F.get(F.col("path"), i))
    rows = paths.select(*keys, F.inline(kept))
    return rows.select(*keys, "seq", "lng", "lat", "rest.*") if others else rows


def _split_long(points: DataFrame, epsilon: float, piece_points: int):
    """Split pieces longer than the bound in rounds; returns the bounded pieces and the cut points."""
    state = durable(
        points.select("trip_id", F.lit(0).cast("bigint").alias("piece"), "seq", "lng", "lat"), "outline"
    )
    small, cuts = [], []
    place = F.struct("seq", "lng", "lat")
    while True:
        sizes = state.groupBy("trip_id", "piece").agg(
            F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")
        )
        sizes = durable(sizes, "outline-pieces")
        long_pieces = sizes.where(F.col("n") > piece_points)
        small.append(state.join(sizes.where(F.col("n") <= piece_points), ["trip_id", "piece"], "left_semi"))
        if long_pieces.isEmpty():
            return small, cuts
        inner = state.join(long_pieces, ["trip_id", "piece"])
        away = geo.line_distance(
            F.col("lng"), F.col("lat"), F.col("a.lng"), F.col("a.lat"), F.col("b.lng"), F.col("b.lat")
        )
        candidate = F.struct(away.alias("top"), (-F.col("seq")).alias("back"))
        far = (
            inner.where((F.col("seq") != F.col("a.seq")) & (F.col("seq") != F.col("b.seq")))
            .groupBy("trip_id", "piece", "a", "b").agg(F.max(candidate).alias("far"))
            .select("trip_id", "piece", "a", "b", (-F.col("far.back")).alias("at"), F.col("far.top").alias("top"))
        )
        far = durable(far, "outline-far")
        ends = F.explode(F.array(F.col("a.seq"), F.col("b.seq")))
        cuts.append(far.where(F.col("top") <= epsilon).select("trip_id", ends.alias("seq")))
        # A piece is named by its first seq; the cut point belongs to both halves.
        halves = F.when(F.col("seq") == F.col("at"), F.array("piece", "at")).otherwise(
            F.array(F.when(F.col("seq") < F.col("at"), F.col("piece")).otherwise(F.col("at")))
        )
        state = durable(
            state.join(far.where(F.col("top") > epsilon).select("trip_id", "piece", "at"), ["trip_id", "piece"])
            .select("trip_id", F.explode(halves).alias("piece"), "seq", "lng", "lat"),
            "outline",
        )


def outline_trips(points: DataFrame, epsilon: float = EPSILON, piece_points: int = 2048) -> DataFrame:
    """Rows of ``points`` that the outline keeps. Both ends of a trip always stay.

    One aggregate finds out whether any trip needs splitting.
    """
    longest = (points.agg(F.max("seq")).first()[0] or 0) + 1
    if longest <= piece_points:
        return _piece_outline(points, ["trip_id"], epsilon).select(*points.columns)
    sizes = points.groupBy("trip_id").agg(F.count("*").alias("n"))
    long_trips = durable(sizes.where(F.col("n") > piece_points).select("trip_id"), "outline-long")
    long_points = points.join(long_trips, "trip_id", "left_semi")
    small, cuts = _split_long(long_points, epsilon, piece_points)
    kept = [ends.select("trip_id", "seq") for ends in cuts]
    kept += [_piece_outline(pieces, ["trip_id", "piece"], epsilon).select("trip_id", "seq") for pieces in small]
    long_kept = long_points.join(reduce(DataFrame.unionByName, kept).distinct(), ["trip_id", "seq"], "left_semi")
    short_kept = _piece_outline(points.join(long_trips, "trip_id", "left_anti"), ["trip_id"], epsilon)
    return short_kept.select(*points.columns).unionByName(long_kept.select(*points.columns))
