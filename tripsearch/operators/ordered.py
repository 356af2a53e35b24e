"""Order-aware measures of a trip against a query, a list of points or a table of any length.

All of these measures fill a table of (trip point x query point) cells, each from its left, upper and upper left
neighbour. The table is cut into tiles of (trip block x query block). A tile needs the last row of the tile above and the
last column of the tile to the left, so tiles are solved in rounds along anti-diagonals and only border vectors are
kept between rounds: no task holds more than a tile, and neither trips nor the query have a longest length. Trips and
queries of one block each, the usual case, are one round. Inside a tile a row is a few numpy steps: with the sums of a
row's gains taken off, the dependence on the left neighbour is a running maximum.

measure        meaning of one step at trip point p, with e_j = exp(-d(q_j, p))
ordered        each query point matched in order, trip points may serve several: the default
ordered_reuse  each trip point matched in order, query points may serve several
ordered_dp     ordered_reuse without the first point of trip and query, over the trip length
ordered_all    every visited pair counts on a monotone path through both lists
lcss           longest common subsequence within ``threshold`` on both axes, as a distance
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.functions.folds import double_array
from tripsearch.ship import ship
from tripsearch.storage import durable

# Fixed value: largest difference on either axis for two points to match.
LCSS_THRESHOLD = 0.1
BLOCK_POINTS = 512
MEASURES = ("ordered", "ordered_reuse", "ordered_dp", "ordered_all", "lcss")
_NEVER = -math.inf
_BORDERS = "trip_id string, i bigint, j bigint, blocks bigint, n bigint, bottom array<double>, right array<double>, corner double"


def query_blocks(
    points: DataFrame, query: list[tuple[float, float]] | DataFrame, size: int, skip_first: bool = False
) -> tuple[DataFrame, int, int, tuple[list[float], list[float]]]:
    """(j, qx, qy): the query in blocks numbered without gaps, with the number of blocks and of points left, and the first block itself."""
    if not isinstance(query, DataFrame):  # a list is at hand, so it is cut here
        left = [(float(x), float(y)) for x, y in query][int(skip_first) :]
        cut = [left[i : i + size] for i in range(0, len(left), size)]
        columns = ([[p[axis] for p in part] for part in cut] for axis in (0, 1))
        doubles = pa.list_(pa.float64())
        # an Arrow table becomes a local relation, whose size Spark knows
        held = pa.table([pa.array(range(len(cut)), pa.int64()), *[pa.array(c, doubles) for c in columns]], ["j", "qx", "qy"])
        first = cut[0] if cut else []
        return points.sparkSession.createDataFrame(held), len(cut), len(left), ([x for x, _ in first], [y for _, y in first])
    query = query.select(F.col("qseq").cast("bigint").alias("qseq"), "qlng", "qlat")
    path = F.array_sort(F.collect_list(F.struct("qseq", "qlng", "qlat")))
    if skip_first:
        query = query.where(F.col("qseq") > F.lit(query.agg(F.min("qseq")).first()[0]))
    blocks = query.groupBy(F.floor(F.col("qseq") / size).cast("bigint").alias("at")).agg(path.alias("path"))
    numbered = blocks.withColumn("j", F.row_number().over(Window.orderBy("at")).cast("bigint") - 1)
    held = durable(numbered.select("j", F.col("path")["qlng"].alias("qx"), F.col("path")["qlat"].alias("qy")), "query-blocks")
    count, total = held.agg(F.count("*"), F.coalesce(F.sum(F.size("qx")), F.lit(0))).first()
    first = held.where("j = 0").first()
    return held, count, total, (list(first["qx"]), list(first["qy"])) if first else ([], [])


def trip_blocks(points: DataFrame, size: int, last: int | None = None) -> tuple[DataFrame, int]:
    """(trip_id, i, xs, ys, blocks, n): trips in blocks numbered without gaps, also where ``seq`` has gaps; and the most blocks of a trip.

    ``last`` is the largest ``seq``, if the caller has just read it. Where it lies in the first block, trips are single rows of
    one aggregation; else blocks are written first.
    """
    path = F.array_sort(F.collect_list(F.struct("seq", "lng", "lat")))
    last = points.agg(F.max("seq")).first()[0] if last is None else last
    if last is None or last < size:
        paths = points.groupBy("trip_id").agg(path.alias("path"))
        first = F.lit(0).cast("bigint").alias("i")
        one, n = F.lit(1).cast("bigint").alias("blocks"), F.size("path").cast("bigint").alias("n")
        return paths.select("trip_id", first, F.col("path")["lng"].alias("xs"), F.col("path")["lat"].alias("ys"), one, n), 1
    cut = points.groupBy("trip_id", F.floor(F.col("seq") / size).cast("bigint").alias("at")).agg(path.alias("path"))
    held = durable(cut.select("trip_id", "at", F.col("path")["lng"].alias("xs"), F.col("path")["lat"].alias("ys")), "trip-blocks")
    most = held.groupBy("trip_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    # numbers are given to narrow rows: one per block
    in_trip = Window.partitionBy("trip_id")
    numbers = held.select("trip_id", "at", F.size("xs").alias("size")).select(
        "trip_id", "at", (F.row_number().over(in_trip.orderBy("at")) - 1).cast("bigint").alias("i"),
        F.count("*").over(in_trip).alias("blocks"), F.sum("size").over(in_trip).alias("n"),
    )
    joined = held.join(numbers, ["trip_id", "at"]).select("trip_id", "i", "xs", "ys", "blocks", "n")
    return durable(joined, "numbered-blocks"), most


def _gains(measure: str, threshold: float, xs, ys, qx, qy) -> np.ndarray:
    dx, dy = xs[:, None] - qx, ys[:, None] - qy
    if measure == "lcss":
        return ((np.abs(dx) <= threshold) & (np.abs(dy) <= threshold)).astype(float)
    return np.exp(-np.sqrt(dx * dx + dy * dy))


def _solve(measure: str, gains: np.ndarray, top: np.ndarray, left: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray]:
    """Last row and last column of a tile. ``top`` is the row above it, ``left`` the column before it, ``corner`` the cell above that."""
    right = np.empty(len(gains))
    run = np.empty(len(top) + 1)
    sums = np.cumsum(gains, axis=1)
    for t, gain in enumerate(gains):
        run[0] = left[t]
        if measure == "ordered":  # new[j] = max(top[j], new[j-1] + gain[j])
            np.subtract(top, sums[t], out=run[1:])
        elif measure == "ordered_all":  # new[j] = gain[j] + max(top[j], new[j-1])
            np.subtract(top, sums[t] - gain, out=run[1:])
        elif measure == "lcss":  # new[j] = max(top[j], new[j-1], top[j-1] + gain[j])
            run[1:] = gain
            run[1] += corner
            run[2:] += top[:-1]
            np.maximum(run[1:], top, out=run[1:])
            corner = left[t]
        else:  # new[j] = max(new[j-1], top[j] + gain[j])
            np.add(top, gain, out=run[1:])
        top = np.maximum.accumulate(run)[1:]
        if measure in ("ordered", "ordered_all"):
            top = top + sums[t]
        right[t] = top[-1]
    return top, right


def _start(measure: str, j: int, width: int) -> np.ndarray:
    """The row above a trip's first point."""
    if measure == "ordered":
        return np.full(width, _NEVER)
    if measure == "ordered_all":
        return np.array([0.0 if j == 0 and k == 0 else _NEVER for k in range(width)])
    return np.zeros(width)


def _tiles(measure: str, threshold: float, first: tuple[list[float], list[float]] | None = None):
    """Solves the tiles of its rows: those of the first query block and of every trip's first block, or those joined with their borders."""
    joined = first is None
    own = None if joined else tuple(np.array(v) for v in first)
    before = 0.0 if measure in ("ordered", "lcss") else _NEVER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {n: (batch.column(n).offsets.to_numpy(), batch.column(n).flatten().to_numpy()) for n in ("xs", "ys", *(("qx", "qy") if joined else ()))}
            part = lambda n, r: lists[n][1][lists[n][0][r] - lists[n][0][0] : lists[n][0][r + 1] - lists[n][0][0]]
            i = batch.column("i").to_pylist()
            j = batch.column("j").to_pylist() if joined else [0] * batch.num_rows
            tops, lefts, corners = (batch.column(n) if joined else None for n in ("top", "left", "corner"))
            bottoms, rights, nexts = [], [], []
            for r in range(batch.num_rows):
                xs, ys = part("xs", r), part("ys", r)
                qx, qy = (part("qx", r), part("qy", r)) if joined else own
                if measure == "ordered_dp" and i[r] == 0:
                    xs, ys = xs[1:], ys[1:]
                top = _start(measure, j[r], len(qx)) if i[r] == 0 else tops[r].values.to_numpy()
                left = np.full(len(xs), before) if j[r] == 0 else lefts[r].values.to_numpy()
                corner = before if j[r] == 0 else corners[r].as_py()
                bottom, right = _solve(measure, _gains(measure, threshold, xs, ys, qx, qy), top, left, corner)
                bottoms.append(bottom)
                rights.append(right)
                nexts.append(top[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("trip_id"), batch.column("i"), pa.array(j, pa.int64()), batch.column("blocks"), batch.column("n"), pa.array(bottoms, pa.list_(pa.float64())),
                 pa.array(rights, pa.list_(pa.float64())), pa.array(nexts, pa.float64())],
                [c.split()[0] for c in _BORDERS.split(", ")],
            )

    return run


def ordered_scores(
    points: DataFrame,
    query: list[tuple[float, float]] | DataFrame,
    measure: str = "ordered",
    threshold: float = LCSS_THRESHOLD,
    block_points: int = BLOCK_POINTS,
    query_block: int = BLOCK_POINTS,
    last: int | None = None,
) -> DataFrame:
    """(trip_id, n, value) of every trip; for ``lcss`` the value is a distance. ``query`` is a list or a table (qseq, qlng, qlat)."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    asked, wide, m, first = query_blocks(points, query, query_block, measure == "ordered_dp")
    if not m:
        return points.groupBy("trip_id").agg(F.count("*").alias("n")).withColumn("value", F.lit(0.0))
    ship(points.sparkSession)
    blocks, most = trip_blocks(points, block_points, last)
    # the first tile of every trip
    state = blocks.where("i = 0").mapInArrow(_tiles(measure, threshold, first), _BORDERS)

    def ended(tiles: DataFrame) -> DataFrame:
        last = tiles.where((F.col("j") == wide - 1) & (F.col("i") == F.col("blocks") - 1))
        return last.select("trip_id", "n", F.element_at("bottom", -1).alias("best"))

    done = []
    for _ in range(1, most + wide - 1):
        state = durable(state, "borders")
        done.append(ended(state))
        below = state.select("trip_id", (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("top"))
        beside = state.select("trip_id", "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left"), "corner")
        borders = below.join(beside, ["trip_id", "i", "j"], "full")
        state = blocks.join(borders, ["trip_id", "i"]).join(asked, "j").mapInArrow(_tiles(measure, threshold), _BORDERS)
    done.append(ended(state))
    best = reduce(DataFrame.unionByName, done)
    if measure == "ordered_dp":
        value = F.col("best") / F.col("n")
    elif measure == "lcss":
        either_single = (F.col("n") == 1) | F.lit(m == 1)
        value = F.when(either_single, 0.0).otherwise(1 - F.col("best") / F.least(F.col("n"), F.lit(m)))
    else:
        value = F.col("best")
    return best.select("trip_id", "n", value.alias("value"))


def _advance(vector: Column, gains: Column, m: Column) -> Column:
    """The ``ordered`` vector (after 0 .. m query points) after one more trip point; ``gains`` holds e_1 .. e_m."""
    first = F.array(F.get(vector, F.lit(0)))
    return F.aggregate(
        F.sequence(F.lit(1), m), first,
        lambda done, j: F.concat(done, F.array(F.greatest(F.get(vector, j), F.get(done, j - 1) + F.get(gains, j - 1)))),
    )


def ordered_bounds(nearest: DataFrame, query_points: DataFrame) -> DataFrame:
    """(qid, trip_id, lb, ub) of the order-aware similarity of every candidate trip.

    lb is the ``ordered`` measure on the trip points that are nearest neighbours of some
    query point; ub adds exp(-r) for the query points that did not see the trip. The lower
    bound always holds. The upper bound is the published estimate and can fall short when
    the neighbours seen are in the wrong order, so searches prune with the order-free bound.
    """
    asked = query_points.select("qid", "qseq", "qlng", "qlat")
    reached = nearest.select("qid", "trip_id", "seq", "lng", "lat").distinct()
    gain = geo.closeness(geo.degrees_apart(F.col("lng"), F.col("lat"), F.col("qlng"), F.col("qlat")))
    steps = (
        reached.join(asked, "qid")
        .groupBy("qid", "trip_id", "seq")
        .agg(F.array_sort(F.collect_list(F.struct("qseq", gain.alias("gain")))).alias("gains"))
    )
    paths = steps.groupBy("qid", "trip_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("gains")["gain"].alias("gains")))).alias("path")
    )
    m = F.size(F.get("path", F.lit(0))["gains"])
    start = F.concat(double_array([0.0]), F.array_repeat(F.lit(_NEVER), m))
    best = F.aggregate("path", start, lambda v, p: _advance(v, p["gains"], F.size(p["gains"])))
    low = paths.select("qid", "trip_id", F.get(best, m).alias("lb"))
    seen = nearest.select("qid", "qseq", "trip_id").distinct()
    tails = nearest.groupBy("qid", "qseq").agg(geo.closeness(F.max("d")).alias("tail"))
    all_tails = tails.groupBy("qid").agg(F.sum("tail").alias("all_tails"))
    seen_tails = seen.join(tails, ["qid", "qseq"]).groupBy("qid", "trip_id").agg(F.sum("tail").alias("seen_tails"))
    return (
        low.join(seen_tails, ["qid", "trip_id"]).join(all_tails, "qid")
        .select("qid", "trip_id", "lb", (F.col("lb") + F.col("all_tails") - F.col("seen_tails")).alias("ub"))
    )
