"""Greedy edit distance with projections (EDwP) of trips to a query trip.

Both lists are walked hop by hop. At each step the cheaper of two moves is taken: project
the next point of one list on the current hop of the other and match up to there. A move
costs (distance between the matched ends) x (length covered). A list reduced to one point
pays for at most one more hop of the other list, then the walk ends.

The walk is sequential by nature, and its state is one small row per trip. Trips and the query are cut
into blocks; each round feeds every unfinished trip the block it waits for, of its own points or of the query, so no
task holds more than a block of either and trips and queries of one block take one round. Inside a task the
trips of an Arrow batch step together as numpy vectors: as an array fold the branching step
took 65 microseconds of a core, this way well under one.

Costs only grow, so a search for the k nearest ends a walk as soon as its cost is above what k other trips
have cost in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.operators.ordered import query_blocks, trip_blocks
from tripsearch.operators.similarity import top_trips
from tripsearch.ship import ship
from tripsearch.storage import durable

BLOCK_POINTS = 1024
#: Trips walked first, for each one asked for, to know a cost that others must not exceed.
SEED_FACTOR = 4
_STATE = "trip_id string, i bigint, j bigint, a int, b int, rx double, ry double, sx double, sy double, cost double, done boolean"


def _apart(a, b):
    return np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def _foot(a, b, p):
    """Foot of p on the line a-b (rows of x and y); a where a = b."""
    d = b - a
    span = (d * d).sum(axis=0)
    t = np.divide((d * (p - a)).sum(axis=0), span, out=np.zeros_like(span), where=span > 0)
    return a + t * d


def _between(foot, a, b):
    """Whether the foot is a new point, at neither end of the hop."""
    return (foot != a).any(axis=0) & (foot != b).any(axis=0)


def _walk(path, i, end, more, query, j, qend, qmore, r, s, cost, done, ceiling) -> None:
    """Advance every trip in place until it is done, waits for its next block or costs more than ``ceiling``.

    ``path`` and ``query`` are the points of all trips and of their query blocks end to end, i and j each trip's next points, end and qend
    their limits; r and s are the current heads of trip and query.
    """
    ready = lambda x: ((i[x] < end[x]) | ~more[x]) & ((j[x] < qend[x]) | ~qmore[x]) & (cost[x] <= ceiling)
    live = np.flatnonzero(~done)
    live = live[ready(live)]
    while live.size:
        last = live[~((i[live] < end[live]) & (j[live] < qend[live]))]
        if last.size:
            r_more, s_more = i[last] < end[last], j[last] < qend[last]
            ahead = np.where(r_more, path[:, np.minimum(i[last], path.shape[1] - 1)], query[:, np.minimum(j[last], query.shape[1] - 1)])
            head = np.where(r_more, r[:, last], s[:, last])
            single = np.where(r_more, s[:, last], r[:, last])
            tail = (_apart(head, single) + _apart(ahead, single)) * _apart(head, ahead)
            cost[last] += np.where(r_more | s_more, tail, 0.0)
            done[last] = True
        live = live[~done[live]]
        if not live.size:
            return
        a, b, c, d = r[:, live], path[:, i[live]], s[:, live], query[:, j[live]]
        on_r, on_s = _foot(a, b, d), _foot(c, d, b)
        heads = _apart(a, c)
        stop_r = (heads + _apart(on_r, d)) * (_apart(a, on_r) + _apart(c, d))
        stop_s = (heads + _apart(on_s, b)) * (_apart(c, on_s) + _apart(a, b))
        by_r = stop_r < stop_s
        cut_r, cut_s = by_r & _between(on_r, a, b), ~by_r & _between(on_s, c, d)
        cost[live] += np.where(by_r, stop_r, stop_s)
        r[:, live], s[:, live] = np.where(cut_r, on_r, b), np.where(cut_s, on_s, d)
        i[live] += ~cut_r
        j[live] += ~cut_s
        live = live[ready(live)]


def _walk_batches(wide: int, ceiling: float, first: tuple[list[float], list[float]] | None = None):
    """Walks its rows: the first blocks of trips against the first block of the query, or those joined with the blocks they wait for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)

            def laid_out(x, y):
                ends = np.cumsum(np.diff(batch.column(x).offsets.to_numpy()))
                return np.stack([batch.column(x).flatten().to_numpy(), batch.column(y).flatten().to_numpy()]), np.concatenate(([0], ends[:-1])), ends

            path, begin, end = laid_out("xs", "ys")
            i, done = get("i").copy(), np.zeros(batch.num_rows, dtype=bool)
            if first is not None:
                query, qbegin, qend = np.array(first), np.zeros_like(begin), np.full_like(end, len(first[0]))
                j, cost, r, s = np.zeros_like(i), np.zeros(len(i)), path[:, begin], query[:, qbegin]
                a, b = begin + 1, qbegin + 1
            else:
                query, qbegin, qend = laid_out("qx", "qy")
                j, cost = get("j").copy(), get("cost").copy()
                r, s = np.stack([get("rx"), get("ry")]), np.stack([get("sx"), get("sy")])
                a, b = begin + get("a"), qbegin + get("b")
            more, qmore = i + 1 < get("blocks"), j + 1 < wide
            _walk(path, a, end, more, query, b, qend, qmore, r, s, cost, done, ceiling)
            over, qover = (a == end) & more, (b == qend) & qmore
            kept = pa.array(done | (cost <= ceiling))
            out = pa.RecordBatch.from_arrays(
                [batch.column("trip_id"), pa.array(i + over), pa.array(j + qover), pa.array(np.where(over, 0, a - begin), pa.int32()),
                 pa.array(np.where(qover, 0, b - qbegin), pa.int32()), *map(pa.array, (r[0], r[1], s[0], s[1], cost, done))],
                [c.split()[0] for c in _STATE.split(", ")],
            )
            yield out.filter(kept)

    return run


def _least(values: DataFrame, k: int) -> float:
    """The k-th least value, with room for the rounding of a ranking; without limit if there are fewer."""
    found = [r["value"] for r in values.orderBy("value").limit(k).select("value").collect()]
    return found[-1] + 1e-8 if len(found) == k else math.inf


def _distances(
    blocks: DataFrame, most: int, asked: DataFrame, wide: int, first: tuple[list[float], list[float]], k: int | None = None, ceiling: float = math.inf
) -> DataFrame:
    state = None
    finished: list[DataFrame] = []
    while True:
        # the first round reads the first blocks as they are; later ones join each trip with the blocks it waits for
        if state is None:
            state = blocks.where("i = 0").mapInArrow(_walk_batches(wide, ceiling, first), _STATE)
        else:
            fed = state.join(blocks.drop("n"), ["trip_id", "i"]).join(asked, "j")
            state = fed.mapInArrow(_walk_batches(wide, ceiling), _STATE)
        if most > 1 or wide > 1:
            state = durable(state, "edit-state")
        finished.append(state.where("done").select("trip_id", F.col("cost").alias("value")))
        if most <= 1 and wide <= 1:
            break
        state = state.where("not done").drop("done")
        if k is not None:
            ceiling = min(ceiling, _least(reduce(DataFrame.unionByName, finished), k))
            state = state.where(F.col("cost") <= ceiling)
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished)


def edit_distances(
    points: DataFrame, query: list[tuple[float, float]] | DataFrame, block_points: int = BLOCK_POINTS, query_block: int = BLOCK_POINTS
) -> DataFrame:
    """(trip_id, value): EDwP of every trip to the query, a list or a table (qseq, qlng, qlat) of any length."""
    asked, wide, m, start = query_blocks(points, query, query_block)
    if not m:
        return points.select("trip_id").distinct().withColumn("value", F.lit(float("inf")))
    ship(points.sparkSession)
    blocks, most = trip_blocks(points, block_points)
    return _distances(blocks, most, asked, wide, start)


def nearest_by_edit(
    points: DataFrame, query: list[tuple[float, float]] | DataFrame, k: int, block_points: int = BLOCK_POINTS, query_block: int = BLOCK_POINTS
) -> DataFrame:
    """(trip_id, value): the k trips nearest to the query by EDwP.

    Where walks take more than one round, the trips that begin nearest to the query are walked first; the k-th cost among them, and then the k-th of all that have
    ended, is a ceiling that ends every dearer walk. Ties with the ceiling go on, so the answer is exact.
    """
    asked, wide, m, start = query_blocks(points, query, query_block)
    if not m or k <= 0:
        return top_trips(points.select("trip_id").distinct().withColumn("value", F.lit(float("inf"))), max(k, 0), "value", False)
    ship(points.sparkSession)
    blocks, most = trip_blocks(points, block_points)
    if most <= 1 and wide <= 1:  # one round: there is no later block to save
        return top_trips(_distances(blocks, most, asked, wide, start), k, "value", False)
    away = geo.degrees_apart(F.col("xs")[0], F.col("ys")[0], F.lit(start[0][0]), F.lit(start[1][0]))
    first = durable(blocks.where("i = 0").select("trip_id", away.alias("d")).orderBy("d", "trip_id").limit(SEED_FACTOR * k).select("trip_id"), "edit-seeds")
    ceiling = _least(_distances(blocks.join(first, "trip_id", "left_semi"), most, asked, wide, start), k)
    return top_trips(_distances(blocks, most, asked, wide, start, k, ceiling), k, "value", False)
