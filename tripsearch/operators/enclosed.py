"""Bounds that enclose the ``ordered`` measure, and the measure itself, for many (query, trip) pairs at once.

A search that has fetched the nearest points of every query point knows some points of a trip, the *reached* ones. Every
other point of the trip is at least as far from query point j as the farthest neighbour of j, so it earns at most
tail_j = exp(-r_j) there. The upper bound walks the reached points in trip order, with one thought point between
those that are not neighbours in the trip, before the first and after the last, which earns tail_j at every j. Whatever
the trip really holds between two reached points earns no more than that thought point, as trip points may serve several
query points. The walk over the reached points alone is a lower bound.

Pairs are walked in blocks of trip points; only one vector as long as the query passes from block to block, so neither a
long trip nor many reached points of one trip are ever in one row. A query is one row here: one with very many points
belongs into ``ordered.ordered_scores``, which cuts the query as well.

Defined results: a pair without points does not come back; nor does a query without points. Several rows of one
(pair, seq) count as points of one place, in the order of their coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.operators.ordered import _gains, _solve, _start
from tripsearch.ship import ship
from tripsearch.storage import durable

BLOCK_POINTS = 512
#: Gains that a walk holds at a time.
GAINS_AT_ONCE = 1 << 18
_STATE = "qid int, trip_id string, i bigint, blocks bigint, last bigint, low array<double>, high array<double>"


def query_rows(query_points: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(qid, qx, qy, tails): a row per query. ``tails`` is (qid, qseq, tail); without it nothing is thought to lie outside."""
    asked = query_points.select(F.col("qid").cast("int").alias("qid"), "qseq", "qlng", "qlat")
    if tails is None:
        asked = asked.withColumn("tail", F.lit(0.0))
    else:
        asked = asked.join(tails, ["qid", "qseq"]).select("qid", "qseq", "qlng", "qlat", "tail")
    path = F.array_sort(F.collect_list(F.struct("qseq", "qlng", "qlat", "tail")))
    rows = asked.groupBy("qid").agg(path.alias("path"))
    return rows.select("qid", *[F.col("path")[c].alias(name) for c, name in (("qlng", "qx"), ("qlat", "qy"), ("tail", "tails"))])


def pair_blocks(steps: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(qid, trip_id, i, blocks, seqs, xs, ys): points of every pair in blocks numbered without gaps, and the most blocks of a pair."""
    path = F.array_sort(F.collect_list(F.struct("seq", "lng", "lat")))
    cut = steps.groupBy("qid", "trip_id", F.floor(F.col("seq") / size).cast("bigint").alias("at")).agg(path.alias("path"))
    held = durable(
        cut.select("qid", "trip_id", "at", *[F.col("path")[c].alias(name) for c, name in (("seq", "seqs"), ("lng", "xs"), ("lat", "ys"))]),
        "pair-blocks",
    )
    most = held.groupBy("qid", "trip_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    one = F.lit(1).cast("bigint")
    if most <= 1:
        return held.select("qid", "trip_id", (one - 1).alias("i"), one.alias("blocks"), "seqs", "xs", "ys"), most
    of_pair = Window.partitionBy("qid", "trip_id")
    numbers = held.select(
        "qid", "trip_id", "at", (F.row_number().over(of_pair.orderBy("at")) - 1).cast("bigint").alias("i"), F.count("*").over(of_pair).alias("blocks")
    )
    joined = held.join(numbers, ["qid", "trip_id", "at"]).select("qid", "trip_id", "i", "blocks", "seqs", "xs", "ys")
    return durable(joined, "numbered-pairs"), most


def _lists(batch: pa.RecordBatch, name: str):
    column = batch.column(name)
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return lambda r: flat[offsets[r] : offsets[r + 1]]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of every row's pair; rows of a pair's first block come without ``last``, ``low`` and ``high``."""
    for batch in batches:
        seqs, xs, ys, qx, qy, tails = (_lists(batch, n) for n in ("seqs", "xs", "ys", "qx", "qy", "tails"))
        i, blocks = batch.column("i").to_pylist(), batch.column("blocks").to_pylist()
        begun = "low" in batch.schema.names
        lasts = batch.column("last").to_pylist() if begun else [-1] * batch.num_rows
        old = (_lists(batch, "low"), _lists(batch, "high")) if begun else None
        ends, lows, highs = [], [], []
        for r in range(batch.num_rows):
            seq, tail = seqs(r), tails(r)
            m = len(tail)
            low, high = (old[0](r), old[1](r)) if begun else (_start("ordered", 0, m), _start("ordered", 0, m))
            jump = seq > np.concatenate([[lasts[r]], seq[:-1]]) + 1  # an unreached point may lie before these
            rows = max(1, GAINS_AT_ONCE // m)
            for a in range(0, len(seq), rows):
                part = slice(a, a + rows)
                gains = _gains("ordered", 0.0, xs(r)[part], ys(r)[part], qx(r), qy(r))
                low, _ = _solve("ordered", gains, low, np.zeros(len(gains)), 0.0)
                gains = np.insert(gains, np.flatnonzero(jump[part]), tail, axis=0)
                high, _ = _solve("ordered", gains, high, np.zeros(len(gains)), 0.0)
            if i[r] == blocks[r] - 1:
                high, _ = _solve("ordered", tail[None, :], high, np.zeros(1), 0.0)
            ends.append(int(seq[-1]))
            lows.append(low)
            highs.append(high)
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("qid"), batch.column("trip_id"), batch.column("i"), batch.column("blocks"), pa.array(ends, pa.int64()), pa.array(lows, doubles), pa.array(highs, doubles)],
            [c.split()[0] for c in _STATE.split(", ")],
        )


def walked(steps: DataFrame, queries: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(qid, trip_id, lb, ub) of every pair of ``steps`` (qid, trip_id, seq, lng, lat); ``queries`` as from ``query_rows``."""
    ship(steps.sparkSession)
    blocks, most = pair_blocks(steps, block_points)
    blocks = blocks.withColumn("qid", F.col("qid").cast("int"))
    state = blocks.where("i = 0").join(queries, "qid").mapInArrow(_walk, _STATE)
    done = []
    for i in range(1, most):
        state = durable(state, "walked")
        done.append(state.where(F.col("blocks") == i))
        passed = state.where(F.col("blocks") > i).select("qid", "trip_id", "last", "low", "high")
        state = blocks.where(F.col("i") == i).join(passed, ["qid", "trip_id"]).join(queries, "qid").mapInArrow(_walk, _STATE)
    done.append(state)
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("qid", "trip_id", F.element_at("low", -1).alias("lb"), F.element_at("high", -1).alias("ub"))


def enclosing_bounds(nearest: DataFrame, query_points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(qid, trip_id, lb, ub) of every trip that some query point has reached: lb <= ordered measure <= ub, always.

    ``nearest`` holds (qid, qseq, trip_id, seq, lng, lat, d), the nearest points of every query point.
    """
    tails = nearest.groupBy("qid", "qseq").agg(geo.closeness(F.max("d")).alias("tail"))
    reached = nearest.select("qid", "trip_id", "seq", "lng", "lat").distinct()
    return walked(reached, query_rows(query_points, tails), block_points)


def exact_scores(points: DataFrame, pairs: DataFrame, query_points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(qid, trip_id, value): the ``ordered`` measure of the listed (qid, trip_id) pairs."""
    steps = points.select("trip_id", "seq", "lng", "lat").join(pairs, "trip_id")
    return walked(steps, query_rows(query_points), block_points).select("qid", "trip_id", F.col("lb").alias("value"))
