"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

A shard of candidate rows holds, per dimension, postings in segments of equal quantised impact. A
query takes the segments of all dimensions by descending contribution and adds each segment's
lower bound to accumulators. It stops only when the bounds prove that few rows can still be
members (or no segment is left) and rescores every possible member exactly.

Queries go through in blocks of at most about ``BLOCK``; a block is what each task gets, whatever
the size of the table. A task keeps k rows per query, and the floor found in one shard serves the
next.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Vectors of unequal length are compared as if padded with zeros. A candidate
with the query's id is its own row. A repeated query id asks once, with its smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.ship import ship
from tripsearch.storage import durable

BLOCK = 4096
SHARD_ROWS = 8192
LEVELS = 32
CHECKS = 8


def whole_numbers(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v: components as floor(scale * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        table.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(odd, F.lit(True)))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Shard:
    """Impact-ordered postings of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (rows - self.low) // self.step
        self.order = np.argsort(level, axis=0, kind="stable").T.astype(np.int32).copy()
        marks = np.arange(LEVELS + 1)
        self.cuts = np.stack([np.searchsorted(level[self.order[d], d], marks) for d in range(rows.shape[1])])

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of every row that may be among the best k of this shard and over ``floor``."""
        weight = np.abs(query)
        used = np.flatnonzero(weight * (self.high - self.low))
        base = int(np.minimum(query * self.low, query * self.high).sum())
        n = len(self.ids)
        sums = np.zeros(n, np.int64)
        if len(used):
            # contribution over the dimension's least, from below and above, of every level
            levels = np.arange(LEVELS)
            up = query[used, None] > 0
            span = (self.high - self.low)[used, None]
            near = self.step[used, None] * levels
            low = np.where(up, near, np.maximum(0, span - (near + self.step[used, None] - 1))) * weight[used, None]
            high = np.where(up, np.minimum(span, near + self.step[used, None] - 1), np.maximum(0, span - near)) * weight[used, None]
            counts = np.diff(self.cuts[used], axis=1)
            dims, levs = np.nonzero(counts)
            sequence = np.argsort(-high[dims, levs], kind="stable")
            done, due = 0, (n * len(used)) / CHECKS
            rest = np.array([high[i][counts[i] > 0].max() for i in range(len(used))])
            left = counts.copy()
            slack = int((high - low).max(axis=1).sum())
            for s in sequence:
                i, level = dims[s], levs[s]
                d = used[i]
                sums[self.order[d, self.cuts[d, level] : self.cuts[d, level + 1]]] += low[i, level]
                left[i, level] = 0
                done += counts[i, level]
                if done >= due:
                    due += (n * len(used)) / CHECKS
                    rest = np.where(left > 0, high, 0).max(axis=1)
                    possible = self._possible(sums, slack + int(rest.sum()), base, k, floor)
                    if len(possible) <= 8 * k:
                        break
            else:
                possible = self._possible(sums, slack, base, k, floor)
        else:
            possible = np.arange(n)
        possible = possible[self.ids[possible] != own]
        return self.ids[possible], self.rows[possible] @ query

    @staticmethod
    def _possible(sums, above, base, k, floor):
        # one place more than k: the query's own row may hold one
        least = np.partition(sums, -(k + 1))[-(k + 1)] if len(sums) > k else np.int64(0)
        if floor is not None:
            least = max(least, floor - base)
        return np.flatnonzero(sums + above >= least)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``table``."""
    spark = table.sparkSession
    ship(spark)
    rows = whole_numbers(table, key, vector, scale)
    asked = durable(whole_numbers(queries, key, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() * 4 // (3 * BLOCK)))
    found = None
    for number in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        if part.num_rows:
            one = _search(rows, part, k)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    query_ids = asked.column("vec_id").to_numpy()
    query_rows = matrix(asked.column("v").combine_chunks())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            vectors.append(batch.column(1))
            held += batch.num_rows
            if held >= SHARD_ROWS:
                yield np.concatenate(ids), matrix(pa.concat_arrays(vectors), query_rows.shape[1])
                ids, vectors, held = [], [], 0
        if held:
            yield np.concatenate(ids), matrix(pa.concat_arrays(vectors), query_rows.shape[1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        for ids, vectors in shards(batches):
            shard = Shard(ids, vectors)
            for q, own in enumerate(query_ids):
                query = np.zeros(vectors.shape[1], np.int64)
                query[: query_rows.shape[1]] = query_rows[q]
                had, scores = kept[q]
                more, points = shard.top(query, own, k, int(scores[-1]) if len(scores) == k else None)
                kept[q] = best(np.concatenate([had, more]), np.concatenate([scores, points]), k)
        sizes = [len(x[0]) for x in kept]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([x[0] for x in kept])), pa.array(np.concatenate([x[1] for x in kept]))],
                ["query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")
