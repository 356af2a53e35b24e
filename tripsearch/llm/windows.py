"""Repeated windows across documents: the frame that the substring operators share.

A kernel cuts every text into pieces: runs of consecutive windows (of bytes or words) with the same
anchor, a value that the content of a window alone decides. Equal windows have equal anchors, so
pieces meet by anchor, packed, one binary row per block and target. Where they meet

- a piece whose content also occurs in a document with a smaller id is removed whole;
- the first piece of each content stays *open* if its anchor comes with several contents: some of its
  windows may still occur in a smaller document. Only these windows are compared one by one. A kernel
  may give *sides*, three codes of 16 bits: pieces of one anchor that agree on none of them share no
  window and do not stay open for each other; code 0 agrees with none.

A content that one task meets many times is sent on once, from its smallest document; the others are
settled where they are found, so no target gathers a hot passage.

A row is known by its id and, where ids repeat, a tag of its text. Rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks
from tripsearch.llm.byids import semi
from tripsearch.ship import ship
from tripsearch.storage import durable

#: Pieces that one block packs, and bytes of text per task of the exchange.
PER_BLOCK = 200_000
#: Bytes of packed rows that are worked on together, and runs per batch of the answer.
TOGETHER = 4 << 20
PER_ANSWER = 100_000
TEXT_PER_TASK = 12 << 20
FINE = 5
#: Planes (bytes) of a packed piece: anchor, print, id, tag, first window, number of windows, sides.
PLANES = (5, 6, 8, 4, 4, 4, 6)
RUNS = "doc_id long, tag long, first long, number long, anchor long, open boolean"


def tag_of(docs: DataFrame, key: str, text: str) -> Column:
    """What tells rows with the same id apart: 0 unless ids repeat."""
    repeated = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_of_key")).filter("n_of_key > 1").limit(1).count()
    return F.pmod(F.xxhash64(text), F.lit(1 << 32)) if repeated else F.lit(0).cast("long")


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, tag, text."""
    tag = tag_of(docs, key, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text).cast("string").alias("text"))


def planes(*columns: np.ndarray) -> np.ndarray:
    """The low bytes of every column, a row of bytes each: like bytes compress to nothing."""
    rows = [np.ascontiguousarray(c.astype("<i8" if c.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8)[:, :k] for c, k in zip(columns, PLANES)]
    return np.concatenate(rows, axis=1)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(settled, target of every piece, planes) of the packed rows that come, small ones put together."""
    width, held, size = sum(PLANES), ([], []), [0, 0]

    def together(part: bool) -> tuple[bool, np.ndarray, np.ndarray]:
        targets, raws = zip(*held[part])
        held[part].clear()
        size[part] = 0
        table = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1) for x in raws], axis=1)
        return part, np.repeat(np.array(targets, np.uint64), [len(x) // width for x in raws]), table

    for batch in batches:
        for target, part, raw in zip(*(c.to_pylist() for c in batch.columns)):
            held[part].append((target, raw))
            size[part] += len(raw)
            if size[part] >= TOGETHER:
                yield together(part)
    for part in (False, True):
        if held[part]:
            yield together(part)


def unpacked(table: np.ndarray, column: int) -> np.ndarray:
    at, k = sum(PLANES[:column]), PLANES[column]
    wide = np.zeros((table.shape[1], 8), np.uint8)
    wide[:, :k] = table[at : at + k].T
    return wide.view("<i8" if column == 2 else "<u8").ravel()


Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def emit(rows: DataFrame, kernel: Kernel, targets: int, chunk: int) -> DataFrame:
    """(target, settled, pieces) of every text. ``kernel``: (bytes, offsets) to row, anchor, print, first, number, sides."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, content, doc, tag, first, number, sides = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, content, anchor))
        anchor, content, doc, tag, first, number, sides = (x[order] for x in (anchor, content, doc, tag, first, number, sides))
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
        least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        settled = doc > doc[least]
        for part in (False, True):
            use = np.flatnonzero(settled == part)
            if not len(use):
                continue
            by = blocks.mix(doc[use].view(np.uint64)) if part else anchor[use]
            target = ((by >> np.uint64(40)) % np.uint64(targets)).astype(np.uint32)
            order = np.lexsort((doc[use], target))
            use, target = use[order], target[order]
            table = planes(anchor[use], content[use], doc[use], tag[use], first[use], number[use], sides[use])
            cuts = np.flatnonzero(np.diff(target.astype(np.int64), prepend=-1))
            ends = np.append(cuts, len(use))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(target[cuts].astype(np.int32)), pa.array(np.full(len(cuts), part)),
                    pa.array([table[a:b].T.tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                ],
                ["target", "settled", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for begin, _, data, offsets in blocks.chunks(batch.column(2), chunk):
                row, anchor, content, first, number, sides = kernel(data, offsets)
                held.append((anchor, content, ids[begin + row].astype(np.int64), tags[begin + row].astype(np.int64), first, number, sides))
                size += len(row)
                if size >= PER_BLOCK:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    return rows.filter("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(run, "target int, settled boolean, pieces binary")


def meet(packed: DataFrame, tasks: int) -> DataFrame:
    """doc_id, tag, first, number, anchor, open: runs of windows that are removed, or still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces stay packed, but for what is needed to see which of them meet
        tables, anchors = [], []
        for settled, target, table in gathered(batches):
            if settled:
                yield from answer(unpacked(table, 2), table, unpacked(table, 0), np.zeros(table.shape[1], bool))
            else:
                tables.append(table)
                # the target stands for the bits of the anchor that were not sent
                anchors.append(unpacked(table, 0) | target << np.uint64(40))
        if not tables:
            return
        ordered = np.concatenate(anchors)
        ordered.sort()
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice):
            return
        for i, one in enumerate(anchors):
            use = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, one), len(twice) - 1)] == one)
            anchors[i], tables[i] = one[use], tables[i][:, use]
        anchor, table = np.concatenate(anchors), np.concatenate(tables, axis=1)
        del anchors, tables, twice
        content, doc = unpacked(table, 1), unpacked(table, 2)
        order = np.lexsort((doc, content, anchor))
        anchor, content, doc, table = anchor[order], content[order], doc[order], table[:, order]
        sides = unpacked(table, 6)
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_content = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        at = np.arange(len(anchor))
        removed = doc > doc[np.maximum.accumulate(np.where(new_content, at, 0))]
        starts = np.flatnonzero(new_anchor)
        sizes = np.diff(np.append(starts, len(anchor)))
        several = np.repeat(np.add.reduceat(new_content.astype(np.int64), starts) > 1, sizes)
        several &= np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), sizes)
        near = np.zeros(len(anchor), bool)
        group = np.cumsum(new_anchor).astype(np.uint64) << np.uint64(16)
        for shift in range(0, 48, 16):
            code = sides >> np.uint64(shift) & np.uint64(0xFFFF)
            use = np.flatnonzero(several & (code > 0))
            if not len(use):
                continue
            both = group[use] | code[use]
            order = np.argsort(both)
            both, use = both[order], use[order]
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            two = np.minimum.reduceat(doc[use], starts) < np.maximum.reduceat(doc[use], starts)
            near[use] |= np.repeat(two, np.diff(np.append(starts, len(use))))
        opened = ~removed & several & near
        del content, sides, order, several, near, group
        use = np.flatnonzero(removed | opened)
        yield from answer(doc[use], table[:, use], anchor[use], opened[use])
        del anchor, doc, table, removed, opened
        blocks.give_back()

    def answer(doc: np.ndarray, table: np.ndarray, anchor: np.ndarray, opened: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(doc), PER_ANSWER):
            part = slice(a, a + PER_ANSWER)
            tag, first, number = (pa.array(unpacked(table[:, part], i).view(np.int64)) for i in (3, 4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), tag, first, number, pa.array(anchor[part].view(np.int64)), pa.array(opened[part])], names)

    names = [x.split()[0] for x in RUNS.split(", ")]
    # as many targets to every task: dealt by a hash, one task got three times the pieces of the others
    return packed.repartitionById(tasks, F.col("target") % tasks).mapInArrow(run, RUNS)


def number_of_tasks(rows: DataFrame, per_task: int = TEXT_PER_TASK) -> int:
    return max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // per_task))


def removed_runs(
    rows: DataFrame, kernel: Kernel, chunk: int, settle: Callable[[DataFrame, int], DataFrame], per_task: int = TEXT_PER_TASK
) -> DataFrame:
    """doc_id, tag, runs (first, number): what ``settle`` and the exchange remove, by row.

    ``settle`` gets (doc_id, tag, text, runs with their anchors) of the open windows and returns doc_id, tag, first, number.
    """
    ship(rows.sparkSession)
    tasks = number_of_tasks(rows, per_task)
    runs = durable(meet(emit(rows, kernel, tasks * FINE, chunk), tasks), "runs")
    opened = runs.filter("open").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "number", "anchor")).alias("runs"))
    ids = durable(runs.filter("open").select("doc_id").distinct(), "open-ids")
    texts = semi(rows, ids, "doc_id").join(opened, ["doc_id", "tag"])
    settled = durable(settle(texts.select("doc_id", "tag", "text", "runs"), tasks), "settled")
    gone = runs.filter("not open").select("doc_id", "tag", "first", "number").unionByName(settled)
    # a row's runs are bounded by its text
    return gone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "number")).alias("runs"))


def coverage(runs: pa.Array, sizes: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Per row, which of its units (bytes or words) the removed windows cover."""
    for one, size in zip(runs, sizes.tolist()):
        change = np.zeros(size + 1, np.int64)
        if one.is_valid and len(one.values):
            first = one.values.field("first").to_numpy()
            np.add.at(change, first, 1)
            np.add.at(change, first + one.values.field("number").to_numpy() + window - 1, -1)
        yield np.cumsum(change[:-1]) > 0


def with_runs(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "runs")
