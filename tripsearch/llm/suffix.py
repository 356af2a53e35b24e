"""Substring deduplication of bytes: shards of repeated text, sorted by external induced sorting.

Windows of ``WINDOW`` bytes are dealt by content: the least hash of the ``GRAM``-byte strings inside a
window anchors it, so equal windows meet in one shard. A piece whose content repeats whole is settled
there. Of the others, a first piece stays open only if another one with its anchor agrees on what
lies left or right of the anchor as far as one side of any common window must reach. The open
pieces become the shards' text: their suffixes are sorted by external induced sorting
(``induce``), and where the common prefix of neighbours reaches the window, the windows are equal.
A byte is removed if a window that covers it also starts in a document with a smaller id, judged on the input.

Defined results: null and empty texts have no bytes. Rows without an id keep everything and are compared
with nothing. Rows that repeat an id are judged apart, and not against each other. What is left may
not be UTF-8, so the kept text is binary. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks, induce, windows
from tripsearch.llm.byids import semi
from tripsearch.ship import ship

WINDOW = 50
GRAM = 12
CHUNK = 512 << 10
#: Parts of an anchor's windows, by its place in them; each has a code of its own.
PARTS = 3
#: Bytes of text per task of the exchange, and shards per task.
TEXT_PER_TASK = 6 << 20
SHARDS = 2
BASE = blocks.ROOT * 5 % 2**64 | 1


def pieces(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, anchor, print, first window, number of windows, sides: runs of windows with one anchor at one place."""
    none = np.zeros(0, np.int64)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    n = len(data)
    if not counts.sum():
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(blocks.letter_values(3)[data] * blocks.powers(n, BASE), out=sums[1:])
    back = blocks.powers(n + 1, pow(BASE, -1, 2**64))
    grams = blocks.mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    # minima of 1, 2, 4, ... neighbours, then of all grams inside a window
    wide, step, least = window - gram + 1, 1, grams
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    total = n - window + 1
    least = np.minimum(least[:total], least[wide - step : wide - step + total])
    valid = np.zeros(n + 1, np.int64)
    has = np.flatnonzero(counts)
    np.add.at(valid, offsets[has], 1)
    np.add.at(valid, offsets[has] + counts[has], -1)
    valid = np.cumsum(valid)[:total] > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[offsets[has]] = True
    first = np.flatnonzero(new)
    stop = np.append(np.flatnonzero(new | ~valid), total)
    end = stop[np.searchsorted(stop, first, "right")]
    # a run ends where its anchor's place leaves the window; the next place of the same gram goes on
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(first):
        place = first + (grams[first[:, None] + np.arange(wide)] == least[first][:, None]).argmax(axis=1)
        cut = np.minimum(end, place + 1)
        found.append((first, cut, place))
        more = cut < end
        first, end = cut[more], end[more]
    first, end, place = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, first, "right") - 1
    number = end - first

    # windows by how many bytes lie left of the anchor: common windows lie alike, so their pieces share what all of a part cover
    sides, left, begin, finish = np.zeros(len(first), np.uint64), place - first, offsets[row], offsets[row + 1]
    edges = np.linspace(0, wide, PARTS + 1).astype(np.int64)
    for part, (least_left, end_left) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        a, b = place - least_left, place + window - end_left + 1
        # 0: no window of the piece is of that part, or the text ends before
        use = np.flatnonzero((left >= least_left) & (left - number < end_left - 1) & (a >= begin) & (b <= finish))
        a, b = a[use], b[use]
        code = blocks.mix((sums[b] - sums[a]) * back[a]) >> np.uint64(48)
        sides[use] |= np.maximum(code, np.uint64(1)) << np.uint64(16 * part)
    stop = first + number + window - 1
    prints = blocks.mix((sums[stop] - sums[first]) * back[first] + number.astype(np.uint64))
    return row, least[first], prints, first - offsets[row], number, sides


def cut_pieces(texts: DataFrame, window: int) -> DataFrame:
    """anchor, doc_id, tag, first, piece of every open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = blocks.text_bytes(batch.column(2))
            runs = batch.column(3)
            flat, row = runs.flatten(), np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            first, number = flat.field("first").to_numpy(), flat.field("number").to_numpy()
            start, raw = offsets[row] + first, data.tobytes()  # Arrow never lets go of a memoryview it is given
            size = number + window - 1
            for a in range(0, len(row), 20_000):
                part = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("anchor").slice(a, 20_000), pa.array(ids[row[part]]), pa.array(tags[row[part]]), pa.array(first[part]),
                        pa.array([raw[x : x + y] for x, y in zip(start[part].tolist(), size[part].tolist())], pa.binary()),
                    ],
                    ["anchor", "doc_id", "tag", "first", "piece"],
                )

    return texts.mapInArrow(run, "anchor long, doc_id long, tag long, first long, piece binary")


def marked_windows(
    pieces: np.ndarray, offsets: np.ndarray, doc: np.ndarray, window: int, memory: int = induce.MEMORY, most: int = induce.BATCH
) -> np.ndarray:
    """Whether a window starts at each letter that also starts in a piece of a smaller document.

    ``pieces`` holds the letters (bytes + 1) of all pieces, a 0 after each; ``offsets`` has their starts and the end.
    Of equal windows that go on over batches, more than ``most`` places are settled in parts; that changes no result.
    """
    size = np.diff(offsets) - 1
    piece_of, marked = induce.vector(len(pieces), np.int32, memory), induce.vector(len(pieces), bool, memory)
    few = max(1, induce.BATCH // (2 * window))  # pieces of a stretch: none is as long as two windows
    for a in range(0, len(size), few):
        b = min(len(size), a + few)
        piece_of[offsets[a] : offsets[b]] = np.repeat(np.arange(a, b, dtype=np.int32), size[a:b] + 1)
        marked[offsets[a] : offsets[b]] = False

    def settle(at: np.ndarray, same: np.ndarray) -> None:
        group = np.cumsum(~same) - 1
        owner = doc[piece_of[at]]
        least = np.minimum.reduceat(owner, np.flatnonzero(~same))
        marked[at[owner > least[group]]] = True

    # the letters from every place on, as many as a word holds; a shorter window goes letter by letter
    per = 8 // pieces.itemsize if min(window, len(pieces)) * pieces.itemsize >= 8 else 1
    words = pieces if per == 1 else np.ndarray(len(pieces) - per + 1, np.uint64, pieces, strides=(pieces.itemsize,))

    def agree(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the common prefix reaches the window, compared a word at a time."""
        left = np.arange(len(one))
        for step in range(0, window, per):
            step = min(step, window - per)
            left = left[words[one[left] + step] == words[two[left] + step]]
        out = np.zeros(len(one), bool)
        out[left] = True
        return out

    rest = np.zeros(0, np.int64)
    for batch in induce.sorted_suffixes(pieces, window, memory):
        owner = piece_of[batch]
        whole = batch - offsets[owner] + window <= size[owner]
        at = np.concatenate([rest, batch[whole]])
        if not len(at):
            continue
        same = np.concatenate([[False], agree(at[1:], at[:-1])])
        # the last group may go on in the next batch; of a long one all places of its smallest document are
        # carried, as a still smaller document may come
        last = int(np.flatnonzero(~same)[-1])
        settle(at[:last], same[:last]) if last else None
        rest = at[last:]
        if len(rest) > most:
            settle(rest, np.concatenate([[False], np.ones(len(rest) - 1, bool)]))
            owners = doc[piece_of[rest]]
            rest = rest[owners == owners.min()]
    if len(rest):
        settle(rest, np.concatenate([[False], np.ones(len(rest) - 1, bool)]))
    return marked


def repeated_windows(pieces: np.ndarray, offsets: np.ndarray, *more) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window in it) of every window that ``marked_windows`` marks."""
    at = np.flatnonzero(marked_windows(pieces, offsets, *more))
    piece = np.searchsorted(offsets, at, "right") - 1
    return piece, at - offsets[piece]


def marked_runs(marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, number) of every run of marked places, a stretch at a time; a run that goes on over stretches comes in parts."""
    for a in range(0, len(marked), induce.BATCH):
        edges = np.flatnonzero(np.diff(marked[a : a + induce.BATCH].astype(np.int8), prepend=0, append=0))
        yield a + edges[::2], edges[1::2] - edges[::2]


def sort_shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, tag, first, number: the runs of windows of a shard's pieces that also start in a smaller document."""
    # beyond what ``vector`` keeps in memory, letters go to a file as they come
    most = 4 * induce.MEMORY
    columns, sizes, file, total = [], [], tempfile.SpooledTemporaryFile(np.dtype(np.uint16).itemsize * most), 0
    for batch in batches:
        for begin, end, data, offsets in blocks.chunks(batch.column(4), CHUNK // 2):
            columns.append([c.to_numpy()[begin:end].copy() for c in batch.columns[1:4]])  # a view would hold the batch
            count = len(offsets) - 1
            letters = np.zeros(len(data) + count, np.uint16)
            letters[np.arange(len(data)) + np.repeat(np.arange(count), np.diff(offsets))] = data.astype(np.uint16) + 1
            file.write(letters.data)
            sizes.append(np.diff(offsets) + 1)
            total += len(letters)
    if not columns:
        return
    doc, tag, first = (np.concatenate(x) for x in zip(*columns))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del columns, sizes
    if total > most:
        file.flush()
        shard = np.memmap(file, np.uint16, "r", shape=(total,))
    else:
        file.seek(0)
        shard = np.frombuffer(file.read(), np.uint16)
    file.close()
    marked = marked_windows(shard, offsets, doc, window, induce.MEMORY)
    # neighbouring windows of a piece leave as one run; the 0 after a piece ends its last one
    for at, number in marked_runs(marked):
        if len(at):
            piece = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[piece]), pa.array(tag[piece]), pa.array(first[piece] + at - offsets[piece]), pa.array(number)],
                ["doc_id", "tag", "first", "number"],
            )
    del shard, marked
    blocks.give_back()


def settle(texts: DataFrame, tasks: int, window: int = WINDOW) -> DataFrame:
    """The open windows that also start in a smaller document, by the suffix order of their shard."""

    shards = cut_pieces(texts, window).repartition(tasks * SHARDS, "anchor")
    return shards.mapInArrow(partial(sort_shard, window=window), "doc_id long, tag long, first long, number long")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, tag, text) and, for those that lose bytes, their removed runs of windows."""
    if window < 2 * GRAM:
        raise ValueError(f"windows of at least {2 * GRAM} bytes")
    rows = windows.tagged(docs, key, text)
    return rows, windows.removed_runs(rows, partial(pieces, window=window), CHUNK, partial(settle, window=window), TEXT_PER_TASK)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, spans (start, end), kept_sha256 of every row."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in blocks.chunks(batch.column(2)):
                kept, lost, spans = [], [], []
                for i, hit in enumerate(windows.coverage(batch.column(3).slice(begin, end - begin), np.diff(offsets), window)):
                    own = data[offsets[i] : offsets[i + 1]]
                    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    lost.append(int(hit.sum()))
                    kept.append(own[~hit].tobytes() if lost[-1] else own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(lost, pa.int64()),
                        pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    ],
                    ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
                )

    rows, gone = removed(docs, key, text, window)
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    return windows.with_runs(rows, gone).mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` less its removed bytes; bytes that are no UTF-8 without their neighbours go too.

    Only rows that lose something are rewritten. ``n_chars``, if there is one, is counted again for them.
    Rows are told apart by id and, where ids repeat, by text.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(2))
            kept = []
            for i, hit in enumerate(windows.coverage(batch.column(3), np.diff(offsets), window)):
                kept.append(data[offsets[i] : offsets[i + 1]][~hit].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], ["doc_id", "tag", "kept"])

    rows, gone = removed(docs, key, text, window)
    gone = windows.durable(gone, "removed-runs")
    ids = windows.durable(gone.select("doc_id").distinct(), "shortened-ids")
    shorter = semi(rows, ids, "doc_id").join(gone, ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs")
    shorter = windows.durable(shorter.mapInArrow(cut, "doc_id long, tag long, kept string"), "shortened").dropDuplicates(["doc_id", "tag"])
    taken = {c.lower() for c in docs.columns}
    tag, short = (name + "_" * (1 + max(map(len, taken))) if name in taken else name for name in ("short_of_tag", "short_text"))
    shorter = shorter.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("kept").alias(short))
    # most rows lose nothing: only the others meet the join
    ids = ids.withColumnRenamed("doc_id", key)
    changed = semi(docs, ids, key).withColumn(tag, windows.tag_of(docs, key, text))
    same = semi(docs, ids, key, "left_anti")
    joined = changed.join(shorter, [key, tag], "left").withColumn(text, F.coalesce(short, F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col(short).isNotNull(), F.length(short).cast(kind)).otherwise(F.col("n_chars")))
    return same.unionByName(joined.select(*docs.columns))
