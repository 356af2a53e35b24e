"""Substring deduplication of words by recompression.

Each round names the runs of equal symbols and then the pairs of neighbours of a left and a right
class, as a hash of what they hold. Names are functions of content, so every task gives a run or
pair the same name without asking another: the naming is global. A symbol knows the words its
parse depended on; where those lie inside a window, the symbol is the same in every occurrence
of the window. The least of the high-level phrases (``PHRASE`` symbols) inside a window anchors it,
a window without any is its own anchor. Shared anchors bring candidate repeats together; windows
that are not settled by equal pieces are compared by two hashes of all of their words.

A word is removed if a window of ``WINDOW`` words that covers it also starts in a document with a smaller
id, judged on the input.

Defined results: null and empty texts have no words. Rows without an id keep everything and are
compared with nothing. Rows that repeat an id are judged apart, and not against each other. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks, windows
from tripsearch.ship import ship

WINDOW = 50
ROUNDS = 3
PHRASE = 3
TOP = np.uint64(2**64 - 1)
BASE = blocks.ROOT * 3 % 2**64 | 1
BASE_2 = blocks.ROOT * 7 % 2**64 | 1


class Parse:
    """Symbols over the words of a block: name, first word, word after the last, and the words asked."""

    def __init__(self, names: np.ndarray, at: np.ndarray):
        self.name, n = names, len(names)
        self.start = np.arange(n)
        self.end = self.start + 1
        self.low, self.high = self.start.copy(), self.end.copy()
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.row, self.at = row, at

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same row; the words that the previous and next one asked.

        Beyond a row's ends lies the word before and after it: no window holds that.
        """
        follows = np.append(self.row[1:] == self.row[:-1], False) if len(self.row) else np.zeros(0, bool)
        led = np.concatenate([[False], follows[:-1]]) if len(follows) else follows
        before, after = self.at[self.row] - 1, self.at[self.row + 1] + 1
        low_before = np.where(led, np.concatenate([[0], self.low[:-1]]), before) if len(led) else before
        high_after = np.where(follows, np.concatenate([self.high[1:], [0]]), after) if len(led) else after
        return follows, led, low_before, high_after

    def _merge(self, first: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Keep the symbols that start at ``first``; each takes in those up to the next."""
        last = np.append(first[1:], len(self.name)) - 1
        self.low = np.minimum.reduceat(low, first) if len(first) else low
        self.high = np.maximum.reduceat(high, first) if len(first) else high
        self.name, self.start, self.end, self.row = names, self.start[first], self.end[last], self.row[first]

    def round(self, number: int) -> None:
        # runs: whether a symbol goes on depends on its neighbours
        follows, _, low_before, high_after = self._neighbours()
        if not len(follows):
            return
        same = np.append(self.name[1:] == self.name[:-1], False) & follows
        first = np.flatnonzero(~np.concatenate([[False], same[:-1]]))
        length = np.diff(np.append(first, len(self.name))).astype(np.uint64)
        names = self.name[first]
        names = np.where(length > 1, blocks.mix(names + length * np.uint64(blocks.ROOT + 2 * number)), names)
        self._merge(first, names, np.minimum(self.low, low_before), np.maximum(self.high, high_after))
        # pairs: a left symbol takes a right one that follows it
        follows, _, low_before, high_after = self._neighbours()
        right = (blocks.mix(self.name ^ np.uint64(number * 0x9E37 + 1)) & np.uint64(1)).astype(bool)
        takes = ~right & np.append(right[1:], False) & follows
        taken = np.concatenate([[False], takes[:-1]])
        alone = ~takes & ~taken
        low = np.where(alone & right, np.minimum(self.low, low_before), self.low)
        high = np.where(alone & ~right, np.maximum(self.high, high_after), self.high)
        following = np.append(self.name[1:], np.uint64(0))
        names = np.where(takes, blocks.mix(self.name * np.uint64(BASE) + blocks.mix(following + np.uint64(number))), self.name)
        first = np.flatnonzero(~taken)
        self._merge(first, names[first], low, high)


def sparse_minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of stretches of 1, 2, 4, ... values up to ``longest``."""
    tables, step = [values], 1
    while 2 * step <= longest and len(tables[-1]) > step:
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
        step *= 2
    return tables


def prefix(names: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * blocks.powers(len(names), base))])


def content(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the names from ``start`` to ``end``, wherever they stand."""
    back = blocks.powers(len(sums), pow(base, -1, 2**64))
    return blocks.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def pieces(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """row, anchor, print, first window, number of windows, sides (all alike): runs of windows with one anchor."""
    starts, ends, at = blocks.words(data, offsets)
    names = blocks.word_hashes(data, starts, ends)
    counts = np.maximum(np.diff(at) - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    none = np.zeros(0, np.int64)
    if not len(row):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none.view(np.uint64)
    begin = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(row))
    sums = prefix(names, BASE)
    parse = Parse(names, at)
    for number in range(ROUNDS):
        parse.round(number)
    k = min(PHRASE, len(parse.name))
    size = len(parse.name) - k + 1
    phrase = np.zeros(size, np.uint64)
    for j in range(k):
        phrase = blocks.mix(phrase + parse.name[j : j + size])
    low, high = parse.low[:size], parse.high[k - 1 :]
    lo, hi = np.searchsorted(low, begin), np.searchsorted(high, begin + window, "right")
    span = hi - lo
    anchor = content(sums, BASE, begin, begin + window)
    seen = np.flatnonzero(span > 0)
    if len(seen):
        tables = sparse_minima(phrase, int(span.max()))
        level = np.frexp(span[seen].astype(np.float64))[1] - 1
        for v in np.unique(level):
            use = seen[level == v]
            anchor[use] = np.minimum(tables[v][lo[use]], tables[v][hi[use] - (1 << int(v))])
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(row)))
    prints = content(sums, BASE, begin[first], begin[first] + number + window - 1)
    return row[first], anchor[first], prints, begin[first] - at[row[first]], number, np.ones(len(first), np.uint64)


def settle(texts: DataFrame, tasks: int, window: int = WINDOW) -> DataFrame:
    """The open windows that also start in a smaller document, compared by two hashes of their words."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, end, data, offsets in blocks.chunks(batch.column(2)):
                starts, ends, at = blocks.words(data, offsets)
                names = blocks.word_hashes(data, starts, ends)
                one, two = prefix(names, BASE), prefix(names, BASE_2)
                runs = batch.column(3).slice(begin, end - begin)
                flat, lengths = runs.flatten(), np.diff(runs.offsets.to_numpy())
                number = flat.field("number").to_numpy()
                row = np.repeat(np.repeat(np.arange(end - begin), lengths), number)
                first = np.repeat(flat.field("first").to_numpy(), number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                place = at[row] + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(content(one, BASE, place, place + window).view(np.int64)), pa.array(content(two, BASE_2, place, place + window).view(np.int64)),
                        pa.array(ids[begin + row]), pa.array(tags[begin + row]), pa.array(first),
                    ],
                    ["h1", "h2", "doc_id", "tag", "first"],
                )

    shown = texts.mapInArrow(show, "h1 long, h2 long, doc_id long, tag long, first long")
    shown = windows.durable(shown, "open-windows")
    least = shown.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    gone = shown.join(least.select("h1", "h2", "least"), ["h1", "h2"]).filter("doc_id > least")
    return gone.select("doc_id", "tag", "first", F.lit(1).cast("long").alias("number"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, tag, text) and, for those that lose words, their removed runs of windows."""
    rows = windows.tagged(docs, key, text)
    gone = windows.removed_runs(rows, partial(pieces, window=window), blocks.CHUNK_BYTES, partial(settle, window=window))
    return rows, gone


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, kept_text (kept words joined by a space), n_words, n_removed, kept_sha256 of every row."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in blocks.chunks(batch.column(2)):
                starts, ends, at = blocks.words(data, offsets)
                raw, kept, lost = data.tobytes(), [], []
                for i, hit in enumerate(windows.coverage(batch.column(3).slice(begin, end - begin), np.diff(at), window)):
                    lost.append(int(hit.sum()))
                    own = np.flatnonzero(~hit) + at[i]
                    if not lost[-1]:
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                    else:
                        kept.append(b" ".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(at)), pa.array(lost, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    ],
                    ["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"],
                )

    rows, gone = removed(docs, key, text, window)
    return windows.with_runs(rows, gone).mapInArrow(cut, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")
