"""Text columns as byte arrays: chunks of bounded size, words, and hashes of words and shingles.

Kernels work on whole texts, many at a time. A chunk holds about ``CHUNK_BYTES`` of text; a longer
text is a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: The white space that splits words: space and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
ROOT = 0x9E3779B97F4A7C15


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a reused worker would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


@lru_cache
def byte_set(chosen: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chosen)] = True
    return mask


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and the number of words before each row. Words end with their row."""
    space = (byte_set(SPACES) if spaces is None else spaces)[data]
    begin, finish = ~space, ~space
    if len(data):
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        starts_row = np.zeros(len(data), bool)
        starts_row[inner] = True
        begin[1:] &= space[:-1] | starts_row[1:]
        finish[:-1] &= space[1:] | starts_row[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    size = CHUNK_BYTES + (CHUNK_BYTES >> 3)
    while size < n:
        size *= 2
    return _powers(size, base)[:n]


@lru_cache
def letter_values(seed: int, fold: bool = False) -> np.ndarray:
    """A random number for every byte."""
    table = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word, the same for equal words anywhere; ``fold`` lower-cases A-Z."""
    base = (ROOT * (2 * seed + 1)) % 2**64 | 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letter_values(seed, fold)[data] * powers(len(data), base), out=sums[1:])
    back = powers(len(data) + 1, pow(base, -1, 2**64))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(ROOT))


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of each row; a shorter row's whole sequence is one.

    Returns the hashes, in the order of the words, and the row offsets. A row without words has none.
    """
    n = len(hashes)
    counts = np.diff(offsets)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += hashes[j : j + len(full)] * np.uint64(pow(ROOT, 2 * j + 1, 2**64) | 1)
    mix_full = mix(full)
    # the word at which each shingle starts
    first = np.repeat(offsets[:-1] - out_offsets[:-1], made) + np.arange(out_offsets[-1])
    long = np.repeat(counts >= size, made)
    out = np.zeros(len(first), np.uint64)
    out[long] = mix_full[first[long]]
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        value = np.full(len(rows), short, np.uint64)
        for j in range(short):
            value += hashes[offsets[rows] + j] * np.uint64(pow(ROOT, 2 * j + 3, 2**64) | 1)
        out[out_offsets[rows]] = mix(value)
    return out, out_offsets


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][offsets[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
