"""External induced sorting of the suffixes of one shard.

The text is a sequence of letters over 0, with a 0 after every piece. S* suffixes (an ascent after a
descent) are sorted first: an induction sorts their substrings, equal ones get one name, and the
names' own suffixes are ranked by doubling until they span the depth that matters. A second
induction then brings every suffix in order. An induction keeps one queue of suffix tuples per first
letter; tuples are taken by ascending (L) or descending (S) letter, and each puts its predecessor
in the queue of the letter before it. Queues beyond ``MEMORY`` tuples go to an unnamed file that
ends with the task; whatever else has an entry per letter or S* suffix is mapped from such files too once
it is far larger than ``MEMORY``, and is worked on a stretch at a time. So a task's memory does not grow with its
shard, but for the columns of the pieces and a group of more than ``BATCH`` S* suffixes with one rank.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of an induction hold in memory together.
MEMORY = 1_000_000
BATCH = 500_000


class Queues:
    """A priority queue over few letters: within a letter, tuples leave in the order they came."""

    def __init__(self, letters: int, memory: int):
        self.held: list[list[np.ndarray]] = [[] for _ in range(letters)]
        self.sizes = np.zeros(letters, np.int64)
        self.inside, self.memory, self.file = 0, memory, None
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(letters)]

    def put(self, letter: int, tuples: np.ndarray) -> None:
        self.held[letter].append(tuples)
        self.sizes[letter] += len(tuples)
        self.inside += len(tuples)
        if self.inside > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for letter, arrays in enumerate(self.held):
            if arrays:
                flat = np.concatenate(arrays)
                self.spilled[letter].append((self.file.tell(), len(flat)))
                self.file.write(flat.tobytes())
                self.held[letter] = []
        self.inside = 0

    def take(self, letter: int) -> Iterator[np.ndarray]:
        """What the letter's queue holds now, in order, in batches; it is empty then."""
        parts, arrays = self.spilled[letter], self.held[letter]
        self.spilled[letter], self.held[letter] = [], []
        self.inside -= sum(map(len, arrays))
        self.sizes[letter] = 0
        for at, count in parts:
            for a in range(0, count, BATCH):
                self.file.seek(at + 8 * a)
                yield np.frombuffer(self.file.read(8 * min(BATCH, count - a)), np.int64)
        if arrays:
            flat = np.concatenate(arrays)
            for a in range(0, len(flat), BATCH):
                yield flat[a : a + BATCH]

    def backwards(self, letter: int) -> Iterator[np.ndarray]:
        """The same from the last to the first."""
        parts, arrays = self.spilled[letter], self.held[letter]
        self.spilled[letter], self.held[letter] = [], []
        self.inside -= sum(map(len, arrays))
        self.sizes[letter] = 0
        if arrays:
            flat = np.concatenate(arrays)[::-1]
            for a in range(0, len(flat), BATCH):
                yield flat[a : a + BATCH]
        for at, count in reversed(parts):
            for a in reversed(range(0, count, BATCH)):
                self.file.seek(at + 8 * a)
                yield np.frombuffer(self.file.read(8 * min(BATCH, count - a)), np.int64)[::-1]


def vector(size: int, kind: type, memory: int) -> np.ndarray:
    """An array; one far larger than memory is mapped from an unnamed file."""
    if size <= 4 * memory:
        return np.empty(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


def is_s(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller. A stretch at a time, from the end."""
    out = vector(len(text), bool, memory)
    after = True  # of the first suffix of the stretch that follows
    for a in reversed(range(0, len(text), BATCH)):
        part = np.asarray(text[a : a + BATCH + 1])  # with the next stretch's first letter
        own = min(BATCH, len(text) - a)
        changes = np.flatnonzero(part[1:] != part[:-1])
        # every letter is as the next place where the letter changes; the last run is as what follows
        rises = np.append(part[changes + 1] > part[changes], after)
        out[a : a + own] = np.repeat(rises, np.diff(np.concatenate([[-1], changes, [len(part) - 1]])))[:own]
        after = bool(out[a])
    return out


def spread(queues: Queues, text: np.ndarray, before: np.ndarray) -> None:
    """Put suffixes into the queues of their first letters, in order."""
    letters = text[before]
    order = np.argsort(letters, kind="stable")
    ordered = before[order]
    letters = letters[order]
    ends = np.append(np.flatnonzero(letters[1:] != letters[:-1]) + 1, len(letters)) if len(letters) else []
    first = 0
    for end in ends:
        queues.put(int(letters[first]), ordered[first:end])
        first = end


def induce(text: np.ndarray, s_type: np.ndarray, seeds: Queues, memory: int, only_stars: bool) -> Iterator[np.ndarray]:
    """All suffixes (or the S* ones) in descending order, from S* suffixes sorted per letter."""
    letters = len(seeds.held)
    l_side, s_side = Queues(letters, memory), Queues(letters, memory)
    waiting = Queues(letters, memory)
    for letter in range(letters):
        while waiting.sizes[letter]:  # a run of one letter feeds its own queue
            for batch in waiting.take(letter):
                l_side.put(letter, batch)
                before = batch - 1
                spread(waiting, text, before[(before >= 0) & ~s_type[before]])
        for batch in seeds.take(letter):
            before = batch - 1
            spread(waiting, text, before[(before >= 0) & ~s_type[before]])
    for letter in reversed(range(letters)):
        while s_side.sizes[letter]:
            for batch in s_side.take(letter):
                before = batch - 1
                rising = s_type[before]
                yield batch[(before >= 0) & ~rising] if only_stars else batch
                spread(s_side, text, before[(before >= 0) & rising])
        for batch in l_side.backwards(letter):
            if not only_stars:
                yield batch
            before = batch - 1
            spread(s_side, text, before[(before >= 0) & s_type[before]])
    if not only_stars:
        yield np.array([len(text) - 1])  # the last sentinel: nothing follows that induces it


def same_substrings(text: np.ndarray, one: np.ndarray, two: np.ndarray, length_one: np.ndarray, length_two: np.ndarray) -> np.ndarray:
    """Whether the S* substrings that start at ``one`` and ``two`` are equal."""
    same = length_one == length_two
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        left = left[step < length_one[left]]
        differ = text[one[left] + step] != text[two[left] + step]
        same[left[differ]] = False
        left = left[~differ]
        step += 1
    return same


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the numbers in ascending order, and the numbers in that order."""
    place = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + place < 64:
        # number and place in one word: sorting words is far quicker than sorting places
        packed = values << place | np.arange(len(values))
        packed.sort()
        return packed & (1 << place) - 1, packed >> place
    order = np.argsort(values, kind="stable")
    return order, values[order]


def ranks(values: np.ndarray) -> np.ndarray:
    """The rank of every number among the distinct ones, from 1."""
    order, ordered = in_order(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return out


def stretches(size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, size, BATCH):
        yield a, min(size, a + BATCH)


def star_places(s_type: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the S* suffixes, a stretch at a time."""
    for a, b in stretches(len(s_type) - 1):
        part = s_type[a : b + 1]
        yield np.flatnonzero(part[1:] & ~part[:-1]) + (a + 1)


def refine(order: np.ndarray, first: np.ndarray, rank: np.ndarray, ahead: int) -> None:
    """Order what shares a rank by the rank of the star ``ahead`` stars further on; nothing there comes first.

    ``order`` has the stars by rank, ``first`` where a rank begins, ``rank`` every star's: the place where it begins. So a
    rank stays comparable when others are refined before it.
    """
    total, begin = len(order), 0
    while begin < total:
        end = min(total, begin + BATCH)
        while end < total and not first[end]:  # a rank is refined as a whole
            more = np.flatnonzero(first[end : end + BATCH])
            end = end + int(more[0]) if len(more) else min(total, end + BATCH)
        starts = np.flatnonzero(first[begin:end])
        size = np.diff(np.append(starts, end - begin))
        use = np.flatnonzero(np.repeat(size > 1, size)) + begin
        if len(use):
            star = order[use].astype(np.int64)
            key = np.zeros(len(use), np.int64)
            there = np.flatnonzero(star + ahead < total)
            key[there] = rank[star[there] + ahead] + 1
            key += np.repeat(np.arange(np.count_nonzero(size > 1)), size[size > 1]) * (total + 1)
            place, key = in_order(key)
            star, new = star[place], np.concatenate([[True], key[1:] != key[:-1]])
            order[use], first[use] = star, new
            began = np.flatnonzero(new)
            rank[star] = np.repeat(use[began], np.diff(np.append(began, len(use))))
        begin = end


def star_order(text: np.ndarray, s_type: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The S* suffixes, sorted by at least their first ``depth`` letters."""
    letters, n = int(text.max(initial=0)) + 1, len(text)
    total, kind = sum(map(len, star_places(s_type))), np.int32 if n < 2**31 else np.int64
    seeds, stars, end = Queues(letters, memory), vector(total, kind, memory), 0
    for places in star_places(s_type):
        stars[end : end + len(places)] = places
        end += len(places)
        spread(seeds, text, places)
    order = vector(total, kind, memory)
    for batch in induce(text, s_type, seeds, memory, only_stars=True):
        order[end - len(batch) : end] = batch[::-1]
        end -= len(batch)
    # from here on stars go by their number; that of a place:
    number_at = vector(n, kind, memory)
    for a, b in stretches(total):
        number_at[stars[a:b]] = np.arange(a, b)
    for a, b in stretches(total - end):
        order[end + a : end + b] = number_at[order[end + a : end + b]]
    del number_at
    # the last sentinel is S*, but nothing follows that could induce it: it comes first
    if end:
        induced = np.zeros(total, bool)
        induced[order[end:]] = True
        order[:end] = np.flatnonzero(~induced)

    def length(star: np.ndarray) -> np.ndarray:
        out = stars[np.minimum(star + 1, total - 1)].astype(np.int64) - stars[star] + 1
        out[star == total - 1] = max(1, n - int(stars[-1]))
        return out

    first, rank, began = vector(total, bool, memory), vector(total, kind, memory), 0
    first[:1] = True
    for a, b in stretches(total):
        one, two = order[max(1, a) : b].astype(np.int64), order[max(1, a) - 1 : b - 1].astype(np.int64)
        first[max(1, a) : b] = ~same_substrings(text, stars[one].astype(np.int64), stars[two].astype(np.int64), length(one), length(two))
        place = np.maximum.accumulate(np.where(first[a:b], np.arange(a, b), began))
        rank[order[a:b]], began = place, int(place[-1])

    def span(ahead: int) -> int:
        """The fewest letters that so many stars take, or ``depth``."""
        return min((int((stars[a + ahead : b + ahead] - stars[a:b]).min()) for a, b in stretches(total - ahead)), default=depth)

    ahead = 1
    while np.count_nonzero(first) < total and span(ahead) < depth:
        refine(order, first, rank, ahead)
        ahead *= 2
    for a, b in stretches(total):
        order[a:b] = stars[order[a:b]]
    return order


def sorted_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Batches of suffixes in descending order of at least their first ``depth`` letters."""
    if not len(text):
        return
    s_type = is_s(text, memory)
    seeds = Queues(int(text.max()) + 1, memory)
    order = star_order(text, s_type, depth, memory)
    for a in range(0, len(order), BATCH):
        spread(seeds, text, order[a : a + BATCH].astype(np.int64))
    del order
    held, size = [], 0
    for batch in induce(text, s_type, seeds, memory, only_stars=False):
        held.append(batch)
        size += len(batch)
        if size >= BATCH // 4:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)
