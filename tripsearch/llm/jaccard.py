"""Exact Jaccard join of n-gram sets: pigeonhole over a partition of the token universe.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased; a shorter text is
one shingle of all its words). Sets are banded by size so that partners lie in one band or the
next. A hash deals a band's tokens to segments. Two sets that link differ in at most
H = floor(2 n / 7) tokens, n the larger size, so of any H + 1 segments of the larger set one agrees
whole. A segment whose one-deletion neighbourhood is indexed too counts twice, as it still agrees
when one token differs.

Before that, sets that cannot link go: a link's shared tokens are at least 75 % of the larger set, and no
more than the tokens that some other set holds too. Blocks send each token once to the task that counts it and learn which
are theirs alone. Sets with over a quarter of such tokens, in most corpora nearly all, get no signatures.

Allocation by cost: a set indexes, of its segments, those with the most tokens that are rare
around it; if these are too few it adds the one-deletion neighbourhoods of the band's designated
segments, and only then segments of common tokens alone. Sets that cannot cover H + 1 make the
segmentation of all bands finer; this ends, since segments of single tokens always cover it. A set
that indexes ``MORE`` segments than it must shares that many more signatures with every partner: pairs
with fewer are no candidates.

Signatures travel packed, grouped by target, one binary row per block and target. Groups of sets that share
one are deduplicated by their members. Equal sets are one class from the start. Every group is
first linked as a star around its smallest id, then around other members while that joins what is
apart; what still lies in different components is compared pair by pair: no link between different texts is
lost, and no pairs are formed within a component. Before their tokens are fetched, pairs meet by sketches of the tokens that
other open sets hold too, counted by cell: a pair that by its cells cannot share enough is none.

Defined results: null and empty texts and texts without words have the empty set and link with
nothing. Rows without an id have no component and link with nothing. Rows that repeat an id are
one node with the links of all its texts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks
from tripsearch.llm.byids import semi
from tripsearch.llm.links import components
from tripsearch.ship import ship
from tripsearch.storage import durable

SHINGLE = 5
#: 100 * intersection >= LEAST * union. The bound of 2 / 7 above follows from it.
LEAST = 75
#: Tokens that more than so many documents of a stretch of ``STRETCH`` tokens hold count as common.
COMMON = 2
STRETCH = 1_500_000
MORE = 12
#: Pairs across components, per row of the groups, that are compared without more rounds of stars.
FEW = 30
HUBS = 3
#: Signatures that one task of the index handles, and that one block packs.
PER_TASK = 1_500_000
PER_BLOCK = 300_000
#: Bands of up to so many segments have the one-deletion neighbourhoods of all of them.
SMALL = 40
FINE = 5  # targets per task: evens out how rows are dealt
#: Instead of a row: several rows of the block hold the token.
SEVERAL = 0xFFFFFFFF
#: Cells that a sketch counts tokens in, up to so many in a cell; four bits of a long each.
CELLS, DEEP = 256, 4
LONGS = CELLS * DEEP // 64


def set_block(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, tokens ascending by row, offsets)."""
    for first, last, data, offsets in blocks.chunks(column):
        starts, ends, at = blocks.words(data, offsets)
        hashes = blocks.word_hashes(data, starts, ends, fold=True)
        yield first, last, *blocks.distinct_by_row(*blocks.shingle_hashes(hashes, at, SHINGLE))


def bands(largest: int) -> np.ndarray:
    """Lower ends of the size bands: partners of a set lie in its band or the next."""
    ends = [1]
    while ends[-1] <= largest * 2:
        ends.append(ends[-1] * 4 // 3 + 1)
    return np.array(ends)


def segments_of(ends: np.ndarray, fineness: int) -> np.ndarray:
    """Number of segments of every band: enough that H + 1 of them nearly always hold tokens."""
    return (ends[1:] * 5 // 14 + 12) * fineness


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (two numbers) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, tokens, offsets in set_block(batch.column(1)):
                one = row_sums(blocks.mix(tokens ^ np.uint64(0xA5)), offsets)
                two = row_sums(blocks.mix(tokens ^ np.uint64(0x5A5A)), offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc_id", "n_shingles", "f1", "f2"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, byte by byte: the upper bytes are alike and compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return wide.view("<u8").ravel()


def sketch(codes: np.ndarray, lone: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row, tokens by cell as bits from the lowest, and how many more there are than bits.

    ``codes`` are row * CELLS + cell of all tokens, ``lone`` those of the tokens that do not count. Two rows have at most
    as many tokens in common as bits, and the smaller number of what is over.
    """
    codes, count = np.unique(codes, return_counts=True)
    count -= np.bincount(np.searchsorted(codes, lone), minlength=len(codes))
    row, cell = np.divmod(codes, CELLS)
    deep = np.minimum(count, DEEP)
    bits = np.zeros((rows, LONGS), np.uint64)
    place = DEEP * cell
    np.bitwise_or.at(bits, (row, place // 64), ((1 << deep) - 1).astype(np.uint64) << (place % 64).astype(np.uint64))
    return bits.view(np.int64), np.bincount(row, count - deep, rows).astype(np.int64)


def linkable(docs: DataFrame, tasks: int, least: int, key: str, text: str, sketched: bool = False) -> DataFrame:
    """doc_id, n_shingles of the rows that may link: other rows hold ``least`` percent of their tokens or more.

    ``docs`` holds a row of every distinct set; further copies only make it keep more. Tokens are
    compared by 40 bits and their task, so hashes that meet keep more too. ``sketched`` adds the sketch of
    the tokens that other rows hold: s0, s1, .., over.
    """
    targets = tasks * FINE
    cells = CELLS if sketched else 1
    parts_schema = "target int, tokens binary, block long, rows binary, ids binary, sizes binary, codes binary, parts int"
    names = [x.split()[0] for x in parts_schema.split(", ")]
    sketch_names = [*[f"s{i}" for i in range(LONGS)], "over"] if sketched else []

    def cell_of(value: np.ndarray) -> np.ndarray:
        return (value & np.uint64(cells - 1)).astype(np.int64)

    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], number: int) -> pa.RecordBatch:
        ids, tokens, sizes = (np.concatenate(x) for x in zip(*held))
        value = blocks.mix(tokens ^ np.uint64(0xB10C))
        order = np.argsort(value, kind="stable")
        codes = np.sort(np.repeat(np.arange(len(ids)), sizes) * cells + cell_of(value)) if sketched else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
        alone = np.diff(np.append(starts, len(order))) == 1
        row = np.where(alone, np.repeat(np.arange(len(ids)), sizes)[order[starts]], SEVERAL)
        value = value[order[starts]]
        target = ((value >> np.uint64(40)) % np.uint64(targets)).astype(np.int64)
        order = np.lexsort((row, target))
        target, row, value = target[order], row[order], value[order]
        cuts = np.flatnonzero(np.diff(target, prepend=-1))
        ends = np.append(cuts[1:], len(target))
        # a retried task that met other rows gives its block another name
        place = np.array([TaskContext.get().partitionId() + 1, number + 1], np.uint64)
        name = blocks.mix(blocks.mix(place * np.uint64(blocks.ROOT)).cumsum()[-1:] + value.sum() + blocks.mix(ids.view(np.uint64)).sum()).view(np.int64)[0]
        first = lambda x: [x] + [None] * (len(cuts) - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(target[cuts].astype(np.int32)),
                pa.array([planes(value[a:b], 5) for a, b in zip(cuts, ends)], pa.binary()),
                pa.array(np.full(len(cuts), name)),
                # rows ascend: steps compress
                pa.array([planes(np.diff(row[a:b], prepend=0), 4) for a, b in zip(cuts, ends)], pa.binary()),
                pa.array(first(planes(ids.view(np.uint64), 8)), pa.binary()),
                pa.array(first(planes(sizes, 4)), pa.binary()),
                pa.array(first(planes(np.diff(codes, prepend=0), 8)), pa.binary()),
                pa.array(first(len(cuts)), pa.int32()),
            ],
            names,
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, tokens, offsets in set_block(batch.column(1)):
                held.append((ids[first:last], tokens, np.diff(offsets)))
                size += len(tokens)
                if size >= PER_BLOCK:
                    yield pack(held, number)
                    held, size, number = [], 0, number + 1
        if size:
            yield pack(held, number)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every block, the rows of its tokens that no other block holds."""
        tokens, rows, heads = [], [], []
        for batch in batches:
            for target, raw, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3)):
                tokens.append(from_planes(raw.as_py(), 5) | np.uint64(target << 40))
                rows.append(np.cumsum(from_planes(row.as_py(), 4)).astype(np.uint32))
            heads.append(batch.select([2, 4, 5, 6, 7]))
        if not tokens:
            return
        part = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        tokens, rows = np.concatenate(tokens), np.concatenate(rows)
        order = np.argsort(tokens)
        ordered = tokens[order]
        other = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        lone = np.sort(order[other[1:] & other[:-1]])  # parts and rows ascend as they came
        lone = lone[rows[lone] != SEVERAL]
        at = np.searchsorted(part[lone], np.arange(part[-1] + 2))
        codes = rows[lone].astype(np.int64) * cells + cell_of(tokens[lone])
        found = pa.array([planes(np.diff(np.sort(codes[a:b]), prepend=0), 8 if sketched else 4) for a, b in zip(at[:-1], at[1:])], pa.binary())
        del tokens, ordered, order, other
        done = 0
        for head in heads:
            yield pa.RecordBatch.from_arrays([head.column(0), found.slice(done, head.num_rows), *[head.column(i) for i in (1, 2, 3, 4)]], names[2:])
            done += head.num_rows
        blocks.give_back()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone, parts, heads, marked = {}, {}, {}, {}
        for batch in batches:
            for name, rows, ids, sizes, codes, n in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3, 4, 5)]):
                at = np.cumsum(from_planes(rows.as_py(), 8 if sketched else 4)).astype(np.int64)
                if sketched:
                    marked.setdefault(name, []).append(at)
                count = np.bincount(at // cells)
                before = lone.get(name, count[:0])
                short, long = sorted((count, before), key=len)
                lone[name] = long = long.copy()
                long[: len(short)] += short
                parts[name] = parts.get(name, 0) + 1
                if n.is_valid:
                    heads[name] = from_planes(ids.as_py(), 8).view(np.int64), from_planes(sizes.as_py(), 4).astype(np.int64), n.as_py()
                    heads[name] += (np.cumsum(from_planes(codes.as_py(), 8)).astype(np.int64),)
        for name, count in lone.items():
            if name not in heads or heads[name][2] != parts[name]:
                raise RuntimeError("a repeated task met its rows in another order; run the join again")
            ids, sizes, _, codes = heads[name]
            shared = sizes.copy()
            shared[: len(count)] -= count
            keep = (sizes > 0) & (100 * shared >= least * sizes)
            more = []
            if sketched:
                bits, over = sketch(codes, np.concatenate(marked[name]), len(ids))
                more = [pa.array(x[keep]) for x in (*bits.T, over)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(sizes[keep]), *more], ["doc_id", "n_shingles", *sketch_names])
        blocks.give_back()

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text).filter("doc_id is not null")
    dealt = rows.mapInArrow(deal, parts_schema).repartition(tasks, "target")
    answers = dealt.mapInArrow(answer, parts_schema.split("binary, ", 1)[1])
    return answers.repartition(tasks, "block").mapInArrow(decide, ", ".join(f"{x} long" for x in ("doc_id", "n_shingles", *sketch_names)))


class Segmented:
    """The signatures of a block of sets in their own band (``step`` 0) or the next (1)."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, ends: np.ndarray, fineness: int, step: int):
        sizes = np.diff(offsets)
        band = np.searchsorted(ends, sizes, "right") - 1 + step
        if step:  # the next band only where a partner can be that large
            out = sizes * 4 // 3 < ends[band]
        else:
            out = sizes == 0
        self.rows = np.flatnonzero(~out)
        keep = np.repeat(~out, sizes)
        self.tokens = tokens[keep]
        self.sizes = sizes[self.rows]
        row = np.repeat(np.arange(len(self.rows)), self.sizes)
        parts = segments_of(ends, fineness)[band[self.rows]]
        salt = blocks.mix((band[self.rows] + 1).astype(np.uint64) * np.uint64(blocks.ROOT))
        spread = blocks.mix(self.tokens ^ salt[row])
        number = ((spread >> np.uint64(33)) * parts[row].astype(np.uint64)) >> np.uint64(31)
        before = np.concatenate([[0], np.cumsum(parts)])
        #: the segment of every token, numbered through all rows
        self.place = before[row] + number.astype(np.int64)
        self.count = np.bincount(self.place, minlength=before[-1])
        value = blocks.mix(self.tokens)
        self.value = value
        self.low = np.bincount(self.place, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), before[-1]).astype(np.uint64)
        self.high = np.bincount(self.place, (value >> np.uint64(32)).astype(np.float64), before[-1]).astype(np.uint64)
        self.row_of = np.repeat(np.arange(len(self.rows)), parts)
        self.number = np.arange(before[-1]) - before[self.row_of]
        self.name = blocks.mix(salt[self.row_of] + self.number.astype(np.uint64))
        # all segments of small sets, where tokens may crowd; few of large ones, where they do not
        self.designated = self.number < np.where(parts <= SMALL, parts, np.maximum(1, parts // 64))[self.row_of]
        self.keep = keep

    def signatures(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> np.ndarray:
        return blocks.mix(self.name[places] ^ blocks.mix(low + high * np.uint64(blocks.ROOT) + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, signature) of every segment with tokens."""
        places = np.flatnonzero(self.count)
        return places, self.signatures(places, self.low[places], self.high[places], self.count[places])

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, signature) of designated segments without one token; none becomes empty."""
        chosen = np.flatnonzero(self.designated[self.place] & (self.count[self.place] > 1))
        places, value = self.place[chosen], self.value[chosen]
        return places, self.signatures(
            places, self.low[places] - (value & np.uint64(0xFFFFFFFF)), self.high[places] - (value >> np.uint64(32)), self.count[places] - 1
        )

    def allocate(self, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which segments are indexed, which with their deletions; the signatures a partner shares at least.

        That number is under 1 for sets that are short.
        """
        weight = np.bincount(self.place, rare[self.keep].astype(np.float64), len(self.count))
        rows = len(self.rows)
        need = self.sizes * 2 // 7 + 1
        places = np.flatnonzero(self.count)
        row = self.row_of[places]
        good = weight[places] > 0
        n_good = np.bincount(row[good], minlength=rows)
        twice = self.designated & (self.count > 1)
        n_twice = np.bincount(self.row_of[twice], minlength=rows)
        scarce = n_good < need
        wanted = np.where(scarce, np.maximum(need - n_twice, n_good), np.minimum(n_good, need + MORE))
        order = np.lexsort((-weight[places], row))
        rank = np.empty(len(places), np.int64)
        first = np.searchsorted(row, np.arange(rows))  # places ascend by row
        rank[order] = np.arange(len(places)) - first[row[order]]
        chosen = np.zeros(len(self.count), bool)
        chosen[places[rank < wanted[row]]] = True
        twice &= scarce[self.row_of]
        chosen |= twice
        units = np.bincount(self.row_of[chosen], minlength=rows) + np.bincount(self.row_of[twice], minlength=rows)
        return chosen, twice, np.clip(units - need + 1, 0, 255)


def rare_tokens(tokens: np.ndarray) -> np.ndarray:
    """Which tokens at most ``COMMON`` rows of the block hold."""
    order = np.argsort(tokens)
    ordered = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    uses = np.diff(np.concatenate([starts, [len(ordered)]]))
    out = np.empty(len(tokens), bool)
    out[order] = np.repeat(uses <= COMMON, uses)
    return out


def emit(docs: DataFrame, ends: np.ndarray, fineness: int, targets: int, key: str, text: str) -> DataFrame:
    """(target, signatures, members): packed signatures of every distinct set of a task.

    A member is a doc_id and, where the set indexes the signature, the number of signatures that a partner
    shares with it (else 0). A set that is short comes as a row with a null target.
    """

    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        signatures, members, least = (np.concatenate(x) for x in zip(*held))
        target = ((signatures >> np.uint64(40)) % np.uint64(targets)).astype(np.uint32)
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
        parts = np.append(cuts, len(order))
        raw = signatures[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        who = np.concatenate([members[order].astype("<i8").view(np.uint8).reshape(-1, 8), least[order].astype(np.uint8)[:, None]], axis=1)
        # byte by byte: the upper bytes of ids are alike and compress to nothing
        return pa.RecordBatch.from_arrays(
            [
                pa.array(target[order][cuts].astype(np.int32)),
                pa.array([raw[a:b].T.tobytes() for a, b in zip(parts[:-1], parts[1:])], pa.binary()),
                pa.array([who[a:b].T.tobytes() for a, b in zip(parts[:-1], parts[1:])], pa.binary()),
            ],
            ["target", "signatures", "members"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, n_short = [], 0, set(), 0
        for stretch in stretches(batches, seen):
            rare = rare_tokens(np.concatenate([x[1] for x in stretch]))
            for own, tokens, offsets in stretch:
                near, rare = rare[: len(tokens)], rare[len(tokens) :]
                s = Segmented(tokens, offsets, ends, fineness, 0)
                chosen, twice, least = s.allocate(near)
                n_short += int((least < 1).sum())
                for part, flags in ((s.exact(), chosen), (s.deletions(), twice)):
                    row = s.row_of[part[0]]
                    held.append((part[1], own[s.rows[row]], np.where(flags[part[0]], least[row], 0)))
                s = Segmented(tokens, offsets, ends, fineness, 1)
                for places, signatures in (s.exact(), s.deletions()):
                    held.append((signatures, own[s.rows[s.row_of[places]]], np.zeros(len(places), np.int64)))
                size += sum(len(x[0]) for x in held[-4:])
                if size >= PER_BLOCK:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)
        if n_short:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["target", "signatures", "members"])

    def stretches(batches: Iterator[pa.RecordBatch], seen: set) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Blocks of (ids, tokens, offsets) of sets that the task has not met, ``STRETCH`` tokens at a time."""
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, tokens, offsets in set_block(batch.column(1)):
                # copies that the task has met need no signatures of their own: their class links them
                prints = row_sums(blocks.mix(tokens ^ np.uint64(0xA5)), offsets), row_sums(blocks.mix(tokens ^ np.uint64(0x5A5A)), offsets)
                new = np.array([p not in seen and not seen.add(p) for p in zip(prints[0].tolist(), prints[1].tolist())], bool)
                sizes = np.diff(offsets)
                tokens, offsets = tokens[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])])
                own = ids[first:last][new].astype(np.int64)
                held.append((own, tokens, offsets))
                size += len(tokens)
                if len(seen) > 100_000:
                    seen.clear()
                if size >= STRETCH:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text).filter("doc_id is not null")
    return rows.mapInArrow(run, "target int, signatures binary, members binary")


def groups(packed: DataFrame, tasks: int) -> DataFrame:
    """g, doc_id, least, times: sets that share ``times`` signatures which one of them indexes.

    ``least`` is 0 for a member that does not index them, else what a partner shares with it at least.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, members, leasts, short = [], [], [], False
        for batch in batches:
            for target, raw, who in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if target is None:
                    short = True
                    continue
                low = np.frombuffer(raw.as_py(), np.uint8).reshape(5, -1)
                wide = np.zeros((low.shape[1], 8), np.uint8)
                wide[:, :5] = low.T
                signatures.append(wide.view("<u8").ravel() | np.uint64(target << 40))
                who = np.frombuffer(who.as_py(), np.uint8).reshape(9, -1)
                members.append(who[:8].T.copy().view("<i8").ravel())
                leasts.append(who[8])
        if short:
            yield pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], names)
        if not signatures:
            return
        signatures, members, leasts = np.concatenate(signatures), np.concatenate(members), np.concatenate(leasts)
        order = np.argsort(signatures)
        signatures, members, leasts = signatures[order], members[order], leasts[order]
        new = np.concatenate([[True], signatures[1:] != signatures[:-1]])
        shared = np.repeat(np.diff(np.append(np.flatnonzero(new), len(new))) > 1, np.diff(np.append(np.flatnonzero(new), len(new))))
        signatures, members, leasts = signatures[shared], members[shared], leasts[shared]
        # a set once per group, as indexed if it is so by any of its signatures
        order = np.lexsort((255 - leasts, members, signatures))
        signatures, members, leasts = signatures[order], members[order], leasts[order]
        once = np.concatenate([[True], (signatures[1:] != signatures[:-1]) | (members[1:] != members[:-1])]) if len(members) else np.zeros(0, bool)
        signatures, members, leasts = signatures[once], members[once], leasts[once]
        if not len(members):
            return
        starts = np.flatnonzero(np.concatenate([[True], signatures[1:] != signatures[:-1]]))
        offsets = np.append(starts, len(members))
        size = np.diff(offsets)
        name = row_sums(blocks.mix(blocks.mix(members.view(np.uint64)) + leasts), offsets) + size.astype(np.uint64)
        use = (size > 1) & (np.maximum.reduceat(leasts, starts) > 0)
        _, first, times = np.unique(np.where(use, name, np.uint64(0)), return_index=True, return_counts=True)
        kept = np.zeros(len(name), np.int64)
        kept[first] = times
        kept[~use] = 0
        keep = np.repeat(kept > 0, size)
        # groups of different tasks stay apart: their signatures add up
        task = blocks.mix(np.array([TaskContext.get().partitionId() + 1], np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(name ^ task, size)[keep].view(np.int64)), pa.array(members[keep]), pa.array(leasts[keep].astype(np.int32)), pa.array(np.repeat(kept, size)[keep])], names
        )
        del signatures, members, leasts, order
        blocks.give_back()

    names = ["g", "doc_id", "least", "times"]
    return packed.repartition(tasks, "target").mapInArrow(gather, "g long, doc_id long, least int, times long")


def tasks_for(tokens: int | None) -> int:
    return max(1, -(-(tokens or 0) // PER_TASK))


def token_sets(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, tokens (packed) of the chosen ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, tokens, offsets in set_block(batch.column(1)):
                raw = tokens.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    ["doc_id", "tokens"],
                )

    rows = semi(docs.select(F.col(key).cast("long").alias("doc_id"), text), chosen, "doc_id")
    return rows.mapInArrow(run, "doc_id long, tokens binary")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_py(), "<u8"), np.frombuffer(two.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                hold.append(bool(len(x)) and 100 * common >= least * (len(x) + len(y) - common))
            keep = pa.array(hold, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "verify-ids")
    sets = durable(token_sets(docs, ids, key, text), "verify-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long").distinct()


def join_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    if least < LEAST:
        raise ValueError(f"the bands and bounds hold from {LEAST} on")
    sets = durable(describe(docs, key, text), "sets")
    totals = sets.agg(F.sum("n_shingles").alias("tokens"), F.max("n_shingles").alias("largest")).first()
    ends = bands(totals["largest"] or 1)
    classes = durable(
        sets.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes",
    )
    # copies: every id under its class's smallest id, so that groups are groups of classes
    member = sets.filter("n_shingles > 0 and doc_id is not null").join(classes.filter("copies > 1"), ["n_shingles", "f1", "f2"])
    copies = durable(member.select("doc_id", "rep").filter("doc_id <> rep").distinct(), "copies")
    # an id that repeats may stand for a class of its own beside: its signatures count for that node too
    own = copies.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    nodes = durable(copies.unionByName(own.select("doc_id", F.col("doc_id").alias("rep"))), "nodes")
    # one row of each class is enough to index, unless its id repeats
    spare = durable(copies.select("doc_id").distinct().join(own, "doc_id", "left_anti"), "spare")
    single = semi(docs.withColumn("doc_id", F.col(key).cast("long")), spare, "doc_id", "left_anti")
    alive = durable(linkable(single, tasks_for(totals["tokens"]), least, "doc_id", text), "linkable")
    tasks = tasks_for(alive.agg(F.sum("n_shingles").alias("n")).first()["n"])
    some = semi(single, durable(alive.select("doc_id").distinct(), "linkable-ids"), "doc_id")
    fineness = 1
    while True:
        shared = durable(groups(emit(some, ends, fineness, tasks * FINE, "doc_id", text), tasks), "groups")
        if not shared.filter("g is null").limit(1).count():
            break
        fineness *= 2
    sizes = classes.select(F.col("rep").alias("of_rep"), F.col("n_shingles").alias("n")).groupBy("of_rep").agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"))
    # of a class, the members of a group count once; any of its documents' bounds holds
    rows = durable(
        shared.join(nodes, "doc_id", "left").select("g", F.coalesce("rep", "doc_id").alias("node"), "least", "times")
        .groupBy("g", "node").agg(F.max("least").alias("least"), F.max("times").alias("times"))
        .join(sizes, F.col("node") == F.col("of_rep")).drop("of_rep"), "groups",
    )

    def size_fits(x: str, y: str) -> Column:
        """Whether ``y`` may be the smaller set of a linked pair."""
        return (F.col(f"{x}_most") >= F.col(f"{y}_least")) & (F.col(f"{y}_most") * 100 >= F.col(f"{x}_least") * least)

    def side(table: DataFrame, name: str, *more: str) -> DataFrame:
        return table.select("g", F.col("node").alias(name), F.col("n_least").alias(f"{name}_least"), F.col("n_most").alias(f"{name}_most"), *more)

    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    # first: every class with the hub of most of its signatures
    hubs = rows.groupBy("g").agg(F.min(F.struct("node", "n_least", "n_most")).alias("h"), F.count("*").alias("n")).filter("n > 1").select("g", "h.*")
    spokes = side(rows, "x", "times").join(side(hubs, "y"), "g").filter("x <> y").filter(size_fits("x", "y") | size_fits("y", "x"))
    votes = spokes.groupBy("x", "y").agg(F.sum("times").alias("votes"))
    best = votes.groupBy("x").agg(F.max(F.struct("votes", (-F.col("y")).alias("back"))).alias("p")).select("x", (-F.col("p.back")).alias("y"))
    tried = durable(best.select(*ordered).distinct(), "pairs")
    found = durable(verified(tried, docs, key, text, least), "found")
    # repeated ids tie their classes together
    same = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(found.unionByName(same))
    number = 0
    while True:
        labelled = durable(rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
        parts = labelled.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(
            F.sum("c").alias("n"), (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("across")
        ).filter("across > 0")
        parts = durable(parts, "mixed")
        open_rows = durable(labelled.join(parts.select("g"), "g", "left_semi"), "open")
        sums = parts.agg(F.sum("n").alias("n"), F.sum("across").alias("across")).first()
        if not sums["n"] or sums["across"] <= FEW * sums["n"]:
            break
        # other hubs: of every group, the members that come first under a few hashes
        firsts = [
            F.min(F.struct(F.xxhash64("node", F.lit(number * HUBS + i)).alias("h"), "node", "n_least", "n_most", "component")).alias(f"h{i}")
            for i in range(HUBS)
        ]
        some = open_rows.groupBy("g").agg(*firsts).select(
            "g", F.inline(F.array(*[F.struct(F.lit(i).alias("salt"), F.col(f"h{i}.node"), F.col(f"h{i}.n_least"), F.col(f"h{i}.n_most"), F.col(f"h{i}.component")) for i in range(HUBS)]))
        )
        spokes = side(open_rows, "x", "times", F.col("component").alias("cx")).join(side(some, "y", "salt", F.col("component").alias("cy")), "g")
        spokes = spokes.filter((F.col("cx") != F.col("cy")) & (size_fits("x", "y") | size_fits("y", "x")))
        votes = spokes.groupBy("salt", "x", "y").agg(F.sum("times").alias("votes"))
        best = votes.groupBy("salt", "x").agg(F.max(F.struct("votes", (-F.col("y")).alias("back"))).alias("p")).select("x", (-F.col("p.back")).alias("y"))
        fresh = durable(best.select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        joined = durable(verified(fresh, docs, key, text, least), "found")
        tried, number = tried.unionByName(fresh), number + 1
        gained, asked = joined.count(), fresh.count()
        if gained:
            label = components(joined.unionByName(label.toDF("a", "b")))
        # a group within one component stays so
        rows = open_rows.drop("component")
        if gained * 5 < asked or not asked:
            labelled = durable(rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
            mixed = labelled.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("g")
            open_rows = durable(labelled.join(mixed, "g", "left_semi"), "open")
            break
    # then: what shares enough signatures across components, and by the sketches can share enough tokens, but for pairs already compared
    ids = durable(open_rows.select(F.col("node").alias("doc_id")).distinct(), "open-ids")
    marks = linkable(semi(single, ids, "doc_id"), tasks, least, "doc_id", text, sketched=True)
    marks = marks.groupBy(F.col("doc_id").alias("node")).agg(*[F.bit_or(f"s{i}").alias(f"s{i}") for i in range(LONGS)], F.max("over").alias("over"))
    open_rows = open_rows.join(durable(marks, "sketches"), "node")
    sketch_of = lambda name: [*[F.col(f"s{i}").alias(f"{name}{i}") for i in range(LONGS)], F.col("over").alias(f"{name}_over")]
    common = sum((F.bit_count(F.col(f"x{i}").bitwiseAND(F.col(f"y{i}"))) for i in range(LONGS)), F.least("x_over", "y_over"))
    enough = common * (100 + least) >= (F.col("x_least") + F.col("y_least")) * least
    left = side(open_rows.filter("least > 0"), "x", "least", "times", F.col("component").alias("cx"), *sketch_of("x"))
    right = side(open_rows, "y", F.col("component").alias("cy"), *sketch_of("y"))
    pairs = left.join(right, "g").filter((F.col("cx") != F.col("cy")) & size_fits("x", "y") & enough).groupBy("x", "y").agg(
        F.sum("times").alias("shared"), F.min("least").alias("least")
    ).filter("shared >= least").select(*ordered).distinct()
    rest = durable(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        joined = durable(verified(rest, docs, key, text, least), "found")
        label = components(joined.unionByName(label.toDF("a", "b")))
    label = label.select(F.col("node").alias("of_node"), "component")
    return (
        sets.join(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left")
        .withColumn("of_node", F.coalesce("rep", "doc_id")).join(label, "of_node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "of_node").alias("component_id"))
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; rows without an id stay."""
    found = join_classes(docs, key, text)
    gone = durable(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "near-copies")
    return semi(docs, gone, key, "left_anti")
