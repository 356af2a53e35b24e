"""Interpolated modified Kneser-Ney over words and characters, as tables that grow with the corpus.

A token is a run of letters and digits or a run of marks, with the single space before it; every other white
space is a token, and so is every character of three bytes and more (scripts written without spaces). A new
token is spelt by the letter model of ``kneser``, each byte drawn evenly from its class. Every text stands
between two tokens that begin it and one that ends it.

The model is one table (key, value). Log probability of a token by the interpolated model is the sum of what its grams
add to the order below, so a text's is the sum over its spelling and over those of its grams that the model holds:

- a gram adds log p(w | context) - log p(w | shorter context) - log spare(context),
- a context adds log spare(context), whichever token follows.

Grams of texts are counted per block and travel packed, one binary row per block and target: every gram once, and the texts
of the block that hold it. The model's grams go to the same targets, where they meet and are added up per text. Grams
that no bit of a map of fixed size names are not sent; a map too small for the model only sends more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks
from tripsearch.storage import durable, release

BEGIN, END = np.uint64(0xB0), np.uint64(0xE0)
#: Bits of the map of the model's grams: at least this and at most that power of two.
LEAST_BITS, MOST_BITS = 15, 28
#: Parts by key in which grams get their shares and values, and in which texts' grams meet the model: one
#: part travels at a time, and what it has sent goes before the next.
MODEL_PARTS, TEXT_PARTS = 4, 3
#: Grams of the model and bytes of text per target, and bytes of text per block.
GRAMS_PER_TARGET, TEXT_PER_TARGET, BLOCK = 1_000_000, 12 << 20, 4 << 20
#: Keys that one partial map of bits takes in at least.
KEYS_PER_MAP = 2_000_000
Spelling = Callable[[np.ndarray, np.ndarray], np.ndarray]


def token_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all tokens, and the end. Tokens tile the texts."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    table = np.zeros(256, np.uint8)  # letters and digits 0, marks 1, white space 2, characters of three bytes and more 3
    table[[b for b in range(128) if not chr(b).isalnum()]] = 1
    table[list(blocks.SPACES)] = 2
    table[0xE0:] = 3
    new = np.zeros(n, bool)
    new[offsets[:-1][offsets[:-1] < n]] = True
    inside = (data & 0xC0) == 0x80
    lead = np.maximum.accumulate(np.where(inside & ~new, 0, np.arange(n)))
    kind = table[data[lead]]
    start = new.copy()
    start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | ((kind[1:] == 3) & ~inside[1:])
    # the space before a run goes with it
    start[1:] &= new[1:] | ~((data[:-1] == ord(" ")) & (kind[1:] != 2))
    return np.append(np.flatnonzero(start), n)


def single_keys(tokens: np.ndarray) -> np.ndarray:
    return blocks.mix(tokens * np.uint64(blocks.ROOT) + np.uint64(1))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return blocks.mix(first * np.uint64(blocks.ROOT * 3 % 2**64) + second + np.uint64(2))


def triple_keys(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """By the keys of its first two and its last two tokens."""
    return blocks.mix(front * np.uint64(blocks.ROOT * 5 % 2**64) + back + np.uint64(3))


def positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all places of texts that are not empty, the second of the beginning first: row, its token (-1 without), the keys of
    the grams of one, two and three tokens that end there, and whether a token is foretold there."""
    at = token_offsets(data, offsets)
    words = blocks.word_hashes(data, at[:-1], at[1:]) if len(data) else np.zeros(0, np.uint64)
    rows = np.flatnonzero(np.diff(offsets))
    count = np.diff(np.searchsorted(at, offsets))[rows]
    first = np.concatenate([[0], np.cumsum(count + 3)])
    seq = np.full(first[-1], BEGIN, np.uint64)
    token = np.full(first[-1], -1, np.int64)
    place = np.repeat(first[:-1] + 2 - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(len(words))
    seq[place], token[place] = words, np.arange(len(words))
    seq[first[1:] - 1] = END
    one = single_keys(seq)
    two, three = one.copy(), one.copy()
    two[1:] = pair_keys(one[:-1], one[1:])
    three[1:] = triple_keys(two[:-1], two[1:])
    row = np.repeat(rows, count + 3)
    foretold = np.ones(len(seq), bool)
    foretold[first[:-1]] = foretold[first[:-1] + 1] = False
    use = np.ones(len(seq), bool)
    use[first[:-1]] = False
    return row[use], token[use], one[use], two[use], three[use], foretold[use]


def spelt(data: np.ndarray, offsets: np.ndarray, token: np.ndarray, spelling: Spelling) -> np.ndarray:
    """Log probability of the spelling of every place's token; the end is a token without letters."""
    at = token_offsets(data, offsets)
    values = np.append(spelling(data, at), spelling(data[:0], np.zeros(2, np.int64)))
    return values[token]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """k0, c2, k1 (the keys of its tokens), n of every gram of three tokens over every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = single_keys(np.array([BEGIN]))[0]
        for batch in batches:
            for _, _, data, offsets in blocks.chunks(batch.column(0), 4 << 20):
                _, _, one, _, three, foretold = positions(data, offsets)
                seen = np.flatnonzero(foretold)
                _, first, n = np.unique(three[seen], return_index=True, return_counts=True)
                at = seen[first]
                # of a text's first gram, the first token is the beginning that positions leave out
                keys = np.where(foretold[at - 1], one[at - 2], begin), one[at - 1], one[at]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in keys], pa.array(n)], ["k0", "c2", "k1", "n"])

    found = docs.select("text").mapInArrow(count, "k0 long, c2 long, k1 long, n long")
    return found.groupBy("k0", "c2", "k1").agg(F.sum("n").alias("n"))


def spellings(docs: DataFrame, spelling: Spelling) -> DataFrame:
    """k1, spelling of every token."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks.chunks(batch.column(0), 4 << 20):
                _, token, one, *_, foretold = positions(data, offsets)
                seen = np.flatnonzero(foretold)
                keys, first = np.unique(one[seen], return_index=True)
                values = spelt(data, offsets, token[seen[first]], spelling)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values)], ["k1", "spelling"])

    found = docs.select("text").mapInArrow(spell, "k1 long, spelling double")
    return found.groupBy("k1").agg(F.first("spelling").alias("spelling"))


def in_part(key: Column, part: int, parts: int) -> Column:
    return F.shiftrightunsigned(key, 40) % parts == part


def with_keys(trigrams: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """k3, c3 (its first two), k2 (its last two), c2, k1 (the second, the last token), n, of the grams whose c3 is in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            front = pair_keys(a, b)
            use = (front >> np.uint64(40)) % np.uint64(parts) == part
            front, b, c = front[use], b[use], c[use]
            back = pair_keys(b, c)
            keys = [pa.array(x.view(np.int64)) for x in (triple_keys(front, back), front, back, b, c)]
            yield pa.RecordBatch.from_arrays([*keys, batch.column(3).filter(pa.array(use))], ["k3", "c3", "k2", "c2", "k1", "n"])

    return trigrams.select("k0", "c2", "k1", "n").mapInArrow(run, "k3 long, c3 long, k2 long, c2 long, k1 long, n long")


def with_pair_key(pairs: DataFrame, part: int, parts: int) -> DataFrame:
    """k2 of c2, k1 beside n, where k2 is in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pair_keys(*(batch.column(i).to_numpy().view(np.uint64) for i in range(2)))
            out = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["k2", "c2", "k1", "n"])
            yield out.filter(pa.array((key >> np.uint64(40)) % np.uint64(parts) == part))

    return pairs.select("c2", "k1", "n").mapInArrow(run, "k2 long, c2 long, k1 long, n long")


def model(trigrams: DataFrame, spelt_tokens: DataFrame, discounts: Callable[[DataFrame], list[float]]) -> tuple[DataFrame, float]:
    """(key, value) of every gram and context, and the log spare of the order without context."""
    three = durable(trigrams, "grams-3")  # only the tokens travel and are kept
    # lower orders count the tokens seen before a gram, not its uses
    two = durable(three.groupBy("c2", "k1").agg(F.count("*").alias("n")), "grams-2")
    one = durable(two.groupBy("k1").agg(F.count("*").alias("n")).join(spelt_tokens, "k1"), "grams-1")

    def cutter(counts: DataFrame) -> Callable[[DataFrame], DataFrame]:
        d1, d2, d3 = discounts(counts)
        return lambda rows: rows.withColumn("cut", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))

    def contexts(counts: DataFrame, by: str) -> DataFrame:
        sums = counts.groupBy(by).agg(F.sum("n").alias("total"), F.sum("cut").alias("taken"))
        return durable(sums.select(F.col(by).alias("of"), "total", (F.col("taken") / F.col("total")).alias("spare")), "contexts")

    one, cut_two, cut_three = cutter(one)(one), cutter(two), cutter(three)
    sums = one.agg(F.sum("n").alias("total"), F.sum("cut").alias("taken")).first()  # one row
    if not sums["total"]:
        return one.select(F.col("k1").alias("key"), F.lit(0.0).alias("value")), 0.0
    spare = sums["taken"] / sums["total"]
    p = (F.col("n") - F.col("cut")) / F.lit(float(sums["total"])) + F.lit(spare) * F.exp("spelling")
    one = durable(one.select("k1", "spelling", p.alias("p1")), "model-1")
    of_two = contexts(cut_two(two), "c2")
    share = ((F.col("n") - F.col("cut")) / F.col("total")).alias("share")
    p = lambda lower: F.col("share") + F.col("spare") * F.col(lower)
    value = lambda lower: (F.log(p(lower)) - F.log(lower) - F.log("spare")).cast("float").alias("value")
    pairs = []
    for part in range(MODEL_PARTS):
        rows = cut_two(with_pair_key(two, part, MODEL_PARTS)).join(of_two, F.col("c2") == F.col("of")).select("k2", "k1", share, "spare")
        pairs.append(durable(rows.join(one.select("k1", "p1"), "k1").select("k2", p("p1").alias("p2"), value("p1")), "model-2"))
    release(two)
    of_three, shares = [], []
    for part in range(MODEL_PARTS):
        rows = cut_three(with_keys(three, part, MODEL_PARTS).select("k3", "c3", "k2", "n"))
        of_three.append(contexts(rows, "c3"))
        joined = rows.join(of_three[-1], F.col("c3") == F.col("of")).select("k3", "k2", share, "spare")
        shares.append(durable(joined, "shares-3"))
    release(three)
    triples = []
    for part in range(MODEL_PARTS):
        mine = reduce(DataFrame.unionByName, shares).filter(in_part(F.col("k2"), part, MODEL_PARTS))
        met = mine.join(pairs[part].select("k2", "p2"), "k2")
        triples.append(durable(met.select("k3", value("p2")), "model-3"))
    release(*shares)
    parts = [
        one.select("k1", F.log("p1") - F.log(F.lit(spare)) - F.col("spelling")),
        *[x.select("k2", F.col("value").cast("double")) for x in pairs],
        *[x.select("k3", F.col("value").cast("double")) for x in triples],
        *[x.select("of", F.log("spare")) for x in (of_two, *of_three)],
    ]
    return reduce(DataFrame.unionByName, [x.toDF("key", "value") for x in parts]), float(np.log(spare))


def bit_map(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for every key, by its last bits (at most ``2 ** MOST_BITS`` of them for any model), and the number of keys."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    # few tasks: each sends a map of its own
    rows = keys.coalesce(1 + n // KEYS_PER_MAP)
    pages = rows.groupBy(F.shiftright(slot, 15).cast("int").alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("held"))
    pages = durable(pages, "bits")
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for page, held in pages.collect():  # at most 2 ** (MOST_BITS - 15) rows
        out[page] = np.frombuffer(held, np.uint8)
    release(pages)
    return out.ravel(), n


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 8 or 4 bytes, their lengths first, each as planes of like bytes: those compress."""
    lengths = np.array([len(columns), *[len(c) for c in columns], *[c.itemsize for c in columns]], np.uint32)
    return b"".join([lengths.tobytes(), *[np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]])


def unpacked(raw: bytes) -> list[np.ndarray]:
    """The columns, as unsigned numbers."""
    count = int(np.frombuffer(raw, np.uint32, 1)[0])
    head = np.frombuffer(raw, np.uint32, 2 * count, 4).tolist()
    out, at = [], 4 + 8 * count
    for length, width in zip(head[:count], head[count:]):
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += length * width
    return out


def targets_of(keys: np.ndarray, targets: int) -> np.ndarray:
    """Ascends with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(targets) >> np.uint64(24)).astype(np.int32)


def is_in(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    return (keys >> np.uint64(30)) % np.uint64(parts) == part


def pack_grams(keys: np.ndarray, row: np.ndarray, prints: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """(target, grams, number of rows that hold each, rows, uses, prints of the rows); ``row`` ascends among equal keys."""
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    pair = np.flatnonzero(new_key | np.concatenate([[True], row[1:] != row[:-1]]))
    uses, new_key, keys, row = np.diff(np.append(pair, len(keys))), new_key[pair], keys[pair], row[pair]
    target = targets_of(keys, targets)
    cuts = np.flatnonzero(np.diff(target, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        first = np.flatnonzero(new_key[a:b])
        held, place = np.unique(row[a:b], return_inverse=True)
        small = lambda x: x.astype(np.uint32)
        yield int(target[a]), packed(keys[a:b][first], small(np.diff(np.append(first, b - a))), small(place), small(uses[a:b]), prints[held])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, added: what the model's grams of a target's rows add to its texts."""
    texts, keys, values = [], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for batch in batches:
        for model, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
            if model:
                more = unpacked(raw.as_py())
                keys.append(more[0])
                values.append(more[1].view(np.float64))
            else:
                texts.append(raw.as_py())
    # a key is there as a gram and as a context
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.bincount(place, np.concatenate(values), len(keys))
    if not len(keys):
        return
    prints, sums = [], []
    for raw in texts:
        asked, rows, place, uses, own = unpacked(raw)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        value = np.where(keys[at] == asked, values[at], 0.0)
        prints.append(own)
        sums.append(np.bincount(place, np.repeat(value, rows) * uses, len(own)))
    if prints:
        one, place = np.unique(np.concatenate(prints), return_inverse=True)
        added = np.bincount(place, np.concatenate(sums), len(one))
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(added)], ["print", "added"])
    blocks.give_back()


def perplexities(docs: DataFrame, grams: DataFrame, log_spare: float, spelling: Spelling) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (null without bytes) of (doc_id, lang, text). Equal texts are scored together."""
    held, n_grams = bit_map(grams.select("key"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks.chunks(batch.column(3)):
                row, token, *_, foretold = positions(data, offsets)
                row, token = row[foretold], token[foretold]
                values = np.bincount(row, spelt(data, offsets, token, spelling) + log_spare, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in range(3)], pa.array(np.diff(offsets)), pa.array(values)], names)

    def sent(rows: list[tuple[int, bytes]], model: bool) -> pa.RecordBatch:
        target, raw = [x for x, _ in rows], [x for _, x in rows]
        return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array([model] * len(rows)), pa.array(raw, pa.binary())], ["target", "model", "grams"])

    def emit(batches: Iterator[pa.RecordBatch], part: int, targets: int) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(len(held) * 8 - 1)
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for first, last, data, offsets in blocks.chunks(batch.column(1), BLOCK):
                row, _, one, two, three, foretold = positions(data, offsets)
                keys, text = [], []
                for keys_of, row_of in ((one, row), (two, row), (three[foretold], row[foretold])):
                    slot = keys_of & mask
                    there = is_in(keys_of, part, TEXT_PARTS)
                    there &= (held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    keys.append(keys_of[there])
                    text.append(row_of[there])
                keys, text = np.concatenate(keys), np.concatenate(text)
                if len(keys):
                    yield sent(list(pack_grams(keys, text, prints[first:last], targets)), False)

    def emit_model(batches: Iterator[pa.RecordBatch], part: int, targets: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            use = is_in(keys, part, TEXT_PARTS)
            keys, values = keys[use], values[use]
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            target = targets_of(keys, targets)
            cuts = np.flatnonzero(np.diff(target, prepend=-1)).tolist()
            if cuts:
                yield sent([(int(target[a]), packed(keys[a:b], values[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)])], True)

    names = ["doc_id", "lang", "print", "n_bytes", "begun"]
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("print"), "text")
    begun = durable(rows.mapInArrow(begin, "doc_id long, lang string, print long, n_bytes long, begun double"), "spelt")
    n_bytes = begun.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    targets = 1 + max(n_grams // GRAMS_PER_TARGET, n_bytes // TEXT_PER_TARGET)
    sums, schema = [], "target int, model boolean, grams binary"
    for part in range(TEXT_PARTS):
        used = rows.select("print", "text").mapInArrow(lambda batches, part=part: emit(batches, part, targets), schema)
        model_part = grams.mapInArrow(lambda batches, part=part: emit_model(batches, part, targets), schema)
        met = used.unionByName(model_part).repartition(targets, "target").mapInArrow(add_up, "print long, added double")
        sums.append(durable(met.groupBy("print").agg(F.sum("added").alias("added")), "added"))
    added = reduce(DataFrame.unionByName, sums).groupBy("print").agg(F.sum("added").alias("added"))
    copies = begun.groupBy("print").agg(F.count("*").alias("copies"))
    added = durable(added.join(copies, "print").select("print", (F.col("added") / F.col("copies")).alias("added")), "added")
    mean = (F.col("begun") + F.coalesce("added", F.lit(0.0))) / F.col("n_bytes")
    release(*sums)
    return begun.join(added, "print", "left").select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-mean)).alias("perplexity"))
