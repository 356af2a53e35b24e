"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, digits and bytes over 127, A-Z lower-cased) are hashed into ``BUCKETS``
embeddings. Filters of several widths slide over the whole text; each keeps its largest response,
and a logistic layer weighs those. Every labelled document teaches, whole: four fifths of them (by a
hash of the id) the word counts and the network, the others calibrate the score and set, per language,
the threshold with the best F1. Scoring covers every document and reads nothing but its text.

Rows are dealt to shards of about ``SHARD_WORDS`` words by a hash of the id. In each of ``EPOCHS`` passes every
shard moves the same network by Adagrad over its own rows, and the moves are averaged, weighted by rows.
Counts and moves are whole numbers that Spark adds up, so the order of tasks does not show. What comes to the driver
is as large as the network, or as the ``2 * TOP / STEP`` levels that logits are counted by, for any corpus.

Defined results: null and empty texts are scored like a text without words. Without labels of both
kinds every score is the share of toxic labels (0 without labels). An id labelled both ways is toxic.
Languages without enough labels take the threshold over all languages, ``DEFAULT_THRESHOLD`` if there is none. Repeated rows
are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.llm import blocks
from tripsearch.llm.byids import semi
from tripsearch.ship import ship
from tripsearch.storage import durable

BUCKETS = 1 << 15
WIDTH = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Empty places after every row: a window may start at the first of them and stays in its row.
PAD = max(WIDTHS)
EPOCHS = 5
CERTAIN = 1.0
#: Embeddings move this much slower than filters: there are many of them and few labels.
CALM = 0.02
BATCH = 64
#: Words of a step of training; a longer text is a step of its own, walked in pieces of so many.
PIECE = 200_000
SHARD_WORDS = 2_000_000
#: One in so many documents is kept out of training to calibrate.
ASIDE = 5
#: Logits are counted by levels of ``STEP`` from ``-TOP`` to ``TOP``.
STEP = 0.001
TOP = 30
LEAST_SET = 20
DEFAULT_THRESHOLD = 0.3
#: Fractions of moves that are added up, and columns of the rows that carry them.
FIXED = 1 << 20
COLUMNS = 64
SCORE_BYTES = 1 << 20

_SPLIT = np.array([not (chr(b).isalnum() and b < 128 or b > 127) for b in range(256)])


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, ``PAD`` zeros after every row; the row offsets. Bucket 0 is the padding."""
    starts, ends, at = blocks.words(data, offsets, _SPLIT)
    hashes = blocks.word_hashes(data, starts, ends, fold=True, seed=2)
    rows = np.arange(len(offsets))
    out = np.zeros(len(starts) + PAD * (len(offsets) - 1), np.int32)
    row_of = np.repeat(rows[:-1], np.diff(at))
    out[np.arange(len(starts)) + PAD * row_of] = 1 + (hashes % np.uint64(BUCKETS - 1)).astype(np.int32)
    return out, at + PAD * rows


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.words[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in self.params()]

    def params(self) -> list[np.ndarray]:
        return [self.words, *self.filters, self.bias, self.out, self.base]

    def state(self) -> np.ndarray:
        """All that training moves, as one vector."""
        return np.concatenate([x.ravel() for x in (*self.params(), *self.squares)])

    def load(self, state: np.ndarray) -> None:
        first = 0
        for x in (*self.params(), *self.squares):
            x[...] = state[first : first + x.size].reshape(x.shape)
            first += x.size

    def start_from(self, seen: np.ndarray, rows: np.ndarray) -> None:
        """First embedding component and first filter: how much likelier a word is in toxic texts.

        ``seen`` counts, by label, the texts with a word, ``rows`` all texts.
        """
        share = np.log((seen + 0.5) / (rows[:, None] + 1))
        doubt = np.sqrt((1 / (seen + 0.5)).sum(axis=0))
        # what is left of the log ratio after CERTAIN standard errors: rare words prove little
        weight = np.clip(share[1] - share[0] - CERTAIN * doubt, 0, 4)
        weight[0] = 0
        self.words[:, 0] = weight
        self.filters[0][0, :, 0] = 0
        self.filters[0][0, 0, 0] = 1
        self.out[0] = 1

    def tables(self) -> np.ndarray:
        """Every word's response in every place of every filter, side by side."""
        return np.concatenate([self.words @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def responses(self, table: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Per width, the responses at every place; they end ``PAD`` places early."""
        n, first = len(ids) - PAD, 0
        for i, w in enumerate(WIDTHS):
            z = np.broadcast_to(self.bias[i], (n, FILTERS)).copy()
            for j in range(w):
                z += table[ids[j : j + n], (first + j) * FILTERS : (first + j + 1) * FILTERS]
            first += w
            yield z

    def logits(self, table: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        tail = np.concatenate([ids, np.zeros(PAD, np.int32)])
        best = []
        for z in self.responses(table, tail):
            for back in range(1, PAD):
                z[offsets[1:] - back] = -np.inf  # windows that would start there reach into the next row
            best.append(np.maximum.reduceat(z, offsets[:-1], axis=0))
        return np.maximum(np.concatenate(best, axis=1), 0) @ self.out + self.base

    def scores(self, table: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(table, ids, offsets) + self.shift, -30, 30)))

    def peaks(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the largest response of every filter, and where its window starts; ``PAD`` places end ``flat``."""
        best = place = None
        for first in range(0, len(flat) - PAD, PIECE):
            part = flat[first : first + PIECE + PAD]
            table = self._rows_table(part)
            # more rows than one are one piece; windows that would start at a row's last places reach into the next
            ends = np.minimum(offsets[1:] - PAD + 1 - first, len(part) - PAD)
            starts = np.maximum(offsets[:-1] - first, 0)
            if ends[0] <= starts[0]:
                break
            tops, places = [], []
            for z in self.responses(table, np.arange(len(part))):
                at = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                tops.append(np.take_along_axis(z, at, axis=0))
                places.append(at + first)
            tops, places = np.concatenate(tops, axis=1), np.concatenate(places, axis=1)
            if best is None:
                best, place = tops, places
            else:
                best, place = np.maximum(best, tops), np.where(tops > best, places, place)
        return best, place

    def train(self, ids: list[np.ndarray], labels: np.ndarray, number: int = 0, rate: float = 0.05) -> None:
        """One pass of Adagrad over shuffled batches; the maximum passes its gradient to one window."""
        params, squares = self.params(), self.squares
        for rows in batches_of(np.random.default_rng(11 + number).permutation(len(ids)), ids):
            offsets = np.concatenate([[0], np.cumsum([len(ids[r]) for r in rows])])
            flat = np.concatenate([*(ids[r] for r in rows), np.zeros(PAD, np.int32)])
            top, places = self.peaks(flat, offsets)
            features = np.maximum(top, 0)
            error = 1 / (1 + np.exp(-np.clip(features @ self.out + self.base, -30, 30))) - labels[rows]
            error = (error / len(rows)).astype(np.float32)
            back = np.where(top > 0, error[:, None] * self.out, 0)
            grads, sums, touched, moves = [], [], [], []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(self.filters[i])
                for j in range(w):
                    word = flat[places[:, i * FILTERS : (i + 1) * FILTERS] + j]
                    grad[j] = np.einsum("rfd,rf->df", self.words[word], g)
                    touched.append(word.ravel())
                    moves.append((g[:, :, None] * self.filters[i][j].T[None]).reshape(-1, WIDTH))
                grads.append(grad)
                sums.append(g.sum(axis=0))
            grads += [np.stack(sums), features.T @ error, error.sum(keepdims=True)]
            seen, where = np.unique(np.concatenate(touched), return_inverse=True)
            move = np.zeros((len(seen), WIDTH), np.float32)
            np.add.at(move, where, np.concatenate(moves))
            move[seen == 0] = 0
            squares[0][seen] += move**2
            self.words[seen] -= CALM * rate * move / np.sqrt(squares[0][seen])
            for p, s, g in zip(params[1:], squares[1:], grads):
                s += g**2
                p -= rate * g / np.sqrt(s)

    def _rows_table(self, flat: np.ndarray) -> np.ndarray:
        own = self.words[flat]
        return np.concatenate([own @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Slope and shift of the logit (Newton steps), so that scores are shares of toxic documents."""
        x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
        beta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = x.T @ (x * (weights * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
            beta -= np.linalg.solve(h, x.T @ (weights * (p - labels)) + 1e-2 * (beta - [1, 0]))
        self.slope, self.shift = max(float(beta[0]), 1e-3), float(beta[1])


def batches_of(order: np.ndarray, ids: list[np.ndarray]) -> Iterator[np.ndarray]:
    """``BATCH`` rows at a time, fewer where they hold more than ``PIECE`` words."""
    first, words = 0, 0
    for n, row in enumerate(order):
        if n > first and (n - first == BATCH or words + len(ids[row]) > PIECE):
            yield order[first:n]
            first, words = n, 0
        words += len(ids[row])
    if first < len(order):
        yield order[first:]


def encode(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """shard, doc_id, lang, label, aside, ids (packed words) of every labelled document, a shard's rows next to each other."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = durable(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks.chunks(batch.column(2), SCORE_BYTES):
                flat, at = word_ids(data, offsets)
                packed = flat.astype("<u2")  # BUCKETS fit
                ids = pa.array([packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in (0, 1)], ids], ["doc_id", "lang", "ids"])

    found = semi(rows, known.select("doc_id"), "doc_id").mapInArrow(run, "doc_id long, lang string, ids binary")
    found = durable(found.join(known, "doc_id"), "labelled")
    words = found.agg(F.sum(F.octet_length("ids")).alias("b")).first()["b"] or 0
    shards = max(1, -(-words // (2 * SHARD_WORDS)))
    return durable(
        found.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ASIDE)) == 0)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("ids"), "lang"), "shards",
    )


def added(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` whole numbers that ``run`` gives for the batches of every task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.zeros(-(-size // COLUMNS) * COLUMNS, np.int64)
        wide[:size] = run(batches)
        wide = wide.reshape(-1, COLUMNS)
        kept = np.flatnonzero(wide.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), *[pa.array(wide[kept, i]) for i in range(COLUMNS)]], ["row", *names])
        blocks.give_back()

    names = [f"c{i}" for i in range(COLUMNS)]
    found = rows.mapInArrow(pack, "row int, " + ", ".join(f"{n} long" for n in names))
    sums = found.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((-(-size // COLUMNS), COLUMNS), np.int64)
    out[sums.column("row").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    return out.ravel()[:size]


def count_words(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By label, the documents that hold each word, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for ids, label in zip(batch.column("ids"), batch.column("label").to_pylist()):
                seen[label, np.unique(np.frombuffer(ids.as_py(), "<u2"))] += 1
                seen[label, BUCKETS] += 1
        return seen.ravel()

    seen = added(encoded.select("label", "ids"), run, 2 * (BUCKETS + 1)).reshape(2, -1)
    return seen[:, :-1], seen[:, -1]


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(words, labels) of a shard's rows; of one that copies of an id make too large, a part at a time."""
    held, labels, words, now = [], [], 0, None
    for batch in batches:
        for shard, label, ids in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), batch.column("ids")):
            if held and (shard != now or words > 2 * SHARD_WORDS):
                yield held, np.array(labels)
                held, labels, words = [], [], 0
            now = shard
            held.append(np.frombuffer(ids.as_py(), "<u2"))
            labels.append(label)
            words += len(held[-1])
    if held:
        yield held, np.array(labels)


def train_pass(encoded: DataFrame, network: Network, number: int) -> None:
    """Every shard moves the network over its rows; the network moves by the mean."""
    context = encoded.sparkSession.sparkContext
    before = network.state()
    sent = context.broadcast((before, number))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        before, number = sent.value
        total, own = np.zeros(len(before) + 1, np.int64), Network()
        for ids, labels in shards_of(batches):
            own.load(before)
            own.train([x.astype(np.int32) for x in ids], labels, number)
            total[:-1] += np.rint((own.state().astype(np.float64) - before) * (len(ids) * FIXED)).astype(np.int64)
            total[-1] += len(ids)
        return total

    moved = added(encoded.select("shard", "label", "ids"), run, len(before) + 1)
    network.load(before + moved[:-1] / (float(FIXED) * max(moved[-1], 1)))
    sent.destroy()


def levels(encoded: DataFrame, network: Network) -> DataFrame:
    """lang, level of the logit (in steps of ``STEP``), toxic and clean documents there."""
    context = encoded.sparkSession.sparkContext
    sent = context.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        table = network.tables()
        for batch in batches:
            rows = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("ids")]
            values = np.empty(len(rows))
            for some in batches_of(np.arange(len(rows)), rows):
                at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
                values[some] = network.logits(table, np.concatenate([rows[i] for i in some]), at)
            level = np.floor(np.clip(values, -TOP, TOP) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(level)], ["lang", "label", "level"])

    found = encoded.select("lang", "label", "ids").mapInArrow(run, "lang string, label int, level int")
    return found.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "level").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )


def best_levels(counts: DataFrame) -> DataFrame:
    """lang, level from which on calling documents toxic has the best F1; languages with enough labels of both kinds."""
    above = Window.partitionBy("lang").orderBy(F.desc("level"))  # at most 2 * TOP / STEP + 1 rows of a language
    totals = counts.groupBy("lang").agg(F.sum("toxic").alias("all_toxic"), F.sum("clean").alias("all_clean"))
    totals = totals.filter((F.col("all_toxic") > 0) & (F.col("all_clean") > 0) & (F.col("all_toxic") + F.col("all_clean") >= LEAST_SET))
    sums = counts.select("lang", "level", F.sum("toxic").over(above).alias("hit"), F.sum("clean").over(above).alias("miss"))
    f1 = 2 * F.col("hit") / (F.col("hit") + F.col("miss") + F.col("all_toxic"))
    return sums.join(totals, "lang").groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "level")).alias("best")).select("lang", "best.level")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, DataFrame, float]:
    """The network, thresholds (lang, threshold; a null lang is ''), and the threshold of the others."""
    network = Network()
    spark = docs.sparkSession
    none = spark.createDataFrame([], "lang string, threshold double")
    encoded = encode(docs, labels)
    taught = encoded.filter("not aside")
    seen, rows = count_words(taught)
    if not rows.all():
        share = labels.agg(F.avg("toxic").alias("t")).first()["t"]
        network.out[:] = 0
        share = min(max(share or 0.0, 0.0), 1.0)
        network.shift = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
        return network, none, DEFAULT_THRESHOLD
    network.start_from(seen, rows)
    for number in range(EPOCHS):
        train_pass(taught, network, number)
    counts = durable(levels(encoded.filter("aside"), network), "levels")
    every = counts.groupBy("level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()  # at most 2 * TOP / STEP + 1 rows
    logits = np.tile((every["level"].to_numpy(np.float64) + 0.5) * STEP, 2)
    network.calibrate(logits, np.repeat([1, 0], len(every)), np.concatenate([every["toxic"], every["clean"]]).astype(np.float64))
    of_level = lambda level: 1 / (1 + F.exp(-(level * F.lit(network.slope * STEP) + F.lit(network.shift))))
    by_lang = durable(best_levels(counts).select("lang", of_level(F.col("level")).alias("threshold")), "thresholds")
    all_langs = counts.groupBy(F.lit("").alias("lang"), "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = best_levels(all_langs).select(of_level(F.col("level")).alias("threshold")).first()
    return network, by_lang, found["threshold"] if found else DEFAULT_THRESHOLD


def score(docs: DataFrame, network: Network, key: str = "doc_id") -> DataFrame:
    """doc_id, lang, score of every document."""
    ship(docs.sparkSession)
    table = network.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks.chunks(batch.column(2), SCORE_BYTES):
                values = network.scores(table, *word_ids(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(values.astype(np.float64))],
                    ["doc_id", "lang", "score"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, score, threshold of the language, flagged (score reaches it)."""
    network, by_lang, every = fit(docs, labels)
    by_lang = by_lang.select(F.col("lang").alias("of_lang"), F.col("threshold").alias("own"))
    found = score(docs, network).join(by_lang, F.coalesce("lang", F.lit("")) == F.col("of_lang"), "left")
    return found.select("doc_id", "lang", "score", F.coalesce("own", F.lit(every)).alias("threshold")).withColumn("flagged", F.col("score") >= F.col("threshold"))
