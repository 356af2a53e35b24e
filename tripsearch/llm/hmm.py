"""A hidden Markov language model: Baum-Welch over all learnt texts, exact likelihoods by the scaled forward recursion.

Tokens are the words of a text (A-Z lower-cased) and one end. A token is emitted in two steps: the latent state emits a
class, the class emits the token. The ``OWN`` most frequent tokens and the end are classes of their own; any other token belongs to the class
of its first and last bytes and its length, and has the share (c + ADDED) / (sum + ADDED * (tokens of the class + 1)) of it, the last
share being that of tokens never learnt. The states' steps, beginnings and emissions of classes have a fixed number of
parameters; the table of token counts, which gives the shares and the unigram base, grows with the corpus.

- Counts: one aggregation over all learnt texts by token (a 64-bit hash).
- The most frequent tokens, ``HEAD`` at most, are sent to every task (8 MB); other tokens of texts meet the table of counts in a join.
  There are more than HEAD tokens about as frequent as any of these or more, so none holds much more than 1 / HEAD of all tokens and no
  key of that join is hot.
- Texts are written once as sequences of class numbers (2 bytes a token). Every pass of Baum-Welch reads the learnt
  ones; each task runs forward and backward over many texts at a time, and only its expected counts leave it.
- Long texts: between windows of ``WINDOW`` tokens only the state distribution is kept, and windows are run again backward. No text is cut.

Defined results: null and blank texts are one token, the end. Rows without an id are scored, not held out and not learnt from. Rows of one
id are scored one by one. With nothing to learn from, N and V are 0, every token has base log10(ADDED / ADDED) = 0, and the
score is that of the even model over classes. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks
from tripsearch.ship import ship
from tripsearch.storage import durable

STATES = 8
PASSES = 5
ADDED = 0.1
#: Most tokens sent to every task beside the end; tokens that are classes of their own; classes of the others.
HEAD = 1 << 19
OWN = 4096
SHAPES = 2048
CLASSES = 1 + OWN + SHAPES
#: Tokens run through at a time.
WINDOW = 1 << 19
#: Weight of the classes' plain frequencies in a state's emissions, in tokens.
PRIOR = 50.0
END = np.uint64(0xE9D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of every text's words and end, and the offsets of the texts."""
    starts, ends, bounds = blocks.words(data, offsets)
    folded = data.copy()
    upper = (data >= ord("A")) & (data <= ord("Z"))
    folded[upper] += 32
    words = blocks.word_hashes(folded, starts, ends)
    last = folded[ends - 1].astype(np.uint64)
    second = folded[np.maximum(ends - 2, starts)].astype(np.uint64)
    look = (folded[starts].astype(np.uint64) << np.uint64(24)) | (second << np.uint64(16)) | (last << np.uint64(8))
    look |= np.minimum(ends - starts, 12).astype(np.uint64)
    shapes = (blocks.mix(look) % np.uint64(SHAPES)).astype(np.int64) + 1 + OWN
    count = np.diff(bounds) + 1
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(words)) + np.repeat(np.arange(len(count)), count - 1)
    hashes, classes = np.full(out[-1], END, np.uint64), np.zeros(out[-1], np.int64)
    hashes[at], classes[at] = words, shapes
    return hashes, classes, out


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, class (0 the end, else by shape), c over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks.chunks(batch.column(0), 8 << 20):
                hashes, classes, _ = tokens(data, offsets)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(classes[first], pa.int32()), pa.array(n)], ["token", "class", "c"]
                )

    return docs.select("text").mapInArrow(count, "token long, class int, c long").groupBy("token").agg(
        F.first("class").alias("class"), F.sum("c").alias("c")
    )


@dataclass
class Lexicon:
    """What every task knows of the learnt tokens: the most frequent ones, and the totals of the classes."""

    token: np.ndarray  # sorted, the end among them
    klass: np.ndarray
    count: np.ndarray
    total: np.ndarray  # by class: sum of counts
    kinds: np.ndarray  # by class: number of tokens
    learnt: int
    known: int

    def share_base(self) -> np.ndarray:
        """log10 of what a token's c + ADDED is divided by, per class; own classes emit nothing but their token."""
        return np.log10(self.total + ADDED * (self.kinds + 1))


def frequent(counts: DataFrame) -> DataFrame:
    """At most HEAD of the most frequent rows: as many whole bands of counts (one count each up to 64, then 64 to a doubling) as fit.

    The bands are a table of a few thousand rows at any size, so no task gathers candidates from all others.
    """
    band = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.floor(F.log2("c") * 64)).cast("long")
    banded = counts.withColumn("band", band)
    sizes = sorted(((r.band, r.n) for r in banded.groupBy("band").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 40, 0
    for value, n in sizes:
        held += n
        if held > HEAD:
            break
        least = value
    return banded.filter(F.col("band") >= least).drop("band")


def lexicon(counts: DataFrame) -> Lexicon:
    """``counts`` is a written table. HEAD rows and one per class and band reach the driver."""
    end = int(END)
    head = frequent(counts.filter(F.col("token") != end)).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    ends = counts.filter(F.col("token") == end).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    token, klass, count = (np.append(head.column(c).to_numpy(), x) for c, x in (("token", end), ("class", 0), ("c", ends)))
    own = np.arange(min(OWN, len(token) - 1))
    klass[own] = 1 + np.arange(len(own))
    kept = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(t),) for t in token[own]], "token long")), "token", "left_anti")
    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    total[klass[own]], kinds[klass[own]] = count[own], 1
    learnt, known = int(count[own].sum()), len(own)
    for r in kept.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        total[r["class"]], kinds[r["class"]] = r.c, r.n
        learnt, known = learnt + r.c, known + r.n
    order = np.argsort(token.view(np.uint64))
    return Lexicon(token.view(np.uint64)[order], klass[order].astype(np.int64), count[order], total, kinds, learnt, known)


_ENCODED = "place long, doc_id long, held_out boolean, n_tokens long, n_known long, seen double, divided double, ids binary, rest array<long>"


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """Texts as class numbers, with the sums over their frequent tokens and the hashes of the others.

    ``seen`` is the sum of log10(c + ADDED) of frequent tokens, ``divided`` that of what turns each token's c + ADDED into its share of its class.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        base = lex.share_base()
        log = np.log10(lex.count + ADDED)
        for batch in batches:
            for first, last, data, offsets in blocks.chunks(batch.column(2), 4 << 20):
                hashes, classes, at = tokens(data, offsets)
                found, back = np.unique(hashes, return_inverse=True)
                slot = np.minimum(np.searchsorted(lex.token, found), len(lex.token) - 1)
                frequent, slot = (lex.token[slot] == found)[back], slot[back]
                classes[frequent] = lex.klass[slot[frequent]]
                seen = np.where(frequent, log[slot], 0.0)
                known = frequent & (lex.count[slot] > 0)
                # a class of its own emits nothing but its token, so its share is 1
                divided = np.where(classes > OWN, base[classes], seen)
                rest = np.flatnonzero(~frequent)
                rows = np.searchsorted(rest, at)
                ids = classes.astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3).slice(first, last - first), batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first), pa.array(np.diff(at)), pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])),
                        pa.array(np.add.reduceat(seen, at[:-1])), pa.array(np.add.reduceat(divided, at[:-1])),
                        pa.array([ids[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(hashes[rest].view(np.int64))),
                    ],
                    [c.split()[0] for c in _ENCODED.split(", ")],
                )

    asked = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("place"))
    return asked.mapInArrow(run, _ENCODED)


@dataclass
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def first_model(words: Lexicon, states: int = STATES, seed: int = 7) -> Model:
    """The classes' plain frequencies in every state, each times a random factor that tells the states apart."""
    rng = np.random.default_rng(seed)
    emit = (words.total + ADDED)[:, None] * rng.uniform(0.5, 1.5, (CLASSES, states))
    step = np.eye(states) * states + rng.uniform(0.5, 1.5, (states, states))
    return Model(np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Batch:
    """Sequences of class numbers, longest first, laid out time by time: at any time the live ones are a prefix."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in self.order])
        self.time = int(lengths[0])
        self.live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, self.time + 1))
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.ids = np.empty(self.at[-1], np.int64)
        for row, i in enumerate(self.order):
            self.ids[self.at[:-1][: lengths[row]] + row] = sequences[i]

    def windows(self, limit: int) -> list[tuple[int, int]]:
        """Stretches of time of about ``limit`` tokens."""
        out, t = [], 0
        while t < self.time:
            u = max(t + 1, int(np.searchsorted(self.at, self.at[t] + limit, "right")) - 1)
            out.append((t, u))
            t = u
        return out

    def forward(self, model: Model, t: int, u: int, before: np.ndarray | None, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State distributions and scales of times t to u, the emissions there, and the distributions at the end."""
        emitted = model.emit[self.ids[self.at[t] : self.at[u]]]
        alphas = np.empty_like(emitted) if keep else emitted[:0]
        scales = np.empty(len(emitted), emitted.dtype)
        for k in range(t, u):
            a, b = self.at[k] - self.at[t], self.at[k + 1] - self.at[t]
            now = emitted[a:b] * (model.start if before is None else before[: b - a] @ model.step)
            total = now.sum(axis=1)
            scales[a:b] = total
            now /= total[:, None]
            if keep:
                alphas[a:b] = now
            before = now
        return alphas, scales, emitted, before


def log_likelihoods(model: Model, sequences: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each sequence."""
    batch = Batch(sequences)
    out, before = np.zeros(len(sequences)), None
    for t, u in batch.windows(window):
        _, scales, _, before = batch.forward(model, t, u, before, False)
        logs = np.log(scales)
        for k in range(t, u):
            a, b = batch.at[k] - batch.at[t], batch.at[k + 1] - batch.at[t]
            out[: b - a] += logs[a:b]
    back = np.empty(len(sequences))
    back[batch.order] = out
    return back


@dataclass
class Expected:
    """Expected counts: (classes + 1, states) emissions with the beginnings in the last row, (states, states) steps."""

    emit: np.ndarray
    step: np.ndarray


def expected_counts(model: Model, sequences: list[np.ndarray], into: Expected, window: int = WINDOW) -> None:
    """Add the expected counts of the sequences, by forward and backward recursion."""
    batch = Batch(sequences)
    windows, borders = batch.windows(window), [None]
    for t, u in windows[:-1]:
        borders.append(batch.forward(model, t, u, borders[-1], False)[3])
    states = model.step.shape[0]
    after, sent = None, None  # of the time after: backward values, and these times emission over scale
    crossing = np.zeros((states, states))
    for (t, u), border in zip(windows[::-1], borders[::-1]):
        alphas, scales, emitted, _ = batch.forward(model, t, u, border, True)
        emitted /= scales[:, None]
        gammas = alphas.copy()
        for k in range(u - 1, t - 1, -1):
            a, b = batch.at[k] - batch.at[t], batch.at[k + 1] - batch.at[t]
            beta = np.ones((b - a, states), emitted.dtype)
            if sent is not None and len(sent):
                crossing += alphas[a : a + len(sent)].T @ sent
                beta[: len(sent)] = sent @ model.step.T
            gammas[a:b] *= beta
            sent = emitted[a:b] * beta
        ids = batch.ids[batch.at[t] : batch.at[u]]
        for s in range(states):
            into.emit[:-1, s] += np.bincount(ids, gammas[:, s], CLASSES)
        if t == 0:
            into.emit[-1] += gammas[: batch.at[1]].sum(axis=0)
    into.step += crossing * model.step


def _groups(column: pa.Array, limit: int = WINDOW) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, sequences) of like length and about ``limit`` tokens in all."""
    rows = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    order = np.argsort([len(r) for r in rows], kind="stable")
    first, total = 0, 0
    for n, i in enumerate(order):
        total += len(rows[i])
        if total >= limit or n + 1 == len(order):
            yield order[first : n + 1], [rows[j] for j in order[first : n + 1]]
            first, total = n + 1, 0


def trained(encoded: DataFrame, words: Lexicon, passes: int = PASSES, states: int = STATES) -> Model:
    """Baum-Welch over the rows of ``encoded``, a written table. The expected counts of all partitions are added up by class."""
    model = first_model(words, states)
    spark = encoded.sparkSession
    ship(spark)
    names = [f"g{s}" for s in range(states)]
    plain = words.total + ADDED
    plain /= plain.sum()
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.step, model.emit))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Expected(np.zeros((CLASSES + 1, states)), np.zeros((states, states)))
            for batch in batches:
                for _, sequences in _groups(batch.column(0)):
                    expected_counts(sent.value, sequences, sums)
            rows = np.concatenate([sums.emit, sums.step])
            kept = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.int32()), *[pa.array(rows[kept, s]) for s in range(states)]], ["row", *names]
            )
            blocks.give_back()

        found = encoded.select("ids").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names))
        added = found.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        if not added.num_rows:
            break
        rows = np.zeros((CLASSES + 1 + states, states))
        rows[added.column("row").to_numpy()] = np.stack([added.column(n).to_numpy() for n in names], axis=1)
        emit, start, step = rows[:CLASSES] + PRIOR * plain[:, None], rows[CLASSES] + 1, rows[CLASSES + 1 :] + 1
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        sent.destroy()
    return model


def scored(encoded: DataFrame, model: Model) -> DataFrame:
    """place and ``path``, the log10 probability of the text's classes, of every row."""
    ship(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, sequences in _groups(batch.column(batch.num_columns - 1)):
                out[rows] = log_likelihoods(sent.value, sequences) / np.log(10)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], [*names, "path"])
            blocks.give_back()

    names = ["place", "doc_id", "held_out", "n_tokens", "n_known", "seen", "divided"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return encoded.select(*names, "ids").mapInArrow(run, f"{schema}, path double")


def language_model(docs: DataFrame, held_out: Column, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The model learns from the rows where ``held_out`` is false; both scores are log10 probabilities of whole texts.
    """
    asked = docs.select("doc_id", held_out.alias("held_out"), "text")
    counts = durable(count_tokens(asked.filter(~F.col("held_out"))), "tokens")
    words = lexicon(counts)
    encoded = durable(encode(asked, words), "encoded")
    model = trained(encoded.filter(~F.col("held_out")), words, passes)
    rest = encoded.select("place", F.explode("rest").alias("token")).join(counts.select("token", "c"), "token", "left")
    rest = durable(rest.groupBy("place").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("more"), F.count("c").alias("found")
    ), "rest")
    whole = scored(encoded, model).join(rest, "place", "left")
    known = F.col("n_known") + F.coalesce("found", F.lit(0))
    seen = F.col("seen") + F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "n_tokens", known.alias("n_known"),
        F.lit(words.learnt).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * float(np.log10(words.learnt + ADDED * (words.known + 1)))).alias("base_score"),
        (F.col("path") + seen - F.col("divided")).alias("score"),
    )
