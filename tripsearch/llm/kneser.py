"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is one of words and characters (``wordgrams``): all grams of up to three tokens of every trusted text, as
tables. Tokens that no trusted text holds are spelt by a model of letters, which predicts one letter from the
``ORDER - 1`` before it. Letters are the classes of ``letter_classes``: their number bounds this part
(``CLASSES ** ORDER`` grams), which is what makes it safe to send to every task. Discounted probabilities
and back-off weights come from joins of the counts with their contexts' totals, sharded by context.

A quarter of the trusted documents (by a hash of their id) is held out of the counts. Their
perplexities set the threshold of each language: the ``quantile`` of its held-out documents. A
language with fewer than ``LEAST_HELD`` of them takes the threshold over all languages.

Defined results: a null or empty text has no perplexity and is not kept. A null language is a
language of its own. Without trusted documents the model is uniform and, with no threshold,
every text is kept. Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm import blocks, wordgrams
from tripsearch.llm.byids import semi
from tripsearch.ship import ship
from tripsearch.storage import durable

ORDER = 4
LEAST_HELD = 20
HELD_OUT = 4
QUANTILE = 0.99
MARGIN = 1.1
#: Letters of average text that a decision counts beside the document's own: a few letters prove little.
STEADY = 30


def letter_classes() -> np.ndarray:
    """Class of every byte: small letters, common marks one each; capitals, digits and the rest in groups."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("A") : ord("Z") + 1] = 27
    table[ord("0") : ord("9") + 1] = 28
    for number, mark in enumerate(b" \n.,", 29):
        table[mark] = number
    others = [b for b in range(33, 127) if not table[b]]
    table[others] = 33 + np.array(others) % 6
    table[0x80:0xC0] = 39 + np.arange(64) % 8
    table[0xC0:] = 47
    return table


CLASSES = 48
NEWLINE = 30


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram that ends at every byte; texts are thought to follow line ends."""
    letters = letter_classes()[data].astype(np.int32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = letters.copy()
    for back in range(1, ORDER):
        before = np.full(len(data), NEWLINE, np.int32)
        before[back:] = letters[:-back] if back < len(letters) else letters[:0]
        before[place < back] = NEWLINE
        out += before * CLASSES**back
    return out


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n over every text."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks.chunks(batch.column(0), 8 << 20):
                total += np.bincount(grams(data, offsets), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    counted = docs.select(text).mapInArrow(count, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's discounts for counts of 1, 2 and more, from the counts of counts."""
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    found = []
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.0
    for i in (1, 2, 3):
        here, after = n[f"n{i}"], n[f"n{i + 1}"]
        # tables too small for the estimate take a fixed share of the count
        value = i - (i + 1) * y * after / here if here else 0.5
        found.append(min(max(value, 0.1), i - 0.1))
    return found


def order_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, share): discounted probabilities; (context, spare): back-off weights."""
    d1, d2, d3 = discounts(counts)
    cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    rows = counts.select("gram", "n", F.expr(f"cast(floor(gram / {CLASSES}) as int)").alias("context"), cut.alias("cut"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("taken"))
    shares = rows.join(contexts, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"))
    return shares, contexts.select("context", (F.col("taken") / F.col("total")).alias("spare"))


def log_model(counts: DataFrame) -> np.ndarray:
    """Log probability of the last letter of every gram."""
    prob = np.full(CLASSES, 1.0 / CLASSES)
    # lower orders count the letters seen before a gram, not its uses
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = by_order[k + 1].select(F.expr(f"gram % {CLASSES ** k}").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    for k in range(1, ORDER + 1):
        shares, contexts = (t.toPandas() for t in order_tables(by_order[k]))  # at most CLASSES ** k rows
        spare = np.ones(CLASSES ** (k - 1))
        spare[contexts["context"].to_numpy(np.int64)] = contexts["spare"]
        lower = np.tile(prob, CLASSES) if k > 1 else prob
        prob = np.repeat(spare, CLASSES) * lower
        prob[shares["gram"].to_numpy(np.int64)] += shares["share"].to_numpy()
    return np.log(prob).astype(np.float32)


def speller(model: np.ndarray) -> wordgrams.Spelling:
    """Log probability of the letters of every token and a space that ends it, each byte drawn evenly from its class."""
    table = letter_classes()
    even = np.log(np.bincount(table, minlength=CLASSES))[table]

    def spell(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        count = len(at) - 1
        wide = np.full(len(data) + count, ord(" "), np.uint8)
        wide[np.arange(len(data)) + np.repeat(np.arange(count), np.diff(at))] = data
        at = at + np.arange(count + 1)
        sums = np.concatenate([[0.0], np.cumsum(model[grams(wide, at)] - even[wide], dtype=np.float64)])
        # rounded: sums of other letters before it must not show in a token's value
        return np.round(np.diff(sums[at]), 6)

    return spell


def perplexities(docs: DataFrame, learnt: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity by byte (null without bytes), by the model of ``learnt`` (its column ``text``)."""
    ship(docs.sparkSession)
    spell = speller(log_model(durable(count_grams(learnt), "gram-counts")))
    grams, log_spare = wordgrams.model(wordgrams.count_trigrams(learnt), wordgrams.spellings(learnt, spell), discounts)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return wordgrams.perplexities(rows, grams, log_spare, spell)


def is_held_out(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0


def quality(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", quantile: float = QUANTILE, margin: float = MARGIN
) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, steady_perplexity, keep. ``trusted`` holds the ids of trusted documents.

    A document is kept when its perplexity, taken with ``STEADY`` letters at the median of the held-out ones, is at
    most its threshold: ``margin`` times the quantile of the held-out documents, taken alike.
    """
    trusted = trusted.select(F.col(key).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    trusted = durable(trusted, "trusted")
    learnt = semi(rows, trusted.filter(~is_held_out(F.col("doc_id"))), "doc_id")
    scores = durable(perplexities(docs, learnt, key), "perplexities")
    held = scores.join(trusted.filter(is_held_out(F.col("doc_id"))), "doc_id", "left_semi").filter("perplexity is not null")
    log_p, letters = F.log("perplexity"), F.col("n_bytes")
    middle = lambda: F.percentile(F.round(log_p, 4), F.lit(0.5))
    centre = held.agg(middle().alias("c")).first()["c"]  # one number
    steady = (log_p * letters + F.lit(centre).cast("double") * STEADY) / (letters + STEADY)
    level = F.percentile(F.round(steady, 4), F.lit(quantile))
    own = (
        held.groupBy(F.coalesce("lang", F.lit("")).alias("of_lang"))
        .agg(level.alias("own_level"), F.count("*").alias("n_held")).filter(F.col("n_held") >= LEAST_HELD)
    )
    every = held.agg(level.alias("level")).first()["level"]  # one number
    limit = F.exp(F.coalesce("own_level", F.lit(every).cast("double"))) * margin
    return (
        scores.join(own, F.coalesce("lang", F.lit("")) == F.col("of_lang"), "left")
        .select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("threshold"), F.exp(steady).alias("steady_perplexity"))
        .withColumn("keep", F.when(F.col("perplexity").isNull(), False).otherwise(F.coalesce(F.col("steady_perplexity") <= F.col("threshold"), F.lit(True))))
    )


def keep_good(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps; of rows without an id those with text.

    An id that repeats goes only if none of its rows is kept.
    """
    found = quality(docs, trusted, key, quantile)
    gone = durable(
        found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("keep").alias("keep")).filter("not keep")
        .select(F.col("doc_id").alias(key)), "rejected",
    )
    nameless = F.col(key).isNotNull() | (F.octet_length(F.col(text)) > 0)
    return semi(docs.filter(nameless), gone, key, "left_anti")
