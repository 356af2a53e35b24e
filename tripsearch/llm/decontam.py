"""Benchmark decontamination: short test items found inside long documents by MinHash containment.

An item's shingles (five words; an item of fewer words is one shingle of all of them) are hashed. If a
document holds at least ``least`` of an item's n shingles, it holds one of any ``n - ceil(least * n) + 1``
of them, so the item's MinHash sketch is that many of its smallest hashes: containment search
without misses. Items are partitioned by size; each partition has the ceiling under which all of its
sketches lie, and a document is sketched by its hashes under the highest ceiling. Documents that
share a sketched hash with an item are candidates; their whole shingle sets then decide exactly.

Words are runs of letters and digits of the lower-cased text. All of it is DataFrame operations.

Defined results: rows without an id are not reported. Rows that repeat an id count as one document
or item with all of their shingles. Null and empty texts, and items without a letter or digit, match
nothing. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.llm.byids import semi
from tripsearch.storage import durable

SHINGLE = 5
LEAST = 0.75
#: Upper ends of the size partitions, in shingles; larger items form the last one.
SIZES = (8, 16, 32, 64, 128, 256, 512)


def with_words(table: DataFrame, key: str, text: str) -> DataFrame:
    """row_key, words. The words are a generated column: they are computed once."""
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    return table.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("row_key"), F.inline(F.array(F.struct(words.alias("words"))))
    )


def runs(words: str, length: int) -> Column:
    """Hashes of every run of ``length`` words."""
    picked = ", ".join(f"{words}[i + {j}]" for j in range(length))
    return F.expr(
        f"case when size({words}) >= {length} then transform(sequence(0, size({words}) - {length}), i -> xxhash64({length}, {picked})) "
        "else cast(array() as array<bigint>) end"
    )


def shingles_of_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, length (words of its shingles), shingle: distinct."""
    words = with_words(items, key, text).filter("size(words) > 0")
    made = F.expr("case size(words) " + " ".join(f"when {m} then 'm{m}'" for m in range(1, SHINGLE)) + " else 'm5' end")
    by_length = [
        words.filter(made == f"m{m}").select(F.col("row_key").alias("item_id"), F.lit(m).alias("length"), F.explode(runs("words", m)).alias("shingle"))
        for m in range(1, SHINGLE + 1)
    ]
    return reduce(DataFrame.unionByName, by_length).distinct()


def sketches(shingles: DataFrame, least: float) -> DataFrame:
    """item_id, n, need, part, shingle: the smallest hashes of every item."""
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n"))
    part = sum((F.col("n") > s).cast("int") for s in SIZES)
    sized = sizes.select("item_id", "n", part.alias("part"), _need(F.col("n"), least).alias("need"))
    order = Window.partitionBy("item_id").orderBy("shingle")
    return (
        shingles.join(sized, "item_id").withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("n") - F.col("need") + 1).drop("place")
    )


def _need(n: Column, least: float) -> Column:
    """The least number of shared shingles, in whole numbers: ``least`` counts in ten-thousandths."""
    return F.ceil(n * round(least * 10000) / 10000).cast("long")


def _up_to(hashes: Column, top: int) -> Column:
    return F.filter(hashes, lambda h: h <= F.lit(top))


def contained(
    docs: DataFrame, items: DataFrame, least: float = LEAST, key: str = "doc_id", item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair that reaches ``least``."""
    shingles = durable(shingles_of_items(items, item_key, text), "item-shingles")
    sketch = durable(sketches(shingles, least), "item-sketches")
    # a row per size partition and shingle length: at most 8 x 5
    ceilings = sketch.groupBy("part", "length").agg(F.max("shingle").alias("ceiling")).collect()
    if not ceilings:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    words = with_words(docs, key, text)
    highest = {m: max(r["ceiling"] for r in ceilings if r["length"] == m) for m in {r["length"] for r in ceilings}}
    sketched = reduce(lambda a, b: F.concat(a, b), [_up_to(runs("words", m), top) for m, top in highest.items()])
    probes = words.select("row_key", F.explode(sketched).alias("shingle"))
    candidates = durable(
        probes.join(sketch.select("shingle", "item_id"), "shingle").select(F.col("row_key").alias("doc_id"), "item_id").distinct(), "candidates"
    )
    chosen = durable(candidates.select(F.col("doc_id").alias(key)).distinct(), "candidate-ids")
    every = reduce(lambda a, b: F.concat(a, b), [runs("words", m) for m in highest])
    held = with_words(semi(docs.select(key, text), chosen, key), key, text)
    sizes = sketch.select("item_id", F.col("n").alias("n_item"), "need").distinct()
    return (
        held.select(F.col("row_key").alias("doc_id"), F.explode(F.array_distinct(every)).alias("shingle"))
        .join(shingles.select("shingle", "item_id"), "shingle").distinct()
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
        .join(sizes, "item_id").filter(F.col("n_shared") >= F.col("need"))
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, least: float = LEAST, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without an id stay."""
    found = durable(contained(docs, items, least, key).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return semi(docs, found, key, "left_anti")
