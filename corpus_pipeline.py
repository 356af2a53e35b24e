"""A corpus pipeline: five operators in turn, each on all that the one before it kept.

1. ``quality``: documents whose perplexity under a model of trusted text is too high go.
2. ``near_copies``: of each group of linked documents (word shingles of five, Jaccard 0.75) the smallest id stays.
3. ``repeated_passages``: bytes of passages that a document with a smaller id holds too are cut out of
   ``text``. Passages are ``PASSAGE`` bytes and more, so shorter phrases that clean documents share stay.
4. ``benchmark_leaks``: documents that hold a benchmark item go.
5. ``mixing``: token weights of source, language and topic; documents that the sampler rejects go.

Stages 1 to 4 return the columns of ``documents``; stage 5 returns one row per sampled document, with its cell and weights.

Defined results: rows without an id pass stages 2 to 4 and, as rows with null or empty texts do not
pass stage 1, only when they hold text. Extra columns pass through. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.llm import decontam, jaccard, kneser, raking, suffix
from tripsearch.llm.byids import semi
from tripsearch.storage import durable

#: Bytes of the shortest passage that stage 3 cuts out: any passage of over 50 words has as many.
PASSAGE = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser.keep_good(docs, _table(spark, sf_dir, "labels").filter("quality = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs, window=PASSAGE)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return raking.mix(docs).where("sampled")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixing", mixing),
]

#: Perplexities, fitted weights and hashes of the sample are not SQL's; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
