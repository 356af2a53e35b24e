"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.llm import decontam, hmm, impact, jaccard, kneser, merkle, raking, recompress, repair, suffix, toxic, urls, warc
from tripsearch.llm.sessions import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = _table(spark, sf_dir, "labels").filter(~held_out)
    return toxic.toxicity(_table(spark, sf_dir, "documents"), labels).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )


def op3_substring_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(_table(small_batches(spark), sf_dir, "documents")).drop("kept", "spans")


def op4_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicate(_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return impact.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(_table(small_batches(spark), sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return kneser.quality(_table(spark, sf_dir, "documents"), trusted)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.without_newlines(_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    return hmm.language_model(_table(spark, sf_dir, "documents"), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_substring_bytes": op3_substring_bytes,
    "op4_substring_words": op4_substring_words,
    "op5_topk": op5_topk,
    "op6_url_filters": op6_url_filters,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_conversations": op12_conversations,
    "op13_hmm": op13_hmm,
}
