"""A session of an operator's own: the caller's settings, but for those that bound its memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> SparkSession:
    """A session with the caller's settings whose Arrow batches hold at most ``most`` bytes.

    A batch is there several times while it travels (vectors that grow by doubling, the stream, the worker's copy), so
    a task's whole texts in one batch cost it a multiple of them. The caller's session stays as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return own
