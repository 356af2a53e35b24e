"""Trips from live position feeds with Structured Streaming."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.operators.trips import CARRY_SCHEMA, GAP_SECONDS, clean_positions, extend_trips, newest_carry
from tripsearch.sources import tables
from tripsearch.sources.positions import positions_from_events
from tripsearch.storage import new_folder


#: Batches between two carries of all users.
FULL_EVERY = 16
_LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
_SUMMARY = "obd_id string, first_ts timestamp, last_ts timestamp, n bigint"


def folder_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Clean positions from a folder of ``events`` files as a stream, file by file in the order they were written."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1)
    return clean_positions(positions_from_events(reader.parquet(folder)))


def position_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean positions from the ``events`` files as a stream."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    sample = table.select("_metadata.file_path").first()
    reader = spark.readStream.schema(table.schema)
    if sample is not None and sample[0].endswith("/events.parquet"):  # one file, not a folder of files
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        events = reader.parquet(path)
    return clean_positions(positions_from_events(events))


def table_stream(table: DataFrame) -> DataFrame:
    """The files of a written table as a stream."""
    folder = os.path.dirname(table.inputFiles()[0])
    return table.sparkSession.readStream.schema(table.schema).parquet(folder)


def trip_summaries(positions: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(obd_id, first_ts, last_ts, n) of each trip, sent out once no point can still join it."""
    timed = positions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        timed.groupBy("obd_id", F.session_window("ts", f"{gap_seconds} seconds").alias("span"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
        .select("obd_id", "first_ts", "last_ts", "n")
    )


@dataclass(frozen=True)
class LiveTrips:
    """Where a stream of trip summaries stands. ``dropped`` counts rows that came after the delay in this run."""

    folder: str
    dropped: int

    def closed(self, spark: SparkSession) -> DataFrame:
        """Trips that no point can join any more."""
        return spark.read.schema(_SUMMARY).parquet(f"{self.folder}/rows")

    def open(self, spark: SparkSession) -> DataFrame:
        """Trips that are still open, from the state that the stream has committed."""
        state = spark.read.format("statestore").load(f"{self.folder}/checkpoint")
        return state.select("key.obd_id", F.col("value.min").alias("first_ts"), F.col("value.max").alias("last_ts"), F.col("value.count").alias("n"))


def summarize_trips(
    positions: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "1 hour", folder: str | None = None, **trigger
) -> LiveTrips:
    """Run ``trip_summaries`` over the input there is now. Sessions are merged inside each input task first, so a busy user sends few rows."""
    spark = positions.sparkSession
    folder = folder or new_folder(spark, "trip-summary")
    before = spark.conf.get(_LOCAL_SESSIONS)
    spark.conf.set(_LOCAL_SESSIONS, "true")
    try:  # a query keeps the settings that it was started with
        query = (
            trip_summaries(positions, gap_seconds, delay).writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.set(_LOCAL_SESSIONS, before)
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return LiveTrips(folder, dropped)


def carry_before(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Every user's last trip before a batch: the last full carry and what the batches after it have touched."""
    if not number:
        return spark.createDataFrame([], CARRY_SCHEMA)
    full = (number - 1) // FULL_EVERY * FULL_EVERY
    return newest_carry(spark.read.schema(CARRY_SCHEMA).parquet(*[f"{folder}/carry/{i}" for i in range(full, number)]))


def number_points(positions: DataFrame, gap_seconds: int = GAP_SECONDS, folder: str | None = None, **trigger) -> str:
    """Number live points trip by trip; returns the folder of the ``points`` and ``late`` tables.

    Every micro-batch is numbered like a whole log, slot by slot, starting from one carried
    row per user, so a busy user is spread over many tasks. A batch writes the carry of the users it has touched,
    every ``FULL_EVERY``-th that of all. Carry and outputs are written
    under the batch number: a batch that is run again overwrites its own files only.
    """
    spark = positions.sparkSession
    folder = folder or new_folder(spark, "numbering")

    def step(batch: DataFrame, number: int) -> None:
        carry = carry_before(batch.sparkSession, folder, number)
        numbered, reached, late = extend_trips(batch, carry, gap_seconds)
        numbered.drop("day").write.mode("overwrite").parquet(f"{folder}/points/batch={number}")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        kept = reached if number % FULL_EVERY else newest_carry(reached.unionByName(carry))
        kept.write.mode("overwrite").parquet(f"{folder}/carry/{number}")

    (
        positions.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    )
    return folder


def append_index(points: DataFrame, folder: str | None = None, city: str = "shanghai", **trigger) -> str:
    """Append each micro-batch of trip points to the grid-ordered point index."""
    spark = points.sparkSession
    folder = folder or new_folder(spark, "live-index")

    def step(batch: DataFrame, number: int) -> None:
        tables.write_point_index(batch, f"{folder}/index/batch={number}", city)

    (
        points.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    )
    return f"{folder}/index"
