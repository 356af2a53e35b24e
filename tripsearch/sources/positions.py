"""Readers of position logs and of trip text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripsearch.functions import geo
from tripsearch.functions.folds import evaluate_once
from tripsearch.storage import durable

# Positions of the fields in a raw log line.
RAW_FIELDS = {"obd_id": 2, "lng": 3, "lat": 4, "time": 8}
# Bits of an ``event_id`` that hold the place in a file (16 TiB); the others hold the file's rank.
FILE_BITS = 44


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a headerless CSV position log -> (obd_id, event_id, ts, lng, lat, fields, reason), WGS-84.

    ``event_id`` ascends in the order of the log: by file name, then by place in the file. It is put together from the
    file's rank, the byte at which the line's split starts and the line's number in its task. Every task reads at most as
    many bytes as a split has, and a line has more than one, so these numbers never reach into the next split;
    no line has to be moved or counted for it.

    ``reason`` is null for readable lines; else it names the first of ``user``, ``coordinates`` and ``time`` that is
    missing or cannot be read. Blank lines are no lines.
    """
    width = max(RAW_FIELDS.values()) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).csv(path, header=False, mode="PERMISSIVE")
    # files as rows, none of them opened
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    ranks = durable(listed.withColumn("rank", F.row_number().over(Window.orderBy("file")).cast("bigint") - 1), "log-files")
    if ranks.count() > 1 << 63 - FILE_BITS:
        raise ValueError("too many files for one log: read it in parts")
    field = {name: F.col(f"c{i}") for name, i in RAW_FIELDS.items()}
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = raw.select(
        field["obd_id"].alias("obd_id"),
        (F.col("_metadata.file_block_start") + in_task).alias("place"),
        F.col("_metadata.file_path").alias("file"),
        geo.parse_time(field["time"]).alias("ts"),
        field["lng"].try_cast("double").alias("lng"),
        field["lat"].try_cast("double").alias("lat"),
        F.array(*schema.names).alias("fields"),
    )
    unreadable = lambda name: F.col(name).isNull() | F.isnan(name)
    reason = (
        F.when(F.col("obd_id").isNull(), "user")
        .when(unreadable("lng") | unreadable("lat"), "coordinates")
        .when(F.col("ts").isNull(), "time")
    )
    return lines.join(ranks, "file").select(
        "obd_id", (F.shiftleft("rank", FILE_BITS) + F.col("place")).alias("event_id"), "ts", "lng", "lat", "fields", reason.alias("reason")
    )


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """The readable lines of a position log -> (obd_id, event_id, ts, lng, lat). ``event_id`` breaks ties of equal time."""
    return read_raw_lines(spark, path).where(F.col("reason").isNull()).select("obd_id", "event_id", "ts", "lng", "lat")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The other lines -> (event_id, reason, fields), to be kept beside the log or counted by reason."""
    return read_raw_lines(spark, path).where(F.col("reason").isNotNull()).select("event_id", "reason", "fields")


def read_events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position log derived from the ``events`` table (FIXTURES.md, section 4)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return positions_from_events(events)


def positions_from_events(events: DataFrame) -> DataFrame:
    events = evaluate_once(events, kind=F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("kind")
    user, event = F.col("user_id"), F.col("event_id")
    jitter = lambda factor: ((event * factor) % 1000) * F.lit(5e-5)
    return events.select(
        F.concat(F.lit("U"), F.lpad(user.cast("string"), 5, "0")).alias("obd_id"),
        event.alias("event_id"),
        F.col("ts"),
        F.when(kind >= 98, F.lit(200.0))
        .when(kind == 97, F.lit(110.0))
        .otherwise(F.lit(121.0) + (user % 40) * F.lit(2e-2) + jitter(7919))
        .alias("lng"),
        (F.lit(30.8) + (user % 25) * F.lit(3e-2) + jitter(104729)).alias("lat"),
    )


def read_trip_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated trip files ``<user>/r<n> <dd>.txt`` -> (obd_id, r, trip_id, dd, seq, lng, lat, epoch).

    ``seq`` is the line number. It is counted inside each file split and shifted by the
    lines of the earlier splits, so a huge file is still numbered by many tasks.
    """
    lines = (
        spark.read.schema("lng double, lat double, epoch bigint")
        .csv(path, sep="\t", recursiveFileLookup=True)
        .select(
            "lng", "lat", "epoch",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        )
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        lines.groupBy("file", "split").agg(F.count("*").alias("n"))
        .select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("file", "split").orderBy("line")
    name = F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    return (
        lines.join(sizes, ["file", "split"])
        .select(
            F.regexp_extract(name, r"([^/]+)/r(\d+) (\d+)\.txt$", 1).alias("obd_id"),
            F.regexp_extract(name, r"([^/]+)/r(\d+) (\d+)\.txt$", 2).cast("int").alias("r"),
            F.regexp_extract(name, r"([^/]+)/r(\d+) (\d+)\.txt$", 3).cast("int").alias("dd"),
            (F.col("base") + F.row_number().over(within) - 1).alias("seq"),
            "lng", "lat", "epoch",
        )
        .withColumn("trip_id", F.concat("obd_id", F.lit(" r"), F.col("r").cast("string")))
    )
