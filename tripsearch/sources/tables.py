"""Trip tables on storage: sinks, layout, catalog and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.operators import curve, pages
from tripsearch.operators.nearest import BASE_CELL, cell

#: Rows of a data page of an index file: what a search reads at least of a column.
INDEX_PAGE_ROWS = 4096


def _write(points: DataFrame, path: str, *by: str, mode: str = "overwrite", run: str | None = None) -> None:
    """Replace the partitions that ``points`` has rows in; other cities, runs, months and days stay."""
    if run is not None:
        points, by = points.withColumn("run", F.lit(run)), (by[0], "run", *by[1:])
    points.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_kept_points(points: DataFrame, path: str, city: str = "shanghai", run: str | None = None) -> None:
    """Clean points as ``city=../run=../month=..``, sorted by user and time inside each file.

    Range partitioning on (month, user, time) splits a heavy user over many files.
    """
    rows = points.withColumn("city", F.lit(city)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    _write(
        rows.repartitionByRange("month", "obd_id", "ts").sortWithinPartitions("month", "obd_id", "ts", "event_id"),
        path, "city", "month", run=run,
    )


def write_trips_by_user(points: DataFrame, path: str, city: str = "shanghai", run: str | None = None) -> None:
    """Trip points as ``city=../run=../month=../day=..`` (of the trip), clustered by user and trip; a heavy one spans files."""
    rows = points.withColumn("city", F.lit(city)).withColumn("month", F.date_format("day", "yyyy-MM"))
    _write(
        rows.repartitionByRange("month", "day", "obd_id", "r", "seq").sortWithinPartitions("month", "day", "obd_id", "r", "seq"),
        path, "city", "month", "day", run=run,
    )


def write_trips_by_day(points: DataFrame, path: str, city: str = "shanghai", mode: str = "overwrite", run: str | None = None) -> None:
    """Trip points as ``city=../run=../day=..``; a busy day is split by trip into several files."""
    rows = points.withColumn("city", F.lit(city)).repartitionByRange("day", "trip_id", "seq")
    _write(rows.sortWithinPartitions("day", "trip_id", "seq"), path, "city", "day", mode=mode, run=run)


def with_cells(points: DataFrame, width: float = BASE_CELL) -> DataFrame:
    return points.withColumn("cx", cell(F.col("lng"), width)).withColumn("cy", cell(F.col("lat"), width))


def write_point_index(
    points: DataFrame, path: str, city: str = "shanghai", mode: str = "overwrite", run: str | None = None
) -> None:
    """Trip points as ``city=../run=../day=..`` ordered by grid cell.

    Files cover narrow coordinate ranges, so a search box skips most row groups by their
    min/max statistics. The range keys end in the coordinates, so one busy cell splits too.
    """
    rows = with_cells(points).withColumn("city", F.lit(city)).repartitionByRange("day", "cx", "cy", "lng", "lat")
    _write(rows.sortWithinPartitions("day", "cx", "cy"), path, "city", "day", mode=mode, run=run)


def write_curve_index(points: DataFrame, path: str, city: str = "shanghai", mode: str = "overwrite", page_rows: int = INDEX_PAGE_ROWS) -> None:
    """Trip points as ``city=../day=..`` in Z-order, for ``curve.within_radius``. A day of any size is split into many files."""
    rows = curve.with_key(points).withColumn("city", F.lit(city)).repartitionByRange("day", "zkey", "lng", "lat")
    sorted_rows = rows.sortWithinPartitions("day", "zkey")
    writer = sorted_rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.page.row.count.limit", page_rows)
    writer.partitionBy("city", "day").parquet(path)


def write_page_index(points: DataFrame, path: str, city: str = "shanghai", page_bits: int = pages.PAGE_BITS, page_rows: int = INDEX_PAGE_ROWS) -> None:
    """Trip points of a city in packed pages as ``points/city=../day=..`` and the directory of the pages as ``directory/city=..``."""
    rows = pages.packed(points, page_bits).withColumn("city", F.lit(city))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.page.row.count.limit", page_rows)
    writer.partitionBy("city", "day").parquet(f"{path}/points")
    written = points.sparkSession.read.parquet(f"{path}/points").where(F.col("city") == city)
    pages.write_directory(written, f"{path}/directory/city={city}")


def read_page_index(spark: SparkSession, path: str, city: str = "shanghai") -> tuple[DataFrame, DataFrame]:
    """A city's points in pages, and their directory."""
    return spark.read.parquet(f"{path}/points").where(F.col("city") == city), pages.read_directory(spark, f"{path}/directory/city={city}")


def read_day(spark: SparkSession, path: str, day: str | None = None, city: str = "shanghai") -> DataFrame:
    """A city's points of one day (partition pruning), or of every day."""
    points = spark.read.parquet(path).where(F.col("city") == city)
    return points if day is None else points.where(F.col("day") == F.lit(day).cast("date"))


def user_trips(catalog: DataFrame, obd_id: str) -> DataFrame:
    """A user's trips in order."""
    return catalog.where(F.col("obd_id") == obd_id).select("r", "trip_id", "day", "n").orderBy("r")


def fetch_trip(points: DataFrame, trip_id: str) -> DataFrame:
    """The points of one trip in order."""
    return points.where(F.col("trip_id") == trip_id).select("seq", "lng", "lat").orderBy("seq")
