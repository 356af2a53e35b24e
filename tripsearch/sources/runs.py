"""Ingested logs of a folder: which runs are live, so that readers see all tables of a run or none.

Every run writes its rows of every table under ``city=../run=..`` and then commits one new version of its city's
manifest: the logs in the order of ingestion, the run that holds each, and the days of a run that a later log has
taken over, because a trip went on in it. Rows of runs that no manifest names (failed or replaced ones) are never read.
Logs of one city are ingested one at a time; a version is written once and never changed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "log string, position int, run string, dropped array<struct<day: date, by: string>>"


@dataclass(frozen=True)
class Run:
    """The live run of a log; ``dropped`` are days (with the log that took them over) which this run no longer holds."""

    log: str
    run: str
    dropped: tuple[tuple[object, str], ...] = field(default=())


def new_run(position: int) -> str:
    return f"r{position:05d}-{uuid.uuid4().hex[:12]}"


def _path(folder: str) -> str:
    return f"{folder}/manifest"


def _versions(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        found = spark.read.schema(f"{_MANIFEST}, city string, version bigint").parquet(_path(folder))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found


def histories(spark: SparkSession, folder: str) -> dict[str, tuple[int, list[Run]]]:
    """By city, the newest version and its runs in the order of their logs. One row per ingested log reaches the driver."""
    found = _versions(spark, folder)
    if found is None:
        return {}
    newest = found.groupBy("city").agg(F.max("version").alias("version"))
    out: dict[str, tuple[int, list[Run]]] = {}
    for r in found.join(newest, ["city", "version"]).orderBy("city", "position").collect():
        entry = Run(r["log"], r["run"], tuple((d["day"], d["by"]) for d in r["dropped"]))
        out.setdefault(r["city"], (r["version"], []))[1].append(entry)
    return out


def commit(spark: SparkSession, folder: str, city: str, version: int, history: list[Run]) -> None:
    rows = [(h.log, i, h.run, [tuple(d) for d in h.dropped]) for i, h in enumerate(history)]
    table = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    table.write.mode("error").parquet(f"{_path(folder)}/city={city}/version={version}")


def _is_live(history: list[Run], by_day: bool) -> Column:
    """Partitions of a city's live runs; only partition columns, so nothing else is listed or read."""
    live = F.col("run").isin([h.run for h in history])
    for h in history:
        days = sorted({d for d, _ in h.dropped})
        if by_day and days:
            live = live & ~((F.col("run") == h.run) & F.col("day").isin(days))
    return live


def read(spark: SparkSession, folder: str, table: str, city: str | None = None, by_day: bool = True, history: list[Run] | None = None) -> DataFrame:
    """The live rows of a table of ``folder``, of one city or of all; ``history`` reads the table as it was after those runs."""
    known = {city: (0, history)} if history is not None else histories(spark, folder)
    rows = spark.read.parquet(f"{folder}/{table}")
    live = F.lit(False)
    for name, (_, runs) in known.items():
        if city is None or name == city:
            live = live | ((F.col("city") == name) & _is_live(runs, by_day))
    return rows.where(live).drop("run")
