"""From position logs to the trip tables that searches read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tripsearch.operators.features import simplify_trips
from tripsearch.operators.trips import CARRY_SCHEMA, GAP_SECONDS, SHANGHAI, clean_positions, extend_trips, newest_carry
from tripsearch.sources import runs, tables
from tripsearch.storage import durable

_PARTITIONS = [StructField(name, StringType()) for name in ("city", "run")]


@dataclass(frozen=True)
class TripTables:
    """Where the tables of ingested logs live. Read them by the methods, which show the rows of committed runs only."""

    folder: str

    @property
    def kept(self) -> str:
        return f"{self.folder}/kept_points"

    @property
    def by_user(self) -> str:
        return f"{self.folder}/trips_by_user"

    @property
    def simplified(self) -> str:
        return f"{self.folder}/simplified_by_day"

    @property
    def index(self) -> str:
        return f"{self.folder}/point_index"

    @property
    def registry(self) -> str:
        return f"{self.folder}/registry"

    @property
    def late(self) -> str:
        return f"{self.folder}/late_points"

    def read_kept(self, spark: SparkSession, city: str | None = None) -> DataFrame:
        return runs.read(spark, self.folder, "kept_points", city, by_day=False)

    def read_late(self, spark: SparkSession, city: str | None = None) -> DataFrame:
        """Points older than their user's last point in an earlier log: in no trip."""
        return runs.read(spark, self.folder, "late_points", city, by_day=False)

    def read_by_user(self, spark: SparkSession, city: str | None = None) -> DataFrame:
        return runs.read(spark, self.folder, "trips_by_user", city)

    def read_simplified(self, spark: SparkSession, city: str | None = None) -> DataFrame:
        return runs.read(spark, self.folder, "simplified_by_day", city)

    def read_index(self, spark: SparkSession, city: str | None = None) -> DataFrame:
        return runs.read(spark, self.folder, "point_index", city)


def _fingerprint(registry: DataFrame) -> tuple:
    return tuple(registry.agg(F.count("*"), F.bit_xor(F.xxhash64("obd_id", "last_us", "r", "n"))).first())


def ingest(
    raw: DataFrame, folder: str, gap_seconds: int = GAP_SECONDS, city=SHANGHAI, city_name: str = "shanghai", log: str | None = None
) -> TripTables:
    """Write every table of a log once, after the logs ingested before; later steps read what the earlier ones wrote.

    Logs of a city come in the order of time, say month after month. A registry of every user's last trip goes from log to log,
    so ordinals go on and no two trips share an id. A trip that was open at the end of a log and goes on in the next is
    one trip: its earlier points are written again with the new ones, under its new day, and its old day's partitions pass
    to the new run without it. Points older than their user's last one are kept as late.

    ``log`` names the log, by default after the months it covers. Ingesting a log of a known name again replaces it, with
    equal results; if that would change the ordinals that later logs were numbered by, it is refused.
    Nothing is seen by readers before the run is committed as the last step.
    """
    spark, out = raw.sparkSession, TripTables(folder.rstrip("/"))
    if log is None:
        first, last = raw.select(F.date_format(F.min("ts"), "yyyy-MM"), F.date_format(F.max("ts"), "yyyy-MM")).first()
        if first is None:
            return out
        log = first if first == last else f"{first}..{last}"
    version, history = runs.histories(spark, out.folder).get(city_name, (0, []))
    position = next((i for i, h in enumerate(history) if h.log == log), len(history))
    earlier, old, later = history[:position], history[position : position + 1], history[position + 1 :]
    run, known = runs.new_run(position), {h.log for h in earlier}

    def part(path: str, schema: StructType) -> DataFrame:
        """What this run has written, also when that is nothing."""
        held = spark.read.schema(StructType([*schema, *_PARTITIONS])).parquet(path)
        return held.where((F.col("city") == city_name) & (F.col("run") == run)).drop("city", "run")

    def registry(of: str) -> DataFrame:
        return spark.read.schema(CARRY_SCHEMA).parquet(f"{out.registry}/city={city_name}/run={of}")

    kept = clean_positions(raw, city)
    tables.write_kept_points(kept, out.kept, city_name, run)
    carry = registry(earlier[-1].run) if earlier else spark.createDataFrame([], CARRY_SCHEMA)
    numbered, reached, late = extend_trips(part(out.kept, kept.schema), carry, gap_seconds)
    newest_carry(reached.unionByName(carry)).write.parquet(f"{out.registry}/city={city_name}/run={run}")
    late.write.parquet(f"{out.late}/city={city_name}/run={run}")
    if later and _fingerprint(registry(run)) != _fingerprint(registry(old[0].run)):
        raise ValueError(f"{log} has changed; {', '.join(h.log for h in later)} were numbered after it and have to be ingested into a new folder")

    days: list = []
    if earlier:
        numbered = durable(numbered, "numbered")
        ended = F.to_date(F.timestamp_micros("last_us"))
        went_on = durable(
            numbered.join(carry.select("obd_id", "r", ended.alias("was")), ["obd_id", "r"]).select("trip_id", "day", "was").distinct(), "went-on"
        )
        days = sorted(r["was"] for r in went_on.select("was").distinct().collect())  # a calendar's worth
        as_it_was = [replace(h, dropped=tuple(d for d in h.dropped if d[1] in known)) for h in earlier]
        before = runs.read(spark, out.folder, "trips_by_user", city_name, history=as_it_was)
        before = before.where(F.col("day").isin(days)).select(*numbered.columns)
        moved = before.drop("day").join(went_on.select("trip_id", "day"), "trip_id").select(*numbered.columns)
        stay = before.join(went_on.select("trip_id"), "trip_id", "left_anti").select(*numbered.columns)
        numbered = numbered.unionByName(moved).unionByName(stay)
    tables.write_trips_by_user(numbered, out.by_user, city_name, run)
    simplified = simplify_trips(part(out.by_user, numbered.schema))
    tables.write_trips_by_day(simplified, out.simplified, city_name, run=run)
    tables.write_point_index(part(out.simplified, simplified.schema), out.index, city_name, run=run)

    # a repeat takes back what the log's earlier run took over, and later logs keep what they took from it
    def taken(h: runs.Run) -> runs.Run:
        return replace(h, dropped=tuple(d for d in h.dropped if d[1] != log) + tuple((day, log) for day in days))

    now = [taken(h) for h in earlier] + [runs.Run(log, run, old[0].dropped if old else ())] + later
    runs.commit(spark, out.folder, city_name, version + 1, now)
    return out
