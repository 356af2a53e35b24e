"""Cleaning positions and cutting them into trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.functions.folds import evaluate_once

# The city box (lng min, lng max, lat min, lat max) and the gap in seconds.
SHANGHAI = (119.5, 123.5, 30.5, 32.5)
GAP_SECONDS = 1500

# What is known of each user's last trip: time of its last point, ordinal, number of points.
CARRY_SCHEMA = "obd_id string, last_us bigint, r int, n bigint"

# The datum shift is below 0.01 degrees here; the loose box lets a scan skip row groups.
_SHIFT_MARGIN = 0.02


def clean_positions(raw: DataFrame, city: tuple[float, float, float, float] = SHANGHAI) -> DataFrame:
    """Keep points inside the country, convert to GCJ-02, keep points strictly inside the city."""
    x0, x1, y0, y1 = city
    lng, lat = F.col("lng"), F.col("lat")
    near = lng.between(x0 - _SHIFT_MARGIN, x1 + _SHIFT_MARGIN) & lat.between(
        y0 - _SHIFT_MARGIN, y1 + _SHIFT_MARGIN
    )
    glng, glat = geo.to_gcj(lng, lat)
    inside = raw.where(geo.in_country(lng, lat) & near).select("obd_id", "event_id", "ts", "lng", "lat")
    return evaluate_once(inside, lng=glng, lat=glat).where(geo.in_city(lng, lat, city))


def _slotted(points: DataFrame, gap_seconds: int, slot_seconds: int) -> DataFrame:
    width = min(slot_seconds, gap_seconds) * 1_000_000
    return points.withColumn("us", geo.epoch_micros(F.col("ts"))).withColumn(
        "slot", F.floor(F.col("us") / F.lit(width)).cast("bigint")
    )


def _trip_of_slot(slotted: DataFrame, gap_seconds: int, carry: DataFrame | None = None) -> DataFrame:
    """(obd_id, slot, n, last_us, r, base, day): the trip each user's slot belongs to.

    ``carry`` is (obd_id, last_us, r, n) of each user's last trip in earlier data.
    """
    by_user = Window.partitionBy("obd_id").orderBy("slot")
    in_trip = Window.partitionBy("obd_id", "r")
    before = in_trip.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slotted.groupBy("obd_id", "slot").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n")
    )
    if carry is None:
        past_us, past_r, past_n = F.lit(None).cast("bigint"), F.lit(0), F.lit(0)
    else:
        slots = slots.join(
            carry.select("obd_id", F.col("last_us").alias("past_us"), F.col("r").alias("past_r"), F.col("n").alias("past_n")),
            "obd_id", "left",
        )
        past_us = F.col("past_us")
        past_r, past_n = F.coalesce("past_r", F.lit(0)), F.coalesce("past_n", F.lit(0))
    gap = F.col("first_us") - F.coalesce(F.lag("last_us").over(by_user), past_us)
    return (
        slots.withColumn("opens", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0))
        .withColumn("r", (past_r + F.sum("opens").over(by_user)).cast("int"))
        .select(
            "obd_id", "slot", "n", "last_us", "r",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when(F.col("r") == past_r, past_n).otherwise(0)).alias("base"),
            F.to_date(F.timestamp_micros(F.max("last_us").over(in_trip))).alias("day"),
        )
    )


def _numbered(slotted: DataFrame, slots: DataFrame) -> DataFrame:
    in_slot = Window.partitionBy("obd_id", "slot").orderBy("ts", "event_id")
    return slotted.join(slots, ["obd_id", "slot"]).select(
        "obd_id", "r",
        F.concat("obd_id", F.lit(" r"), F.col("r").cast("string")).alias("trip_id"),
        "day",
        (F.col("base") + F.row_number().over(in_slot) - 1).alias("seq"),
        "event_id", "ts", "lng", "lat",
    )


def cut_trips(points: DataFrame, gap_seconds: int = GAP_SECONDS, slot_seconds: int = 600) -> DataFrame:
    """Cut each user's points where more than ``gap_seconds`` pass without one.

    Adds r (trip ordinal of the user), trip_id, day (of the trip's last point) and seq
    (position in the trip). Time is laid out in slots no longer than the gap, so a slot
    can never hold a break: trips are decided on one small row per user and slot, and the
    points are only numbered inside their slot. A user with a third of all points is thus
    spread over as many tasks as the log has slots.
    """
    slotted = _slotted(points, gap_seconds, slot_seconds)
    slots = _trip_of_slot(slotted, gap_seconds).drop("n", "last_us")
    return _numbered(slotted, slots)


def extend_trips(
    points: DataFrame, carry: DataFrame, gap_seconds: int = GAP_SECONDS, slot_seconds: int = 600
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Number the next points of every user after ``carry`` (obd_id, last_us, r, n), the users' last trips so far.

    Returns the numbered points (their day is that of the trip's last point so far), the new carry of the users
    among them, and the points that came too late, older than the user's last numbered point.
    """
    known = points.join(carry.select("obd_id", F.col("last_us").alias("seen_us")), "obd_id", "left")
    is_late = F.col("seen_us").isNotNull() & (geo.epoch_micros(F.col("ts")) < F.col("seen_us"))
    late = known.where(is_late).drop("seen_us")
    slotted = _slotted(known.where(~is_late).drop("seen_us"), gap_seconds, slot_seconds)
    slots = _trip_of_slot(slotted, gap_seconds, carry)
    numbered = _numbered(slotted, slots.drop("n", "last_us"))
    reached = slots.select("obd_id", "last_us", "r", (F.col("base") + F.col("n")).alias("n"))
    return numbered, newest_carry(reached), late


def newest_carry(rows: DataFrame) -> DataFrame:
    """The newest row of every user of several carries put together."""
    last = rows.groupBy("obd_id").agg(F.max(F.struct("last_us", "r", "n")).alias("last"))
    return last.select("obd_id", "last.*")


def continue_trips(
    points: DataFrame, carry: DataFrame, gap_seconds: int = GAP_SECONDS, slot_seconds: int = 600
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``extend_trips``, for live points (without a day, as the trip may go on), with the carry of all users."""
    numbered, reached, late = extend_trips(points, carry, gap_seconds, slot_seconds)
    return numbered.drop("day"), newest_carry(reached.unionByName(carry.select(*reached.columns))), late


def trip_catalog(points: DataFrame) -> DataFrame:
    """One row per trip: (obd_id, r, trip_id, day, n)."""
    return points.groupBy("obd_id", "r", "trip_id", "day").agg(F.count("*").alias("n"))


def known_users(users: DataFrame, catalog: DataFrame) -> DataFrame:
    """Users that own at least one trip."""
    return users.join(catalog.select("obd_id").distinct(), "obd_id", "left_semi")


def trip_polyline(points: DataFrame, block: int = 1024) -> DataFrame:
    """Trips for display: (trip_id, block, path), paths in order, at most ``block`` points a row."""
    return (
        points.groupBy("trip_id", F.floor(F.col("seq") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))).alias("path"))
    )
