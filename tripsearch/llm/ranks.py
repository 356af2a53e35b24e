"""Places of rows in the order of their group, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.storage import durable


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, the place (from 0) in the ascending order of their group, nulls first, and the table
    (group.., size) of the groups.

    ``rows`` is a written table. It is range partitioned by group and order, so a group of any size lies over as many partitions
    as it fills; each partition numbers its own rows and adds how many of the group lie in the partitions before.
    Rows equal in group and order take neighbouring places in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row")
    parted = durable(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    counts = parted.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    here = Window.partitionBy("_part", *group).orderBy(*keys[len(group) :], "_row")
    local = parted.withColumn("_here", F.row_number().over(here) - 1)
    o = offsets.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_before")
    same: list[Column] = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]]
    placed = local.join(o, reduce(lambda a, b: a & b, same)).withColumn("pos", F.col("_before") + F.col("_here"))
    return placed.select(*rows.columns, "pos"), offsets.groupBy(*group).agg(F.sum("_n").alias("size"))
