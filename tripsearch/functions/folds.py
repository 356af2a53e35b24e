"""Small helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point_array(points: list[tuple[float, float]]) -> Column:
    """Query points as a constant array of (lng, lat)."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in points])


def double_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns as a generated row.

    Later filters on a projected column are pushed below it with the whole expression
    copied in. They cannot pass a generator, so each expression runs once per row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))
