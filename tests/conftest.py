from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tripsearch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def make_points(spark):
    """Trip point table from {trip_id: [(lng, lat), ..]}."""

    def build(trips, day="2024-01-01"):
        rows = [
            (trip, i, float(x), float(y), day) for trip, path in trips.items() for i, (x, y) in enumerate(path)
        ]
        return spark.createDataFrame(rows, "trip_id string, seq bigint, lng double, lat double, day string").selectExpr(
            "trip_id", "seq", "lng", "lat", "cast(day as date) as day"
        )

    return build
