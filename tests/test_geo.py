import math

import pytest

from tests import plain
from tripsearch.functions import geo
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("dx,dy,want", [
    (0, 1, 0), (1, 1, 45), (1, 0, 90), (1, -1, 135), (0, -1, 180), (-1, -1, 225), (-1, 0, 270), (-1, 1, 315), (0, 0, 0),
])
def test_heading_compass(spark, dx, dy, want):
    assert one(spark, geo.heading(F.lit(1.0), F.lit(2.0), F.lit(1.0 + dx), F.lit(2.0 + dy))) == pytest.approx(want)


def test_haversine(spark):
    got = one(spark, geo.haversine_m(F.lit(121.3), F.lit(31.2), F.lit(121.4), F.lit(31.3)))
    assert got == pytest.approx(plain.metres((121.3, 31.2), (121.4, 31.3)))
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(
        6371000 * math.pi / 2
    )


def test_line_distance(spark):
    d = lambda *v: one(spark, geo.line_distance(*[F.lit(float(x)) for x in v]))
    assert d(0, 1, 0, 0, 2, 0) == 1.0
    assert d(5, 1, 0, 0, 2, 0) == 1.0  # the line does not end
    assert d(3, 4, 0, 0, 0, 0) == 5.0


def test_foot_is_not_clamped(spark):
    f = lambda *v: one(spark, geo.foot_fraction(*[F.lit(float(x)) for x in v]))
    assert f(4, 1, 0, 0, 2, 0) == 2.0
    assert f(1, 1, 3, 3, 3, 3) is None


def test_country_and_city_edges(spark):
    inside = lambda x, y: one(spark, geo.in_country(F.lit(x), F.lit(y)))
    assert inside(72.004, 0.8293) and inside(137.8347, 55.8281)
    assert not inside(72.0039, 31.0) and not inside(121.0, 55.8282)
    box = (119.5, 123.5, 30.5, 32.5)
    city = lambda x, y: one(spark, geo.in_city(F.lit(x), F.lit(y), box))
    assert city(119.500001, 31.0) and not city(119.5, 31.0) and not city(121.0, 32.5)


def test_gcj_shift_is_a_few_hundred_metres(spark):
    lng, lat = geo.to_gcj(F.lit(121.4737), F.lit(31.2304))
    row = spark.range(1).select(lng.alias("x"), lat.alias("y")).first()
    assert row["x"] == round(row["x"], 6)
    assert 100 < plain.metres((121.4737, 31.2304), (row["x"], row["y"])) < 700


def test_times(spark):
    assert one(spark, geo.epoch_seconds(F.lit("2015-04-01 00:00:10"))) == 1427846410
    assert one(spark, geo.epoch_seconds(F.lit("2015-04-01T"))) is None
    later, earlier = geo.parse_time(F.lit("2015-04-01 00:25:01")), geo.parse_time(F.lit("2015-04-01 00:00:00"))
    assert one(spark, geo.seconds_between(later, earlier)) == 1501.0
