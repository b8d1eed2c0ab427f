"""Missing input and longitudes in 0..360: null in, null out."""

import datetime as dt

from pyspark.sql import functions as F

from isopleth.functions import colour, dates, geo
from isopleth.operators import points, series


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def null(kind):
    return F.lit(None).cast(kind)


def test_tiles(spark):
    lon, nan = F.lit(190.0), F.lit(float("nan"))
    assert one(spark, geo.tile_x(lon, 3), geo.geo_tile_x(lon, 3)) == one(spark, geo.tile_x(F.lit(-170.0), 3), geo.geo_tile_x(F.lit(-170.0), 3))
    assert one(spark, geo.geo_tile_x(F.lit(180.0), 3)) == (15,)
    for missing in (null("double"), nan, F.lit(float("inf")), F.lit(float("-inf"))):
        got = one(
            spark, geo.tile_x(missing, 3), geo.tile_y(missing, 3), geo.geo_tile_x(missing, 3), geo.geo_tile_y(missing, 3),
            geo.pixel_x(missing, F.lit(0), 3), geo.pixel_y(missing, F.lit(0), 3),
        )
        assert got == (None,) * 6


def test_density_leaves_out_rows_without_a_place(spark):
    inf = float("inf")
    rows = [(1, 10.0, 10.0), (1, None, 10.0), (1, 10.0, None), (1, 370.0, 10.0), (1, inf, 10.0), (1, -inf, 10.0), (1, 10.0, inf), (1, 10.0, -inf), (1, inf - inf, 10.0)]
    df = spark.createDataFrame(rows, "k long, lon double, lat double")
    assert [r["n"] for r in points.density(df, 4, ["k"]).collect()] == [2]


def test_known_places_need_no_null_filter(spark):
    """Clamps of known places are never null, so a join on them copies no formula into a filter."""
    df = spark.createDataFrame([(10.0, 10.0), (float("nan"), 10.0)], "lon double, lat double")
    known = geo.located(df).select(geo.tile_x("lon", 3, known=True).alias("x"), geo.pixel_x("lon", F.lit(0), 3, known=True).alias("px"))
    assert [f.nullable for f in known.schema] == [False, False] and known.count() == 1
    assert df.select(geo.tile_x("lon", 3).alias("x")).filter("x is null").count() == 1


def test_colours(spark):
    hidden = (0, 0, 0, 0)
    got = one(spark, colour.ramp_colour("precip", null("double")), colour.delta_colour(null("double")), colour.delta_direction(null("double")))
    assert tuple(got[0]) == hidden and tuple(got[1])[3] == 0 and got[2] is None
    for odd in (F.lit(float("nan")), F.lit(float("inf"))):
        got = one(spark, colour.ramp_colour("precip", odd), colour.delta_colour(odd), colour.delta_direction(odd))
        assert tuple(got[0]) == tuple(got[1]) == hidden and got[2] is None


def test_dates(spark):
    latest = F.lit("2024-01-30").cast("date")
    assert one(spark, dates.month_snap(null("date"), latest), dates.step_date(null("date"), "month", 1, latest)) == (None, None)


def test_early_warning_over_gaps(spark):
    months = [dt.date(2000 + m // 12, m % 12 + 1, 1) for m in range(60) if m % 12 < 6]
    rows = [("a", d, float(i * i % 7)) for i, d in enumerate(months)]
    df = spark.createDataFrame(rows, "s string, day date, v double")
    assert series.early_warning(df, ["s"], "day", "v", 12).count() == 0
    assert {r["month"].month for r in series.early_warning(df, ["s"], "day", "v", 6).collect()} == {6}


def test_fingerprint_wraps(spark):
    rows = [(dt.date(2000, 1, 1), lon, 0.0, v) for lon, v in ((350.0, 3.0), (10.0, 1.0), (180.0, 0.0))]
    df = spark.createDataFrame(rows, "day date, lon double, lat double, v double")
    west = df.withColumn("lon", geo.wrap_lon("lon"))
    box = (-20, -10, 0, 10)
    first, second = (series.fingerprint(d, "day", "lon", "lat", "v", box).collect() for d in (df, west))
    assert first == second
    assert series.fingerprint(df, "day", "lon", "lat", "v", (340, -10, 20, 10)).count() == 1
