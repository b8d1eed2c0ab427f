"""Properties that hold for any input."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isopleth.functions import dates, geo
from isopleth.functions.geo import Grid

DAYS = st.dates(dt.date(1960, 1, 1), dt.date(2060, 12, 31))


@given(st.integers(1, 730), st.one_of(st.none(), st.integers(1, 40)))
def test_offsets_span_the_window_evenly(days, cap):
    got = dates.window_offsets(days, cap)
    assert got[0] == 0 and got == sorted(set(got))
    assert len(got) == (days if cap is None else min(days, cap))
    if len(got) > 1:
        assert got[-1] == days - 1
        gaps = {b - a for a, b in zip(got, got[1:])}
        assert max(gaps) - min(gaps) <= 1


@given(DAYS, st.sampled_from(dates.COMPARE_YEARS))
def test_compare_date_keeps_month_and_day(day, years):
    got = dates.compare_date_value(day, years)
    assert (got.year, got.month) == (day.year - years, day.month)
    assert got.day == (28 if (day.month, day.day) == (2, 29) else day.day)


@given(DAYS, DAYS)
def test_month_snap_is_a_finished_month(day, latest):
    got = dates.month_snap_value(day, latest)
    assert got.day == 1 and got <= day and (got.year, got.month) < (latest.year, latest.month)
    if (day.year, day.month) < (latest.year, latest.month):
        assert (got.year, got.month) == (day.year, day.month)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(DAYS, DAYS), min_size=1, max_size=40))
def test_columns_agree_with_values(spark, pairs):
    df = spark.createDataFrame(pairs, "day date, latest date")
    rows = df.select(
        "day", "latest",
        dates.month_snap("day", F.col("latest")).alias("snap"),
        dates.compare_date("day", 5).alias("past"),
        dates.window_sample_dates("day", 45).alias("dates"),
    ).collect()
    for r in rows:
        assert r["snap"] == dates.month_snap_value(r["day"], r["latest"])
        assert r["past"] == dates.compare_date_value(r["day"], 5)
        assert r["dates"] == dates.sample_date_values(r["day"], 45)


def degrees(limit):
    """Micro-degrees: finer differences vanish when a coordinate is shifted by 90 or 180."""
    return st.integers(-limit * 10**6, limit * 10**6).map(lambda n: n / 1e6)


PLACES = st.lists(st.tuples(degrees(180), degrees(90), st.integers(0, 8)), min_size=1, max_size=60)


@settings(max_examples=5, deadline=None)
@given(PLACES)
def test_a_tile_contains_its_points(spark, places):
    df = spark.createDataFrame(places, "lon double, lat double, z int")
    at = df.withColumn("x", geo.tile_x("lon", "z")).withColumn("y", geo.tile_y("lat", "z"))
    at = at.withColumn("b", geo.tile_bounds("x", "y", "z"))
    at = at.withColumn("px", geo.pixel_x("lon", "x", "z")).withColumn("py", geo.pixel_y("lat", "y", "z"))
    for r in at.collect():
        span = 288.0 / 2 ** r["z"]
        assert 0 <= r["x"] < math.ceil(360 / span) and 0 <= r["y"] < math.ceil(180 / span)
        assert r["b"]["west"] <= r["lon"] <= r["b"]["east"] and r["b"]["south"] <= r["lat"] <= r["b"]["north"]
        assert 0 <= r["px"] <= 511 and 0 <= r["py"] <= 511


@settings(max_examples=5, deadline=None)
@given(PLACES)
def test_a_parent_tile_covers_its_children(spark, places):
    df = spark.createDataFrame(places, "lon double, lat double, z int")
    cols = [c for z in (3, 4) for c in (geo.geo_tile_x("lon", z).alias(f"x{z}"), geo.geo_tile_y("lat", z).alias(f"y{z}"))]
    for r in df.select(*cols).collect():
        assert (r["x4"] // 2, r["y4"] // 2) == (r["x3"], r["y3"])


@settings(max_examples=5, deadline=None)
@given(st.lists(degrees(10_000), min_size=1, max_size=60))
def test_wrapped_longitudes_are_on_the_globe(spark, lons):
    df = spark.createDataFrame([(x,) for x in lons], "lon double").withColumn("w", geo.wrap_lon("lon"))
    for r in df.collect():
        assert -180 <= r["w"] < 180
        turns = (r["lon"] - r["w"]) / 360
        assert math.isclose(turns, round(turns), abs_tol=1e-6)


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 50), st.integers(1, 50))
def test_cell_centres_fall_in_their_cell(spark, nx, ny):
    g = Grid(-40.0, 20.0, 75.0, 75.0, nx, ny)
    df = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    out = df.select("ix", "iy", g.ix(g.centre_lon("ix")).alias("jx"), g.iy(g.centre_lat("iy")).alias("jy"))
    assert out.filter("ix <> jx or iy <> jy").count() == 0
