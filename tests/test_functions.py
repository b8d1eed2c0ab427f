import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from isopleth.functions import colour, dates, geo, missing, text
from isopleth.plans import layers

D = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def date(s):
    return F.lit(s).cast("date")


def test_add_days_and_compare_date(spark):
    r = one(
        spark,
        dates.add_days(date("2026-01-01"), -1),
        dates.compare_date(date("2024-02-29"), 1),
        dates.compare_date(date("2024-02-29"), 20),
        dates.compare_date(date("2024-03-15"), 5),
    )
    assert list(r) == [D(2025, 12, 31), D(2023, 2, 28), D(2004, 2, 28), D(2019, 3, 15)]
    assert dates.compare_date_value(D(2024, 2, 29), 20) == D(2004, 2, 28)


def test_month_snap(spark):
    latest = date("2026-07-21")
    r = one(
        spark,
        dates.month_snap(date("2024-03-15"), latest),
        dates.month_snap(date("2026-07-10"), latest),
        dates.month_snap(date("2026-06-30"), latest),
    )
    assert list(r) == [D(2024, 3, 1), D(2026, 6, 1), D(2026, 6, 1)]
    assert dates.month_snap_value(D(2026, 1, 5), D(2026, 1, 20)) == D(2025, 12, 1)


def test_stepper(spark):
    latest = date("2026-07-21")
    step = lambda d, unit, n: dates.step_date(date(d), unit, n, latest)
    r = one(
        spark,
        step("2026-03-31", "month", -1),
        step("2024-02-29", "year", -1),
        step("2026-07-21", "day", 1),
        step("2000-01-01", "day", -1),
        step("2024-01-31", "month", 1),
    )
    assert list(r) == [D(2026, 2, 28), D(2023, 2, 28), D(2026, 7, 21), D(2000, 1, 1), D(2024, 2, 29)]


@pytest.mark.parametrize("days,count,last", [(1, 1, "2026-07-21"), (30, 12, "2026-06-22"), (365, 12, "2025-07-22"), (2, 2, "2026-07-20")])
def test_window_sample_dates(spark, days, count, last):
    got = one(spark, dates.window_sample_dates(date("2026-07-21"), days, 12))[0]
    assert got == dates.sample_date_values(D(2026, 7, 21), days, 12)
    assert len(got) == count == len(set(got))
    assert got[0] == D(2026, 7, 21) and got[-1] == D.fromisoformat(last)


def test_monthly_window_dates():
    got = dates.sample_date_values(D(2023, 6, 15), 60, 12, monthly=True, latest=D(2026, 7, 21))
    assert all(d.day == 1 for d in got) and len(got) == len(set(got)) <= 3
    repeated = dates.sample_date_values(D(2023, 6, 15), 60, 12, monthly=True, latest=D(2026, 7, 21), dedupe=False)
    assert len(repeated) == 12 and set(repeated) == set(got)
    assert len(dates.sample_date_values(D(2023, 6, 15), 60)) == 60


def test_decimal_year(spark):
    r = one(spark, dates.decimal_year(date("2005-01-01")), dates.decimal_year(date("2004-12-31")))
    assert r[0] == 2005 and math.isclose(r[1], 2004 + 365 / 366)


def test_instants_do_not_follow_the_session_zone(spark):
    ts = F.lit("1969-12-31T23:30:00.25").cast("timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            r = one(spark, dates.micros(ts), F.unix_micros(dates.utc(ts)), dates.utc_date(dates.utc(ts)))
            assert list(r) == [-1_799_750_000, -1_799_750_000, D(1969, 12, 31)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels(spark):
    r = one(spark, dates.window_label(F.lit(1)), dates.window_label(F.lit(30)))
    assert list(r) == ["single day", "past 30 days"]


def test_tile_counts(spark):
    rows = spark.range(9).select(*geo.tile_counts(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [
        (2, 1), (3, 2), (5, 3), (10, 5), (20, 10), (40, 20), (80, 40), (160, 80), (320, 160),
    ]


def test_tile_bounds_and_address(spark):
    edge = one(spark, geo.tile_bounds(F.lit(1), F.lit(0), 0))[0]
    assert (edge["west"], edge["east"]) == (108, 396)
    at = lambda lon, lat, z: (geo.tile_x(F.lit(float(lon)), z), geo.tile_y(F.lit(float(lat)), z))
    assert tuple(one(spark, *at(170, 0, 2))) == (4, 1)
    assert tuple(one(spark, *at(180, -90, 3))) == (9, 4)
    assert tuple(one(spark, *at(-180, 90, 3))) == (0, 0)


def test_pixels_are_clamped(spark):
    r = one(spark, geo.pixel_x(F.lit(180.0), F.lit(9), 3), geo.pixel_y(F.lit(90.0), F.lit(0), 3))
    assert r[1] == 0 and 0 <= r[0] <= 511


def test_wrap(spark):
    r = one(spark, *[geo.wrap_lon(F.lit(float(x))) for x in (180, -180, -190, 540, 179.5)])
    assert list(r) == [-180, -180, 170, -180, 179.5]


def test_grid_from_centres():
    grid = geo.Grid.from_centres(0.5, 0.5, 9.5, 4.5, 10, 5)
    assert (grid.west, grid.east, grid.south, grid.north, grid.dlon) == (0, 10, 0, 5, 1)


def test_delta_colours(spark):
    up, down, none = one(spark, *[colour.delta_colour(F.lit(float(x)), 4) for x in (3, -3, 0)])
    assert up["r"] > up["b"] and up["a"] > 150
    assert down["b"] > down["r"]
    assert none["a"] == 0


def test_spread_colours(spark):
    none, top, missing_ = one(
        spark, *[colour.spread_colour(x) for x in (F.lit(0.0), F.lit(2.0), F.lit(None).cast("double"))]
    )
    assert none["a"] == 0 and top["a"] > 150 and missing_["a"] == 0
    assert (top["r"], top["g"], top["b"]) == (240, 59, 46)


def test_ramp(spark):
    low, mid, high = one(spark, *[colour.ramp_colour("sst", F.lit(t)) for t in (-1.0, 0.125, 2.0)])
    assert tuple(low)[:3] == (49, 54, 149)
    assert tuple(mid)[:3] == (83, 114, 179)
    assert tuple(high) == (165, 0, 38, 225)


def test_rate_classes(spark):
    rates = spark.createDataFrame([(None,), (-3.0,), (-0.75,), (0.2,)], "r double")
    rows = rates.select(colour.rate_class("r"), colour.rate_colour("r")).collect()
    assert [r[0] for r in rows] == ["nodata", "thinning", "thinning", "stable"]
    assert rows[1][1]["g"] == pytest.approx(0.15) and rows[2][1]["g"] == pytest.approx(0.45)
    assert rows[0][1]["a"] == pytest.approx(0.35)


def test_missing(spark):
    df = spark.createDataFrame([("1.5",), ("***",), ("",), ("NaN",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(missing.number("s")).collect()] == [1.5, None, None, None, None, None]
    r = one(spark, missing.nan_to_null(F.lit(float("nan"))), missing.finite(F.lit(float("inf"))))
    assert list(r) == [None, False]


def test_search_text(spark):
    df = spark.createDataFrame([("Sea Ice", None), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(text.contains_ci(text.haystack("a", "b"), "SEA ice")).collect()]
    assert got == [True, False]


def test_posture_matrix(spark):
    rows = {r["id"]: r["posture"] for r in layers.with_posture(layers.layer_table(spark)).collect()}
    for name in ("sst", "sst-anom", "seaice", "snow", "lst", "salinity"):
        assert rows[name] == "both"
    for name in ("chlor", "aod"):
        assert rows[name] == "mean only"
    for name in ("viirs-truecolor", "nightlights", "precip", "precip-30min"):
        assert rows[name] == "neither"


def test_display_rules(spark):
    table = layers.layer_table(spark)
    shown = lambda **k: {r["id"]: r["display"] for r in layers.with_posture(table, **k).collect()}
    windowed = shown(window_days=30)
    assert windowed["viirs-truecolor"] == windowed["precip"] == "suppressed"
    assert windowed["sst"] == windowed["chlor"] == "mean"
    assert windowed["gpcp"] == "grid" and windowed["nightlights"] == "raw"
    delta = shown(window_days=1, comparing=True, mode="delta")
    assert delta["sst"] == "delta" and delta["aod"] == "raw"
    split = shown(window_days=30, comparing=True, mode="split")
    assert split["sst"] == "mean"


def test_date_rule(spark):
    rows = {r["id"]: r["dateless_reason"] for r in layers.with_date_rule(layers.layer_table(spark)).collect()}
    assert rows["sst"] is None and rows["gpcp"] == "climatology" and rows["nightlights"] == "fixed composite"
    assert one(spark, layers.point_layer_reason(F.lit("argo")))[0] == "latest positions"
