"""Layer views from tile pixels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isopleth.functions import colour
from isopleth.operators import raster
from isopleth.plans import layers as ly

D = dt.date
NOW, PAST = D(2024, 3, 10), D(2023, 3, 10)


@pytest.fixture(scope="module")
def maps(spark):
    """Whole degrees: colour (i, 0, 0) stands for [i, i + 1)."""
    rows = [(layer, i, i << 16, float(i), float(i + 1)) for layer in ("sst", "aod", "precip", "salinity") for i in range(30)]
    return spark.createDataFrame(rows, "colormap_id string, pos long, rgb_key long, lo double, hi double")


def pixels(spark, rows):
    """Rows of (layer, date, px, colour index or None for transparent, level)."""
    data = [(layer, day, z, 0, 0, px, 0, i or 0, 0, 0, 0 if i is None else 255) for layer, day, px, i, z in rows]
    schema = "layer string, date date, z int, x long, y long, px long, py long, r int, g int, b int, a int"
    return spark.createDataFrame(data, schema)


def got(df):
    return {(r["layer"], r["side"], r["px"]): (r["display"], r["value"], r["r"], r["b"], r["a"]) for r in df.collect()}


def test_single_day_keeps_its_colours(spark, maps):
    px = pixels(spark, [("sst", NOW, 0, 7, 5), ("sst", NOW, 1, None, 5), ("precip", NOW, 0, 3, 5)])
    out = got(raster.view(px, maps, ly.layer_table(spark), NOW))
    assert out == {("sst", "now", 0): ("raw", 7.5, 7, 0, 255), ("precip", "now", 0): ("raw", 3.5, 3, 0, 255)}


def test_pixels_without_a_value_are_shown(spark, maps):
    fixed = D(2016, 1, 1)
    rows = [("viirs-truecolor", NOW, 0, 200, 8), ("viirs-truecolor", NOW, 1, None, 8), ("sst", NOW, 0, 99, 5), ("nightlights", fixed, 0, 40, 7)]
    rows += [("nightlights", NOW, 0, 41, 7), ("viirs-truecolor", PAST, 0, 9, 8)]
    px, layers = pixels(spark, rows), ly.layer_table(spark)
    composite = {("nightlights", "now", 0): ("raw", None, 40, 0, 255)}
    day = {("viirs-truecolor", "now", 0): ("raw", None, 200, 0, 255), ("sst", "now", 0): ("raw", None, 99, 0, 255)} | composite
    assert got(raster.view(px, maps, layers, NOW)) == day
    assert got(raster.view(px, maps, layers, NOW, years=1)) == day | {("viirs-truecolor", "past", 0): ("raw", None, 9, 0, 255)}
    assert got(raster.view(px, maps, layers, NOW, days=7)) == composite


def test_window_mean_fills_gaps_and_hides_instants(spark, maps):
    rows = [("sst", NOW - dt.timedelta(days=k), px, i, 4) for k, px, i in [(0, 0, 7), (1, 0, 9), (1, 1, 4), (0, 1, None)]]
    rows += [("precip", NOW, 0, 3, 4), ("sst", NOW, 5, 3, 5)]
    out = got(raster.view(pixels(spark, rows), maps, ly.layer_table(spark), NOW, days=2))
    assert out == {("sst", "now", 0): ("mean", 8.5, 8, 0, 235), ("sst", "now", 1): ("mean", 4.5, 4, 0, 235), ("sst", "now", 5): ("mean", 3.5, 3, 0, 235)}


def test_difference_needs_both_dates(spark, maps):
    rows = [("sst", NOW, 0, 10, 2), ("sst", PAST, 0, 7, 2), ("sst", NOW, 1, 10, 2), ("sst", NOW, 2, 7, 2), ("sst", PAST, 2, 7, 2), ("aod", NOW, 0, 2, 2), ("aod", PAST, 0, 2, 2)]
    out = got(raster.view(pixels(spark, rows), maps, ly.layer_table(spark), NOW, years=1, mode="delta"))
    assert out[("sst", "change", 0)] == ("delta", 3.0, colour.DELTA_WARM[0], colour.DELTA_WARM[2], 190)
    assert out[("sst", "change", 2)][1:] == (0.0, 0, 0, 0)
    assert out[("aod", "now", 0)][0] == "raw" and len(out) == 3


def test_side_by_side(spark, maps):
    rows = [("aod", NOW, 0, 2, 2), ("aod", PAST, 0, 5, 2), ("aod", PAST, 1, 6, 2)]
    out = got(raster.view(pixels(spark, rows), maps, ly.layer_table(spark), NOW, years=1, mode="split"))
    assert {k[1:]: v[1] for k, v in out.items()} == {("now", 0): 2.5, ("past", 0): 5.5, ("past", 1): 6.5}


def test_monthly_layers_read_published_months_once(spark, maps):
    rows = [("salinity", D(2024, 3, 1), 0, 4, 2), ("salinity", D(2024, 2, 1), 0, 8, 2), ("salinity", D(2024, 1, 1), 0, 1, 2)]
    out = raster.view(pixels(spark, rows), maps, ly.layer_table(spark), NOW, days=30, latest=D(2024, 7, 1)).collect()
    assert [(r["value"], r["n"]) for r in out] == [(6.5, 2)]
    early = raster.view(pixels(spark, rows), maps, ly.layer_table(spark), NOW, latest=NOW).collect()
    assert [(r["value"], r["n"]) for r in early] == [(8.5, 1)]


def test_window_of_one_day_of_difference_is_zero_against_itself(spark, maps):
    rows = [("sst", NOW - dt.timedelta(days=k), 0, 5 + k, 3) for k in range(8)]
    px = pixels(spark, rows)
    twice = px.unionByName(px.withColumn("date", F.add_months("date", -12)))
    out = raster.view(twice, maps, ly.layer_table(spark), NOW, days=7, years=1, mode="delta").collect()
    assert [(r["value"], r["n"]) for r in out] == [(0.0, 7)]


def test_ensemble_views(spark, maps):
    members = ["a", "b", "c"]
    rows = [("a", NOW, 0, 20, 1), ("b", NOW, 0, 21, 1), ("c", NOW, 0, None, 1), ("a", NOW, 1, 5, 1), ("a", PAST, 1, 5, 1), ("b", PAST, 1, 5, 1)]
    one = maps.filter("colormap_id = 'sst'")
    mean = raster.ensemble_view(pixels(spark, rows), one, members, NOW).collect()
    assert [(r["px"], r["value"], r["n_members"], r["r"], r["a"]) for r in mean] == [(0, 21.0, 2, 21, 235)]
    spread = raster.ensemble_view(pixels(spark, rows), one, members, NOW, "spread").collect()
    assert [(r["px"], r["value"]) for r in spread] == [(0, 0.5)] and spread[0]["a"] > 0
