"""The named jobs on tiny landed files, and the dashboard numbers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from test_sources import put

from isopleth import dashboards, jobs
from isopleth.sources import sinks, tables

D = dt.date


def test_emitters(spark, tmp_path):
    def asset(name, q, place=True):
        return {"Name": name, "Country": "X", "Sector": "power", "Centroid": {"Geometry": [1.23456, 2.0]} if place else None,
                "EmissionsSummary": [{"Gas": "co2e_100yr", "EmissionsQuantity": q}]}

    put(tmp_path, "in/p1.json", {"assets": [asset("a", 9e6), asset("b", 99e6, place=False), asset("c", 3e6), asset("d", 5e6)]})
    rows = jobs.emitters(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-30", 2024, n=2).orderBy(F.desc("mt_co2e")).collect()
    assert [(r["name"], r["mt_co2e"], r["lon"]) for r in rows] == [("a", 9.0, 1.2346), ("d", 5.0, 1.2346)]
    _, meta = sinks.read_snapshot(spark, str(tmp_path / "out"))
    assert meta.first()["year"] == "2024"


def test_floats(spark, tmp_path):
    rows = [["1", 10, 20, "2024-01-25T00:00:00Z"], ["1", 11, 21, "2024-01-28T06:00:00Z"], ["2", None, 5, "2024-01-29T00:00:00Z"], ["3", 1, 1, "2024-01-01T00:00:00Z"], ["1", 11, 21, "2024-01-28T06:00:00Z"]]
    path = put(tmp_path, "argo.json", {"table": {"rows": rows}})
    got = jobs.floats(spark, path, str(tmp_path / "out"), "2024-01-30").collect()
    assert [tuple(r) for r in got] == [(21.0, 11.0, "1", D(2024, 1, 28))]


def test_transports(spark, tmp_path):
    start = dt.datetime(2004, 4, 2)
    rows = [(start + dt.timedelta(hours=12 * i), float(i), math.nan if i < 20 else 1.0, None, 2.0) for i in range(45)]
    schema = "time timestamp_ntz, moc_mar_hc10 double, t_gs10 double, t_ek10 double, t_umo10 double"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    got = jobs.transports(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-30").orderBy("t").collect()
    assert [tuple(r) for r in got] == [(D(2004, 4, 7), 9.5, None, None, 2.0), (D(2004, 4, 17), 29.5, 1.0, None, 2.0)]


def test_sea_level(spark, tmp_path):
    line = lambda y, *v: ",".join([str(y)] + [x for e in v for x in ("", str(e), "")])
    sheet = put(tmp_path, "b.csv", "\n".join([line("y", *"abcdefg"), line(1900, -170, -160, 1, 2, 3, 4, 5), line(2005, -22.8, 0, 5, 50, 9, 9, 1)]))
    # columns 2, 5, 8, ... hold the means
    content = [r.split(",") for r in (tmp_path / "b.csv").read_text().splitlines()]
    assert content[1][2] == "-170" and content[1][5] == "-160"
    missions = put(tmp_path, "m.csv", "#x\nyear,a,b\n2004.9,1,\n2005.01,3,\n2005.01,,9\n2006,,4\n")
    budget, altimetry = jobs.sea_level(spark, sheet, missions, str(tmp_path / "out"), "2024-01-30")
    assert [r["v"] for r in altimetry.orderBy("position").collect()] == [-24.8, -22.8, -16.8, -21.8]
    numbers = dashboards.sea_level_numbers(budget, altimetry).first()
    assert (numbers["total_rise"], numbers["driver"], numbers["driver_rise"]) == (pytest.approx(147.2), "glaciers", 48.0)


def test_inventory(spark, tmp_path):
    a = put(tmp_path, "a.csv", "rgi_id,cenlon,cenlat,area_km2,more\nx,1,2,3.5,z\ny,1,2,bad,z\nw,5,6,1.5,z\n")
    rates = str(tmp_path / "rates")
    spark.createDataFrame([("x", tables.RATE_PERIOD, -0.51234), ("w", tables.RATE_PERIOD, math.nan), ("w", "other", 1.0)], "rgi_id string, period string, dhdt double").write.parquet(rates)
    rows, totals = jobs.inventory(spark, [a], rates, str(tmp_path / "out"), "2024-01-30")
    assert sorted((r["rgi_id"], r["dhdt"]) for r in rows.collect()) == [("w", None), ("x", -0.512)]
    assert tuple(totals.first()) == (2, 5.0, 1, 1)
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).first()["rgi_id"] == "y"


def test_temperature(spark, tmp_path):
    line = lambda y, v: ",".join([str(y), *["0"] * 12, str(v), *["0"] * 5])
    whole = put(tmp_path, "a.csv", "\n".join(["banner", line("Year", "J-D"), line(1880, -0.18), line(2024, 1.28), line(2025, 1.19), line(2026, "***")]))
    land = put(tmp_path, "b.csv", "\n".join([line(1880, -0.39), line(2024, 1.9), line(1990, 0.4)]))
    series = jobs.temperature(spark, whole, land, str(tmp_path / "out"), "2026-01-30")
    assert sorted(tuple(r) for r in series.collect() if r["land_only"] is not None) == [(1880, -0.18, -0.39), (2024, 1.28, 1.9)]
    assert series.count() == 3
    n = dashboards.temperature_numbers(series).first()
    assert (n["land_ocean"], n["land_only"], n["since_start"], n["year"]) == (1.19, 1.9, pytest.approx(1.37), 2025)


def cube(spark, path, dataset, rows):
    tables.write_cube(spark.createDataFrame(rows, "time date, lon double, lat double, value double"), path, dataset, cell=("lat", "lon"))


def test_global_climatology(spark, tmp_path):
    rows = [(D(2000, m, 1), lon, lat, None if (lon, m) == (1.25, 2) else 2.0 + m) for m in (1, 2) for lon, lat in [(1.25, 1.25), (358.75, 1.25)]]
    cube(spark, str(tmp_path / "cube"), "gpcp", rows)
    dense = jobs.climatology(spark, str(tmp_path / "cube"), "gpcp", str(tmp_path / "out"), "2024-01-30")
    assert dense.count() == 144 * 72
    got = {(r["ix"], r["iy"]): r["value"] for r in dense.filter("value is not null").collect()}
    assert got == {(72, 36): round(3 * 365.25), (71, 36): round(3.5 * 365.25)}


def test_regional_climatology_keeps_the_outer_cells(spark, tmp_path):
    rows = [(D(2000, 1, 1), -40.375 + 0.25 * i, 25.375 + 0.25 * j, float(i + j)) for i in range(9) for j in range(5)]
    cube(spark, str(tmp_path / "cube"), "eobs", rows)
    dense = jobs.climatology(spark, str(tmp_path / "cube"), "eobs", str(tmp_path / "out"), "2024-01-30")
    assert dense.count() == 45 and dense.filter("value is null").count() == 0
    assert dense.filter("ix = 8 and iy = 4").first()["value"] == round(12 * 365.25)
    meta = sinks.read_snapshot(spark, str(tmp_path / "out"))[1].first()
    assert float(meta["dlon"]) == 0.25 and meta["nx"] == "9"


def test_curvilinear_climatology(spark, tmp_path):
    rows = [(D(1991, 1, 1), 6 + 0.0201 * i + 0.0007 * j, 46 + 0.0203 * j - 0.0004 * i, 100.0) for i in range(12) for j in range(10)]
    cube(spark, str(tmp_path / "cube"), "meteoswiss", rows)
    dense = jobs.climatology(spark, str(tmp_path / "cube"), "meteoswiss", str(tmp_path / "out"), "2024-01-30")
    filled = dense.filter("value is not null")
    assert filled.count() > 90 and {r["value"] for r in filled.collect()} == {100}


def test_species(spark, tmp_path):
    spark.createDataFrame([([1, 10],), ([1],), ([2, 2],), ([],)], "taxon_keys array<long>").write.parquet(str(tmp_path / "occ"))
    groups = spark.createDataFrame([("K", 1, "a"), ("K", 2, "b"), ("G", 10, "c"), ("G", 11, "d")], "label string, key long, name string")
    got = jobs.species(spark, str(tmp_path / "occ"), groups, str(tmp_path / "out"), "2024-01-30", "K").collect()
    assert {(r["key"], r["records"]) for r in got} == {(1, 2), (2, 1), (10, 1), (11, 0)}
    assert {(r["total"], r["unplaced"]) for r in got} == {(4, 1)}


def test_transport_numbers(spark):
    rows = [(D(2004, 5, 1), 18.0), (D(2008, 12, 31), 20.0), (D(2009, 1, 1), 99.0), (D(2019, 1, 1), 16.0), (D(2024, 3, 1), 14.0), (D(2025, 1, 1), None)]
    n = dashboards.transport_numbers(spark.createDataFrame(rows, "t date, moc double")).first()
    assert (n["early"], n["recent"], n["change"], n["latest"], n["latest_at"]) == (19.0, 15.0, -4.0, 14.0, D(2024, 3, 1))
