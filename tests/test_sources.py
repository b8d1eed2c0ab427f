"""Tiny files in each landed format."""

import datetime as dt
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from isopleth.functions.geo import Grid
from isopleth.operators import colormap, grid
from isopleth.sources import documents, raster, sinks, tables
from isopleth.sources.lines import numbered

D = dt.date


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, (dict, list)):
        content = json.dumps(content)
    path.write_text(content)
    return str(path)


def test_asset_pages(spark, tmp_path):
    def asset(name, place, *gases):
        return {"Name": name, "Country": "X", "Centroid": place, "EmissionsSummary": [{"Gas": g, "EmissionsQuantity": q} for g, q in gases]}

    put(tmp_path, "p1.json", {"assets": [
        asset("n" * 100, {"Geometry": [1.5, 2.5]}, ("ch4", 1.0), ("co2e_100yr", 7e6), ("co2e_100yr", 1.0)),
        asset(None, None, ("co2e_100yr", 3.0)),
    ]})
    put(tmp_path, "p2.json", {"assets": [asset("b", {"Geometry": [0.0, 0.0]}, ("ch4", 1.0))]})
    put(tmp_path, "p3.json", {"assets": []})
    rows = sorted(documents.read_asset_pages(spark, str(tmp_path)).collect(), key=lambda r: r["name"])
    assert [(r["name"][:3], len(r["name"]), r["lon"], r["q"], r["sector"]) for r in rows] == [
        ("", 0, None, 3.0, ""), ("b", 1, 0.0, None, ""), ("nnn", 100, 1.5, 7e6, ""),
    ]


def test_row_table_and_positional_rows(spark, tmp_path):
    path = put(tmp_path, "a.json", {"table": {"rows": [["690", 1.5, None, "2024-01-02T03:04:05Z"], ["691", 2, 3, "bad"]]}})
    fields = {"id": "string", "lat": "double", "lon": "double", "ts": "timestamp"}
    rows = documents.read_row_table(spark, path, fields).collect()
    assert [(r["id"], r["lat"], r["lon"], r["ts"] is None) for r in rows] == [("690", 1.5, None, False), ("691", 2.0, 3.0, True)]
    path = put(tmp_path, "b.json", {"fields": [], "floats": [[-10.25, 3.5, "690", "2024-01-02"]]})
    row = documents.read_positional(spark, path, "floats", {"lon": "double", "lat": "double", "id": "string", "date": "date"}).first()
    assert tuple(row) == (-10.25, 3.5, "690", D(2024, 1, 2))


def test_parallel_arrays_and_components(spark, tmp_path):
    path = put(tmp_path, "s.json", {"units": "Sv", "t": ["2004-04-07", "2004-04-17"], "moc": [14.5, None], "altimetry": {"t": [2005.0, 2005.0], "v": [1.0, 2.0]}})
    rows = documents.read_parallel(spark, path, {"t": "date", "moc": "double"}, scalars={"units": "string"}).collect()
    assert [tuple(r) for r in rows] == [("Sv", 0, D(2004, 4, 7), 14.5), ("Sv", 1, D(2004, 4, 17), None)]
    alt = documents.read_parallel(spark, path, {"t": "double", "v": "double"}, inside="altimetry").collect()
    assert [tuple(r) for r in alt] == [(0, 2005.0, 1.0), (1, 2005.0, 2.0)]
    path = put(tmp_path, "c.json", {"years": [1900, 1901], "components": {"a": [1.0, None], "b": [2.0, 3.0]}})
    got = {(r["year"], r["component"]): r["value"] for r in documents.read_components(spark, path).collect()}
    assert got == {(1900, "a"): 1.0, (1901, "a"): None, (1900, "b"): 2.0, (1901, "b"): 3.0}


def test_grid_round_trip(spark, tmp_path):
    g = Grid(0.0, 0.0, 3.0, 2.0, 3, 2)
    df = spark.createDataFrame([(0.5, 0.5, 10.4), (2.5, 1.5, 3.6)], "lon double, lat double, v double")
    dense = grid.densify(grid.bin_mean(df, g, "v"), g)
    path = str(tmp_path / "grid")
    sinks.write_document(sinks.grid_document(dense, g, decimals=0, id="g", units="mm/yr"), path)
    written = json.loads(next((tmp_path / "grid").glob("part*.json")).read_text())
    assert written["values"] == [10, None, None, None, None, 4] and written["nx"] == 3 and written["dlon"] == 1.0
    meta, cells = documents.read_grid(spark, path)
    assert meta.first()["units"] == "mm/yr"
    assert {(r["ix"], r["iy"], r["value"]) for r in cells.collect()} == {(0, 0, 10.0), (2, 1, 4.0)}


def test_large_grid_round_trip_by_rows(spark, tmp_path):
    g = Grid(-180.0, -90.0, 180.0, 90.0, 3600, 1800)
    df = spark.createDataFrame([(-179.95, -89.95, 10.0), (179.95, 89.95, 3.0), (0.05, 0.05, 7.0)], "lon double, lat double, v double")
    dense = grid.densify(grid.bin_mean(df, g, "v"), g)
    path = str(tmp_path / "grid")
    sinks.write_document(sinks.grid_rows(dense, g, id="g", units="mm/yr"), path)
    rows = spark.read.json(path)
    assert rows.count() == 1800 and rows.select(F.min(F.size("values")), F.max(F.size("values"))).first() == (3600, 3600)
    meta, cells = documents.read_grid(spark, path, lines=True)
    assert meta.count() == 1 and meta.first()["ny"] == 1800
    assert {(r["ix"], r["iy"], r["value"]) for r in cells.collect()} == {(0, 0, 10.0), (3599, 1799, 3.0), (1800, 900, 7.0)}


def test_features(spark, tmp_path):
    path = put(tmp_path, "s.geojson", {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "type": "AMOC array", "url": "https://x", "description": "d"}, "geometry": {"type": "Point", "coordinates": [-70.5, 26.5]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]})
    rows = documents.read_features(spark, path).select("name", "type", "lon", "lat").collect()
    assert [tuple(r) for r in rows] == [("a", "AMOC array", -70.5, 26.5), ("b", None, 1.0, 2.0)]


def test_taxonomy_last_entry_wins(spark, tmp_path):
    path = put(tmp_path, "t.json", {
        "total": 100, "unplaced": 1,
        "categories": [{"label": "K", "items": [{"key": 1, "name": "one", "records": 60}, {"key": 2, "name": "two", "records": 30}]}, {"label": "G", "items": [{"key": 2, "name": "two again", "records": 31}]}],
        "species": [{"key": 1, "common": "uno", "records": 61, "note": "n"}],
    })
    totals, items, lookup = documents.read_taxonomy(spark, path)
    assert totals.first()["total"] == 100 and items.count() == 3
    assert {tuple(r) for r in lookup.collect()} == {(1, "uno", 61, "n"), (2, "two again", 31, None)}


def test_catalog(spark, tmp_path):
    path = put(tmp_path, "c.json", {"record_count": 2, "records": [{"id": "a", "name": "A", "globe": True}, {"id": "b", "amoc": False}]})
    rows = documents.read_catalog(spark, path).select("position", "id", "globe", "amoc").collect()
    assert [tuple(r) for r in rows] == [(0, "a", True, None), (1, "b", None, False)]


def test_budget_sheet(spark, tmp_path):
    cells = lambda year, obs: ",".join([year, "", obs, "", "", "1.26", "", "", "2", "", "", "3", "", "", "4", "", "", "5", "", "", "6", "9", "9"])
    path = put(tmp_path, "b.csv", "\n".join([cells("Year", "obs"), cells("1900.0", "-173.25"), cells("", "1"), cells("1901", "")]))
    rows = [(r["year"], r["observed"], r["sum"], r["tws"]) for r in tables.read_budget_sheet(spark, path).collect()]
    assert [(y, o) for y, o, _, _ in rows] == [(1900, pytest.approx(-173.3, abs=0.06)), (1901, None)]
    assert rows[0][2:] == (1.3, 6.0)


def test_missions(spark, tmp_path):
    path = put(tmp_path, "m.csv", "# note\n#other\nyear,A,B,C\n\n1992.9614,1.04,,\n1993.0,,2.5, 3.66\n1994.0,, ,\n")
    rows = tables.read_missions(spark, path).orderBy("position").collect()
    assert [(r["t"], r["v"]) for r in rows] == [(1992.961, 1.0), (1993.0, 3.7)]


def test_annual(spark, tmp_path):
    line = lambda year, mean: ",".join([year, *["0.1"] * 12, mean, *["x"] * 5])
    path = put(tmp_path, "t.csv", "\n".join(["Land-Ocean: Global Means", line("Year", "J-D"), line("1880", "-.18"), line("1881", "***"), line("1882", "*****"), line("1883", "")]))
    assert [tuple(r) for r in tables.read_annual(spark, path).collect()] == [(1880, -0.18)]


def test_inventory_quarantines_whole_rows(spark, tmp_path):
    head = "rgi_id,cenlon,cenlat,area_km2\n"
    a = put(tmp_path, "01.csv", head + "a,1.00049,2,3\nb,1,2,oops\n")
    b = put(tmp_path, "02.csv", "o1,area_km2,cenlat,cenlon,rgi_id\n2,6,5,4,c\n2,6,5,,d\n2,1,1,nan,e\n")
    good, bad = tables.read_inventory(spark, [a, b])
    assert sorted((r["rgi_id"], r["lon"]) for r in good.collect()) == [("a", 1.0), ("c", 4.0)]
    assert sorted(r["rgi_id"] for r in bad.collect()) == ["b", "d", "e"]


def test_rates_push_down(spark, tmp_path):
    path = str(tmp_path / "rates")
    spark.createDataFrame([("a", tables.RATE_PERIOD, -1.0, 9), ("a", "2000-01-01_2010-01-01", 5.0, 9)], "rgi_id string, period string, dhdt double, extra int").write.parquet(path)
    df = tables.read_rates(spark, path)
    assert [tuple(r) for r in df.collect()] == [("a", -1.0)]
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(period" in plan and "extra" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_cube_written_again_is_the_same(spark, tmp_path):
    path = str(tmp_path / "cube")
    write = lambda rows, name: tables.write_cube(spark.createDataFrame(rows, "time date, cell int, v double"), path, name)
    first = [(D(2000 + y, 1, 1), 0, float(y)) for y in range(4)]
    write(first, "precip")
    write(first[:1], "sst")
    write([(D(2001, 1, 1), 0, 9.0), (D(2002, 1, 1), 0, 2.0)], "precip")
    assert sorted(r["v"] for r in tables.read_cube(spark, path, "precip").collect()) == [0.0, 2.0, 3.0, 9.0]
    assert [r["v"] for r in tables.read_cube(spark, path, "sst").collect()] == [0.0]


def test_cube_prunes_years(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = [(D(2000 + y, 1, 1), 0, float(y)) for y in range(4)]
    tables.write_cube(spark.createDataFrame(rows, "time date, cell int, v double"), path, "precip")
    df = tables.read_cube(spark, path, "precip", (2001, 2003))
    assert sorted(r["v"] for r in df.collect()) == [1.0, 2.0]
    assert "PartitionFilters: [isnotnull(dataset" in df._jdf.queryExecution().toString()


COLORMAP = """<?xml version="1.0"?>
<ColorMaps><ColorMap title="t" units="°C"><Entries>
<ColorMapEntry rgb="10,20,30" transparent="false" sourceValue="1" value="[5.00,5.05)" ref="1"/>
<ColorMapEntry rgb="0,0,0" transparent="true" value="[0,1)"/>
<ColorMapEntry rgb="40,50,60" transparent="false" value="[-INF,0.00)"/>
<ColorMapEntry rgb="7,7,7" transparent="false" value="[12]"/>
<ColorMapEntry rgb="8,8,8" transparent="false" value="-3.5"/>
<ColorMapEntry rgb="9,9,9" transparent="false" value="No data"/>
</Entries></ColorMap></ColorMaps>"""


def test_colormaps(spark, tmp_path):
    put(tmp_path, "sst.xml", COLORMAP)
    put(tmp_path, "ice.xml", COLORMAP.replace('units="°C"', "").replace("10,20,30", "11,20,30"))
    df = raster.read_colormaps(spark, str(tmp_path))
    rows = {(r["rgb_key"]): (r["lo"], r["hi"]) for r in df.filter("colormap_id = 'sst'").collect()}
    key = lambda r, g, b: r << 16 | g << 8 | b
    assert rows == {key(10, 20, 30): (5.0, 5.05), key(40, 50, 60): (0.0, 0.0), key(7, 7, 7): (12.0, 12.0), key(8, 8, 8): (-3.5, -3.5)}
    assert {r["units"] for r in df.filter("colormap_id = 'sst'").collect()} == {"°C"}
    values = {r["rgb_key"]: r["value"] for r in colormap.value_table(df.filter("colormap_id = 'sst'")).collect()}
    assert values[key(10, 20, 30)] == pytest.approx(5.025) and values[key(40, 50, 60)] == 0


def png(width, height, pixels, alpha=True):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    n = 4 if alpha else 3
    lines = b"".join(b"\0" + b"".join(bytes(p[:n]) for p in pixels[y * width : (y + 1) * width]) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_tiles_to_values(spark, tmp_path):
    folder = tmp_path / "tiles" / "layer=sst" / "date=2024-01-01" / "z=0" / "x=1"
    folder.mkdir(parents=True)
    pixels = [(10, 20, 30, 255), (40, 50, 60, 128), (10, 20, 30, 0), (1, 2, 3, 255), (200, 150, 100, 255), (7, 7, 7, 255)]
    (folder / "0.png").write_bytes(png(3, 2, pixels))
    (folder / "1.png").write_bytes(png(3, 2, pixels, alpha=False))
    (folder / "2.png").write_bytes(b"not an image")
    df = raster.read_tiles(spark, str(tmp_path / "tiles"))
    assert {"layer", "date", "z", "x"} <= set(df.columns) and df.count() == 12
    got = sorted((r["py"], r["px"], r["r"], r["g"], r["b"], r["a"]) for r in df.filter("a = 255 and r <> 200").collect())
    assert (1, 2, 7, 7, 7, 255) in got and (0, 1, 40, 50, 60, 255) in got
    assert df.filter("r = 200").select("px", "py").distinct().collect() == [(1, 1)]
    assert df.filter("a = 128").select("r", "g", "b").first() == (40, 50, 60)
    put(tmp_path, "maps/sst.xml", COLORMAP)
    cmap = raster.read_colormaps(spark, str(tmp_path / "maps"))
    opaque = colormap.invert(df.withColumn("colormap_id", F.col("layer")), cmap)
    assert sorted((r["py"], r["px"], round(r["value"], 3)) for r in opaque.collect()) == [
        (0, 0, 5.025), (0, 0, 5.025), (0, 1, 0.0), (0, 1, 0.0), (0, 2, 5.025), (1, 2, 12.0), (1, 2, 12.0),
    ]


def test_tiles_in_compiled_code(spark, tmp_path):
    """All byte values, with and without alpha; the pixels are cut inside whole-stage code."""
    (tmp_path / "t").mkdir()
    pixels = [((7 * i) % 256, (11 * i + 1) % 256, (13 * i + 2) % 256, (17 * i + 3) % 256) for i in range(40 * 30)]
    (tmp_path / "t" / "a.png").write_bytes(png(40, 30, pixels))
    df = raster.read_tiles(spark, str(tmp_path / "t"))
    got = {(r["px"], r["py"]): (r["r"], r["g"], r["b"], r["a"]) for r in df.collect()}
    assert got == {(i % 40, i // 40): p for i, p in enumerate(pixels)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "*(1) Generate explode(sequence" in plan


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, path)
    sinks.write_snapshot(spark.range(3), path, "2024-01-30", units="mm", source="s")
    data, meta = sinks.read_snapshot(spark, path)
    assert data.count() == 3 and meta.first().asDict() == {"snapshot": "2024-01-30", "units": "mm", "source": "s"}


def test_a_write_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    sinks.write_snapshot(spark.range(3), path, "2024-01-30")
    read = lambda: (lambda data, meta: (data.count(), meta.first()["snapshot"]))(*sinks.read_snapshot(spark, path))
    # Between data and envelope.
    with pytest.raises(Exception, match="no_such_column"):
        sinks.write_snapshot(spark.range(5).withColumn("x", F.expr("raise_error('no_such_column')")), path, "2024-01-31")
    assert read() == (3, "2024-01-30")
    # Between envelope and manifest.
    with monkeypatch.context() as m:
        m.setattr(sinks, "replace_text", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_snapshot(spark.range(6), path, "2024-02-01")
    assert read() == (3, "2024-01-30")
    # A reader of the version before goes on; the one before that and the dead ones are gone.
    reader, _ = sinks.read_snapshot(spark, path)
    sinks.write_snapshot(spark.range(7), path, "2024-02-02")
    assert read() == (7, "2024-02-02") and reader.count() == 3
    sinks.write_snapshot(spark.range(8), path, "2024-02-03")
    assert read() == (8, "2024-02-03") and len(list((tmp_path / "snap" / "versions").iterdir())) == 2


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0b", "spark.sql.files.minPartitionNum": "20"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_line_numbers_over_files_and_splits(spark, tmp_path, tiny_splits):
    files = {"b.txt": [f"b{i}-" + "x" * (i % 23) for i in range(60)], "a.txt": [f"a{i}" for i in range(31)], "c.txt": []}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if lines else ""))
    want = dict(enumerate(files["a.txt"] + files["b.txt"]))
    for order in (["a.txt", "b.txt", "c.txt"], ["c.txt", "b.txt", "a.txt"]):
        scan = spark.read.text([str(tmp_path / n) for n in order])
        assert scan.rdd.getNumPartitions() > 3
        got = numbered(scan, "n")
        assert {r["n"]: r["value"] for r in got.collect()} == want and got.columns == ["value", "n"]


def test_missions_of_two_files_keep_their_order(spark, tmp_path, tiny_splits):
    (tmp_path / "1.csv").write_text("# note\nyear,A,B\n" + "".join(f"1993.0,{i},\n" for i in range(40)))
    (tmp_path / "2.csv").write_text("".join(f"1993.0,,{100 + i}\n" for i in range(40)))
    paths = [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]
    first, second = (tables.read_missions(spark, p).orderBy("position").collect() for p in (paths, paths[::-1]))
    assert first == second and [r["v"] for r in first] == [*map(float, range(40)), *map(float, range(100, 140))]
    assert first[0]["position"] == 2


def test_colormap_ties_go_by_the_place_in_the_file(spark, tmp_path, tiny_splits):
    entry = '<ColorMapEntry rgb="1,2,3" transparent="false" value="[{},{})" />'
    body = "\n".join(entry.format(0, i) for i in range(1, 40))
    put(tmp_path, "m.xml", f"<ColorMaps><ColorMap><Entries>\n{body}\n</Entries></ColorMap></ColorMaps>")
    rows = raster.read_colormaps(spark, str(tmp_path / "m.xml")).orderBy("pos").collect()
    assert [r["hi"] for r in rows] == [float(i) for i in range(1, 40)] and [r["pos"] for r in rows] == list(range(39))


def test_a_box_of_a_cube_skips_row_groups(spark, tmp_path):
    """A 10-degree box over a year reads less than a tenth of the row groups."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "cube")
    field = spark.range(90 * 180 * 24).select(
        F.expr("make_date(2001, 1 + CAST(id DIV 16200 AS INT) % 12, 1 + 14 * CAST(id DIV 194400 AS INT))").alias("time"),
        (F.col("id") % 180 * 2 - 179).cast("double").alias("lon"), (F.expr("id DIV 180") % 90 * 2 - 89).cast("double").alias("lat"), F.rand(3).alias("v"),
    )
    tables.write_cube(field, path, "sst", place=("lon", "lat"), row_group=64 << 10)
    groups = hit = 0
    for file in tmp_path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
        for i in range(meta.num_row_groups):
            span = {n: meta.row_group(i).column(at[n]).statistics for n in ("lon", "lat")}
            groups += 1
            hit += span["lon"].max >= 10 and span["lon"].min < 20 and span["lat"].max >= 40 and span["lat"].min < 50
    assert groups > 60 and hit < groups / 10
    got = tables.read_cube(spark, path, "sst", (2001, 2002), (10, 40, 20, 50))
    assert got.count() == 5 * 5 * 24 and "PushedFilters" in got._jdf.queryExecution().toString()
    assert tables.read_cube(spark, path, "sst", box=(170, -10, -170, 10)).select("lon").distinct().count() == 10
    odd = spark.createDataFrame([(D(2001, 1, 1), None, float("nan")), (D(2001, 1, 1), float("inf"), 95.0)], "time date, lon double, lat double")
    tables.write_cube(odd, path, "odd", place=("lon", "lat"))
    assert tables.read_cube(spark, path, "odd").count() == 2
