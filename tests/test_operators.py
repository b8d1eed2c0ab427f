"""Small exact fixtures and properties that must hold between operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from isopleth.functions import dates, geo
from isopleth.functions.geo import Grid
from isopleth.operators import catalog, colormap, ensemble, grid, points, quality, rolling, series
from isopleth.plans import joins

D = dt.date
WORLD = Grid(-180.0, -90.0, 180.0, 90.0, 36, 18)


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(800):
        crowded = rng.random() < 0.4
        lon = 12.3 if crowded else rng.uniform(-190, 190)
        lat = 45.6 if crowded else rng.uniform(-90, 90)
        rows.append((i, lon, lat, D(2024, 1, 1) + dt.timedelta(days=rng.randrange(40)), rng.choice([None, float("nan"), 1.0, 2.5, 7.0])))
    return spark.createDataFrame(rows, "id long, lon double, lat double, day date, v double").cache()


def brute_bins(rows, g):
    cells = {}
    for r in rows:
        if r["v"] is None or math.isnan(r["v"]):
            continue
        lon = (r["lon"] + 180) % 360 - 180
        ix, iy = math.floor((lon - g.west) / g.dlon), math.floor((r["lat"] - g.south) / g.dlat)
        if 0 <= ix < g.nx and 0 <= iy < g.ny:
            cells.setdefault((ix, iy), []).append(r["v"])
    return cells


def test_bin_mean(obs):
    want = brute_bins(obs.collect(), WORLD)
    got = {(r["ix"], r["iy"]): (r["value"], r["n"]) for r in grid.bin_mean(obs, WORLD, "v").collect()}
    assert got.keys() == want.keys()
    for k, vs in want.items():
        assert got[k][1] == len(vs) and got[k][0] == pytest.approx(sum(vs) / len(vs))


def test_edges_are_half_open(spark):
    df = spark.createDataFrame([(180.0, 0.0, 1.0), (0.0, 90.0, 1.0), (-180.0, -90.0, 1.0)], "lon double, lat double, v double")
    got = {(r["ix"], r["iy"]) for r in grid.bin_mean(df, WORLD, "v").collect()}
    assert got == {(0, 9), (0, 0)}


def test_dense_and_whole_numbers(obs):
    cells = grid.bin_mean(obs, WORLD, "v")
    dense = grid.densify(cells, WORLD, decimals=0)
    summary = grid.grid_summary(dense).first()
    assert (summary["cells"], summary["filled"]) == (WORLD.cells, cells.count())
    assert dict(dense.dtypes)["value"] == "bigint"


def test_coarsening_keeps_the_mean_of_cells(obs):
    cells = grid.bin_mean(obs, WORLD, "v").drop("n")
    coarse = Grid(-180.0, -90.0, 180.0, 90.0, 12, 6)
    up = grid.coarsen(cells, WORLD, coarse)
    total = up.agg(F.sum(F.col("value") * F.col("n")), F.sum("n")).first()
    want = cells.agg(F.sum("value"), F.count("*")).first()
    assert total[0] == pytest.approx(want[0]) and total[1] == want[1]


def test_climatology_weights(spark):
    df = spark.createDataFrame([(1, D(2023, 1, 1), 31.0), (1, D(2023, 2, 1), 28.0), (1, D(2023, 3, 1), None)], "c int, t date, v double")
    plain = grid.climatology(df, ["c"], "v", factor=1.0).first()
    weighted = grid.climatology(df, ["c"], "v", factor=1.0, weight=dates.days_in_month("t")).first()
    assert (plain["clim"], plain["n"]) == (29.5, 2)
    assert weighted["clim"] == pytest.approx((31 * 31 + 28 * 28) / 59)


def test_sampling_reads_back_the_cells(obs):
    cells = grid.bin_mean(obs, WORLD, "v")
    real = obs.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("lat") < 90))
    sampled = grid.sample(real, cells, WORLD)
    assert sampled.count() == real.count()
    assert sampled.filter("sampled is null").count() == 0
    outside = grid.sample(real.limit(3).withColumn("lat", F.lit(91.0)), cells, WORLD)
    assert {r["sampled"] for r in outside.collect()} == {None}


@pytest.mark.parametrize("tasks", [None, 5])
def test_painted_pixels_match_direct_sampling(spark, tasks):
    g = Grid(-50.0, 10.0, 70.0, 80.0, 7, 9)
    cells = spark.range(63).select((F.col("id") % 7).alias("ix"), F.floor(F.col("id") / 7).alias("iy"), F.col("id").cast("double").alias("value"))
    painted = grid.paint_tiles(cells, g, z=2, size=16, tasks=tasks).collect()
    got = {(r["x"], r["y"], r["px"], r["py"]): r["value"] for r in painted}
    assert len(painted) == len(got)
    want, span = {}, 45.0
    for x in range(8):
        for y in range(4):
            for px in range(16):
                for py in range(16):
                    lon = (-180.0 + x * span) + (px + 0.5) / 16 * span
                    lat = (90.0 - y * span) - (py + 0.5) / 16 * span
                    if g.west <= lon < g.east and g.south <= lat < g.north:
                        ix, iy = math.floor((lon - g.west) / g.dlon), math.floor((lat - g.south) / g.dlat)
                        want[(x, y, px, py)] = float(iy * 7 + ix)
    assert got == want


def test_single_day_window_is_the_day(obs):
    day = D(2024, 1, 9)
    got = rolling.window_mean(obs, ["lon", "lat"], "v", day, 1)
    want = obs.filter((F.col("day") == day) & F.col("v").isNotNull() & ~F.isnan("v")).groupBy("lon", "lat").agg(F.avg("v").alias("value"))
    assert got.select("lon", "lat", "value").exceptAll(want).count() == 0 and got.count() == want.count()


def test_missing_days_are_left_out_of_the_mean(spark):
    df = spark.createDataFrame(
        [(1, D(2024, 1, 30), 4.0), (1, D(2024, 1, 1), 6.0), (2, D(2024, 1, 30), None)], "pix int, day date, v double"
    )
    got = rolling.window_mean(df, ["pix"], "v", D(2024, 1, 30), 30).collect()
    assert [(r["pix"], r["value"], r["n"]) for r in got] == [(1, 5.0, 2)]


def test_delta_needs_both_sides(spark):
    df = spark.createDataFrame(
        [(1, D(2024, 2, 29), 5.0), (1, D(2023, 2, 28), 3.0), (2, D(2024, 2, 29), 5.0)], "pix int, day date, v double"
    )
    got = rolling.window_delta(df, ["pix"], "v", D(2024, 2, 29), 1).collect()
    assert [(r["pix"], r["delta"]) for r in got] == [(1, 2.0)]
    same = rolling.window_delta(df, ["pix"], "v", D(2023, 2, 28), 0).collect()
    assert {r["delta"] for r in same} == {0.0}


def test_repeated_months_weigh_more_only_without_dedupe(spark):
    df = spark.createDataFrame([(1, D(2023, 6, 1), 10.0), (1, D(2023, 5, 1), 0.0)], "pix int, day date, v double")
    kw = dict(monthly=True, latest=D(2026, 7, 1), max_samples=12)
    once = rolling.window_mean(df, ["pix"], "v", D(2023, 6, 30), 45, **kw).first()
    many = rolling.window_mean(df, ["pix"], "v", D(2023, 6, 30), 45, dedupe=False, **kw).first()
    assert once["value"] == 5.0 and once["n"] == 2
    assert many["n"] == 12 and many["value"] > 5.0


def test_overlapping_windows_count_rows_twice(spark):
    days = [(1, D(2022, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(900)]
    df = spark.createDataFrame(days, "pix int, day date, v double")
    got = rolling.window_delta(df, ["pix"], "v", D(2024, 6, 1), 1, 500, max_samples=None).first()
    assert (got["n_now"], got["n_past"], got["delta"]) == (500, 500, 366.0)


def test_exact_rolling_mean(obs):
    keyed = obs.withColumn("k", F.col("id") % 3)
    got = {(r["k"], r["day"]): (r["value"], r["n"]) for r in rolling.rolling_mean(keyed, ["k"], "v", 5).collect()}
    rows = [r for r in keyed.collect() if r["v"] is not None and not math.isnan(r["v"])]
    for (k, day), (value, n) in got.items():
        seen = [r["v"] for r in rows if r["k"] == k and 0 <= (day - r["day"]).days < 5]
        assert n == len(seen) and value == pytest.approx(sum(seen) / n)


def test_probe_keeps_points_without_data(obs):
    asked = obs.sparkSession.createDataFrame([(1, 12.3, 45.6), (2, 0.111, 0.222)], "pid int, lon double, lat double")
    got = rolling.probe(asked, obs, ["lon", "lat"], lambda o: rolling.window_mean(o, ["lon", "lat"], "v", D(2024, 2, 9), 40, max_samples=None))
    rows = {r["pid"]: r["value"] for r in got.collect()}
    assert rows[1] is not None and rows[2] is None


def test_ensemble(spark):
    df = spark.createDataFrame(
        [(1, "a", 20.0), (1, "b", 21.0), (1, "c", None), (2, "a", 5.0), (3, "a", 1.0), (3, "a", 3.0), (3, "c", 2.0)],
        "pix int, member string, value double",
    )
    got = {r["pix"]: (r["mean"], r["spread"], r["n_members"]) for r in ensemble.ensemble(df, ["pix"], ["a", "b", "c"]).collect()}
    assert got == {1: (20.5, 0.5, 2), 3: (2.0, 0.0, 2)}


@pytest.fixture(scope="module")
def cmap(spark):
    rows = [("m", 0, 1, 0.0, 1.0), ("m", 1, 2, 1.0, 2.0), ("m", 2, 3, 3.0, 4.0), ("m", 3, 4, 5.5, 5.5), ("m", 4, 1, 7.0, 9.0)]
    return spark.createDataFrame(rows, "colormap_id string, pos long, rgb_key long, lo double, hi double")


def test_inversion(spark, cmap):
    px = spark.createDataFrame(
        [("m", 0, 0, 1, 255), ("m", 0, 0, 2, 255), ("m", 0, 0, 9, 255), ("m", 0, 0, 3, 0)], "colormap_id string, r int, g int, b int, a int"
    )
    got = {r["b"]: r["value"] for r in colormap.invert(px, cmap).collect()}
    assert got == {1: 8.0, 2: 1.5}


def search(bins, v):
    """Colour of a value by direct search, for comparison."""
    if v <= bins[0][1]:
        return bins[0][0]
    if v >= bins[-1][2]:
        return bins[-1][0]
    left, right = 0, len(bins) - 1
    while left < right:
        m = (left + right) // 2
        if v < bins[m][1]:
            right = m - 1
        elif v >= bins[m][2]:
            left = m + 1
        else:
            return bins[m][0]
    return bins[left][0]


@pytest.mark.parametrize("seed", range(4))
def test_forward_colours(spark, seed):
    rng = random.Random(seed)
    maps, at = {}, 0
    rows = []
    for name in ("a", "b"):
        x, bins = rng.uniform(-5, 5), []
        for k in range(rng.choice([2, 7, 40])):
            width = rng.choice([0.0, 0.5, 1.0, 3.25])
            bins.append((k, x, x + width))
            x += width + rng.choice([0.0, 0.0, 0.75, 2.0]) + (0.1 if width == 0 else 0)
        maps[name] = bins
        rows += [(name, i, k, lo, hi) for i, (k, lo, hi) in enumerate(bins)]
    table = spark.createDataFrame(rows, "colormap_id string, pos long, rgb_key long, lo double, hi double")
    values = []
    for name, bins in maps.items():
        edges = [e for _, lo, hi in bins for e in (lo, hi)]
        tried = edges + [rng.uniform(edges[0] - 1, edges[-1] + 1) for _ in range(200)]
        for v in tried:
            values.append((at, name, v))
            at += 1
    df = spark.createDataFrame(values, "id long, colormap_id string, value double")
    got = {r["id"]: r["rgb_key"] for r in colormap.forward(df, table).collect()}
    assert len(got) == len(values)
    assert {i: search(maps[name], v) for i, name, v in values} == got


def test_one_map_needs_no_name(spark, cmap):
    values = spark.createDataFrame([(i, i / 4 - 1) for i in range(44)], "id long, value double")
    named = colormap.forward(values.withColumn("colormap_id", F.lit("m")), cmap)
    bare = colormap.forward(values, cmap, one_map=True)
    pick = lambda df: {r["id"]: r["rgb_key"] for r in df.collect()}
    assert pick(named) == pick(bare) and len(pick(bare)) == 44
    assert "NestedLoop" not in bare._jdf.queryExecution().executedPlan().toString()


def test_overlapping_bins_give_one_colour(spark):
    rows = [("m", 0, 1, 0.0, 2.0), ("m", 1, 2, 1.0, 3.0), ("m", 2, 3, 3.0, 4.0)]
    table = spark.createDataFrame(rows, "colormap_id string, pos long, rgb_key long, lo double, hi double")
    values = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,)], "value double").withColumn("colormap_id", F.lit("m"))
    assert sorted((r["value"], r["rgb_key"]) for r in colormap.forward(values, table).collect()) == [(0.5, 1), (1.5, 2), (2.5, 2), (3.5, 3)]


def test_delta_at_points(spark):
    df = spark.createDataFrame([(1, D(2024, 3, 1), 5.0), (1, D(2023, 3, 1), 3.0), (2, D(2024, 3, 1), 5.0)], "pix int, day date, v double")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "pid string, pix int")
    got = rolling.probe(asked, df, ["pix"], lambda o: rolling.window_delta(o, ["pix"], "v", D(2024, 3, 1), 1))
    assert {r["pid"]: r["delta"] for r in got.collect()} == {"a": 2.0, "b": None, "c": 2.0}


def test_latest_of_equal_times_is_the_first(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 2), 2, 1.0, 1.0), ("a", dt.datetime(2024, 1, 2), 1, 5.12345, 1.0), ("a", dt.datetime(2024, 1, 3), 3, None, 1.0)],
        "pf string, ts timestamp_ntz, id long, lon double, lat double",
    )
    got = points.latest_positions(df, "pf", "ts", "id", "lon", "lat").collect()
    assert [(r["lon"], r["date"]) for r in got] == [(5.123, D(2024, 1, 2))]


def test_top_is_taken_after_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, 9.0, None), (2, 5.0, 1.0), (3, 7.0, 1.0), (4, 5.0, 1.0)], "id int, q double, lon double")
    top = points.top(points.complete(df, "lon", "q"), "q", "id", 2).collect()
    assert [r["id"] for r in top] == [3, 2]
    second = points.page(points.complete(df, "lon", "q"), "q", "id", 1, 1).collect()
    assert [r["id"] for r in second] == [2]


def test_newest_rows_without_a_sort(spark, monkeypatch):
    """Ties, missing times, ties and keys; hashed while the keys are few, else sorted, with one result."""
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("a", t(1), 5, 1.0, "x"), ("a", t(3), 9, 2.0, "y"), ("a", t(3), 4, None, "z"), ("a", None, 1, 9.0, "n"), ("a", t(3), None, 8.0, "m"),
        ("b", None, 7, 3.0, "x"), ("b", None, 6, 4.0, "y"), (None, t(2), 2, 5.0, "x"), (None, t(1), 1, 6.0, "y"), ("c", t(1), None, 7.0, None),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double, s string")
    want = {"a": (t(3), 4, None, "z"), "b": (None, 6, 4.0, "y"), None: (t(2), 2, 5.0, "x"), "c": (t(1), None, 7.0, None)}
    got = points.newest_rows(df, ["k"], "ts", "id", ["id", "v", "s"])
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == want
    plan = points.newest_rows(df, ["k"], "ts", "id", ["id", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    many = points.newest_rows(df, ["k"], "ts", "id", ["id", "v", "s"])
    assert {r["k"]: tuple(r)[1:] for r in many.collect()} == want
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()


def test_latest_position_plan(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("pf"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), "id", F.rand(1).alias("lon"), F.rand(2).alias("lat"))
    plan = points.latest_positions(df, "pf", "ts", "id", "lon", "lat")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan


def test_pyramid_shuffles_the_finest_cells_once(spark, many_chunks):
    """What is shuffled is the finest level and the few cells half way up."""
    finest = spark.range(20_000).select(
        (F.col("id") % 3).alias("taxon"), F.pmod(F.xxhash64("id"), F.lit(128)).alias("x"), F.pmod(F.hash("id"), F.lit(64)).cast("long").alias("y")
    ).groupBy("taxon", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    finest = joins.settled(finest, "finest")
    levels = points.pyramid(finest, 6, ["taxon"])
    plan = levels._jdf.queryExecution().executedPlan().toString()
    repartitions = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    others = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line and "REPARTITION_BY_COL" not in line]
    assert repartitions and all("_under" in line for line in repartitions) and len(others) == 1
    half = levels.filter("z = 3").count()
    assert finest.count() + half <= 1.4 * finest.count()
    up = 3
    want = finest.groupBy("taxon", F.shiftright("x", up).alias("x"), F.shiftright("y", up).alias("y")).agg(F.sum("n").alias("n"))
    assert levels.filter(F.col("z") == 6 - up).select("taxon", "x", "y", "n").exceptAll(want).count() == 0
    assert levels.filter("z = 0").agg(F.sum("n")).first()[0] == 20_000
    only = points.pyramid(finest.limit(0), 0, ["taxon"])
    assert only.columns == ["taxon", "z", "x", "y", "n"] and only.count() == 0


def test_interleaved_keys(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 2**30), (123456789, 987654321)], "x long, y long")
    key = geo.interleaved("x", "y")
    x, y = geo.cell_of("k")
    got = cells.withColumn("k", key).select("*", x.alias("x2"), y.alias("y2"))
    assert got.filter("x <> x2 OR y <> y2").count() == 0
    assert [r["k"] for r in got.limit(4).collect()] == [0, 1, 2, 0b10010011]
    up = cells.select((geo.interleaved(F.shiftright("x", 1), F.shiftright("y", 1)) == F.shiftright(key, 2)).alias("same"))
    assert up.filter("NOT same").count() == 0


@pytest.mark.parametrize("years", [0, 1])
def test_dated_probes_against_brute_force(spark, years):
    rng = random.Random(8)
    start = D(2023, 2, 20)
    obs = [(rng.randrange(4), start + dt.timedelta(days=rng.randrange(800)), rng.choice([None, float("nan"), rng.uniform(-5, 5), rng.uniform(-5, 5)])) for _ in range(900)]
    asked = [(i, rng.choice([0, 1, 2, 3, 9, None]), rng.choice([None, D(2024, 2, 29), start + dt.timedelta(days=rng.randrange(900))])) for i in range(200)]
    asked += [(500 + i, 1, D(2024, 3, 1)) for i in range(50)]
    got = rolling.probe_dated(
        spark.createDataFrame(asked, "id long, pix long, till date"), spark.createDataFrame(obs, "pix long, day date, v double"), ["pix"], "v", "till", 30, years
    )

    def window(pix, end):
        inside = [v for p, d, v in obs if p == pix and v is not None and v == v and dt.timedelta(0) <= end - d < dt.timedelta(days=30)]
        return (sum(inside) / len(inside) if inside else None), len(inside)

    seen = {r["id"]: r for r in got.collect()}
    assert len(seen) == len(asked)
    for ident, pix, end in asked:
        r = seen[ident]
        if pix is None or end is None:
            assert r["value"] is None and r["n"] is None
            continue
        value, n = window(pix, end)
        assert r["n"] == n and r["value"] == (None if value is None else pytest.approx(value, abs=1e-9))
        if years:
            past, n_past = window(pix, D(end.year - 1, end.month, 28 if (end.month, end.day) == (2, 29) else end.day))
            assert r["n_past"] == n_past
            assert r["delta"] == (None if value is None or past is None else pytest.approx(value - past, abs=1e-9))


def test_pyramid_levels_agree(obs):
    at = obs.withColumn("taxon", F.lit(1)).filter(F.abs("lon") <= 180)
    finest = points.density(at, 5, ["taxon"])
    levels = points.pyramid(finest, 5, ["taxon"])
    sums = {r["z"]: r["s"] for r in levels.groupBy("z").agg(F.sum("n").alias("s")).collect()}
    assert set(sums.values()) == {at.count()} and len(sums) == 6
    for z in (0, 3):
        direct = points.density(at, z, ["taxon"]).select("x", "y", "n")
        assert levels.filter(F.col("z") == z).select("x", "y", "n").exceptAll(direct).count() == 0


def test_trend_and_changes(spark):
    df = spark.createDataFrame([("a", 2000, 0.0), ("a", 2010, 30.0), ("a", 2020, 60.0), ("a", 2021, None)], "s string, t int, v double")
    assert series.trend(df, ["s"], "t", "v").first()["slope"] == 3.0
    r = series.total_change(df, ["s"], "t", "v").first()
    assert (r["change"], r["last_t"]) == (60.0, 2020)


def test_equal_changes_take_the_first_component(spark):
    df = spark.createDataFrame([("b", 2, 5.0), ("a", 1, 5.0), ("c", 3, 1.0)], "component string, rank int, change double")
    assert series.largest_change(df, "component", "rank").first()["component"] == "a"


def test_rebase_uses_one_sample(spark):
    df = spark.createDataFrame(
        [("a", 2004.9, 1.0, 0), ("a", 2005.01, 10.0, 1), ("a", 2005.01, 99.0, 2), ("b", 1990.0, 3.0, 0), ("b", 1991.0, 5.0, 1)],
        "s string, t double, v double, pos int",
    )
    base = spark.createDataFrame([("a", -2.0)], "s string, base double")
    got = {(r["s"], r["pos"]): r["v"] for r in series.rebase(df, ["s"], "t", "v", 2005, base, "base", "pos").collect()}
    assert got == {("a", 0): -11.0, ("a", 1): -2.0, ("a", 2): 87.0, ("b", 0): 0.0, ("b", 1): 2.0}


def test_budget_with_a_part_named_like_the_total(spark):
    df = spark.createDataFrame([(1, "sum", 5.0), (1, "a", 2.0), (1, "b", 1.0), (2, "sum", 1.0), (2, "a", 1.0)], "t int, c string, v double")
    rows = series.budget_residual(df, ["t"], "c", "v", "sum", ["a", "b"]).collect()
    assert [(r["t"], r["residual"]) for r in rows] == [(1, 2.0)]


def test_anomaly_is_zero_on_average_over_the_baseline(spark):
    rows = [(c, D(1990 + y, m, 1), float(c * 100 + m * 3 + (y % 4))) for c in range(3) for y in range(8) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "cell int, day date, v double")
    out = series.anomaly(df, ["cell"], "day", "v", (1990, 1998))
    worst = out.groupBy("cell", "month").agg(F.abs(F.avg("anomaly")).alias("a")).agg(F.max("a")).first()[0]
    assert worst < 1e-9


def test_early_warning_on_a_line_is_flat(spark):
    rows = [("a", D(2000 + i // 12, i % 12 + 1, 1), 2.0 * i + 1) for i in range(36)]
    out = series.early_warning(spark.createDataFrame(rows, "s string, day date, v double"), ["s"], "day", "v", 12).collect()
    assert len(out) == 25 and max(r["variance"] for r in out) < 1e-15


def test_catalog_filters(spark):
    rows = [(0, "Sea Ice", "X", "ocean", None, True, None), (1, "Rain", "Y", "land", "ice too", None, True), (2, "Dust", "Z", "land", None, False, False)]
    cat = spark.createDataFrame(rows, "pos int, name string, provider string, domain string, notes string, globe boolean, amoc boolean")
    cat = cat.withColumn("variables", F.lit(None).cast("string")).withColumn("subdomain", F.lit(None).cast("string"))
    ids = lambda **k: [r["pos"] for r in catalog.listed(catalog.search(cat, **k), "pos", 10).collect()]
    assert ids() == [0, 1, 2] and ids(text="ICE") == [0, 1] and ids(domain="land", amoc=True) == [1]
    assert ids(text="undefined") == [] and ids(globe=True) == [0]
    assert tuple(catalog.hit_count(cat, text="ice").first()) == (2, 3)
    assert [r[0] for r in catalog.domains(cat).collect()] == ["land", "ocean"]


def test_checks_fail_on_bad_rows(spark):
    df = spark.createDataFrame([(1, "http://a", 10.0, [1]), (1, "ftp://b", 200.0, [1, 2]), (None, None, 5.0, [1])], "id int, url string, lon double, a array<int>")
    df = df.withColumn("lat", F.lit(0.0)).withColumn("b", F.array(F.lit(1)))
    checks = [quality.required("id"), quality.url("url"), quality.unique("id"), quality.coordinates(), quality.aligned("a", "b"), quality.row_count(1, 3)]
    got = {r["check"]: (r["observed"], r["passed"]) for r in quality.report(df, "t", checks).collect()}
    assert got == {
        "required:id": (1.0, False), "url:url": (2.0, False), "unique:id": (1.0, False),
        "coordinates": (1.0, False), "aligned:a": (1.0, False), "row_count": (3.0, True),
    }


def test_budget_checks(spark):
    df = spark.createDataFrame([(1900, -173.3, -173.1, -48.3), (2018, 35.6, 25.7, 8.6)], "y int, obs double, total double, steric double")
    checks = [quality.rise("y", "obs", 150, 260), quality.last_gap("y", "obs", "total", 20), quality.last_positive("y", "steric"), *quality.spans(F.col("y"), "y", 1900, 2018)]
    assert all(r["passed"] for r in quality.report(df, "budget", checks).collect())
