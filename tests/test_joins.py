"""Lookups that are too large to broadcast, with hot and missing keys."""

import random

import pytest
from pyspark.sql import functions as F

from isopleth.functions.geo import Grid
from isopleth.operators import colormap, grid, rolling
from isopleth.plans import joins


@pytest.fixture
def large(monkeypatch):
    """Every lookup counts as large, and a key with more than twenty rows as hot."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    fact = [(i, None if rng.random() < 0.2 else ("hot" if rng.random() < 0.5 else f"k{rng.randrange(60)}"), rng.choice([0, 1, None])) for i in range(300)]
    lookup = [(k, s, f"{k}-{s}") for k in ["hot", *[f"k{i}" for i in range(40)]] for s in (0, 1)]
    return spark.createDataFrame(fact, "id long, k string, s int"), spark.createDataFrame(lookup, "k string, s int, label string")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_the_plain_join(large, sides, how):
    fact, lookup = sides
    got = joins.lookup_join(fact, lookup, ["k", "s"], how)
    want = fact.join(lookup, ["k", "s"], how).select(got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_one_scan_of_the_fact_and_no_copy(large, sides, spark, tmp_path):
    """The join scans the fact once; the sketch reads its key columns only."""
    fact, lookup = sides
    fact.withColumn("wide", F.lit("x")).repartition(7).write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    before = {p for p in tmp_path.rglob("*")}
    out = joins.lookup_join(stored, lookup, ["k", "s"], "left")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wide#") >= 1 and sum("Relation" in line and "wide#" in line for line in plan.splitlines()) == 1
    assert "Union" not in plan and "_salt" in plan
    assert {p for p in tmp_path.rglob("*")} == before


def test_the_sketch_finds_hot_keys_and_spreads_them(large, sides, monkeypatch):
    fact, lookup = sides
    hot = joins.hot_keys(fact, ["k", "s"])
    counted = fact.dropna(subset=["k", "s"]).groupBy("k", "s").count().withColumn("h", joins.key_hash(["k", "s"]))
    assert sorted(hot) == sorted(r["h"] for r in counted.filter("count > 20").collect()) and hot
    assert joins.hot_keys(fact.limit(0), ["k", "s"]) == []
    monkeypatch.setattr(joins, "SALTS", 4)
    plan = joins.salted_join(fact.repartition(8), lookup, ["k", "s"], "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "SPARK_PARTITION_ID() % 4" in plan


def test_broadcast_goes_by_bytes_too(spark, monkeypatch):
    notes = spark.range(100).select("id", F.repeat(F.lit("é"), 1000).alias("note"), F.array("id").alias("more"))
    assert joins.within(notes)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100_000)
    assert not joins.within(notes) and joins.within(notes.drop("note")) and not joins.within(notes.drop("note"), rows=99)
    assert joins.within(notes.limit(0))


def test_sampling_many_grids(large, spark):
    g = Grid(0.0, 0.0, 4.0, 4.0, 4, 4)
    cells = spark.range(32).select((F.col("id") % 2).alias("gid"), (F.floor(F.col("id") / 2) % 4).alias("ix"), F.floor(F.col("id") / 8).alias("iy"), F.col("id").cast("double").alias("value"))
    pts = spark.range(200).select(
        F.col("id").alias("pid"), (F.col("id") % 2).alias("gid"),
        F.when(F.col("id") < 120, F.lit(1.5)).otherwise(F.col("id") / 20 - 3).alias("lon"), F.lit(2.5).alias("lat"),
    )
    got = {r["pid"]: r["sampled"] for r in grid.sample(pts, cells, g, keys=("gid",)).collect()}
    value = {(r["gid"], r["ix"], r["iy"]): r["value"] for r in cells.collect()}
    want = {}
    for p in pts.collect():
        lon = (p["lon"] + 180) % 360 - 180
        want[p["pid"]] = value[(p["gid"], int(lon), 2)] if 0 <= lon < 4 else None
    assert got == want


def test_hot_buckets_of_many_colormaps(large, spark, monkeypatch):
    """More bins than are broadcast: the bucket lookup equals the interval join."""
    rows = [(f"m{k}", i, 100 * k + i, i * i / 3 - k, (i * i + 2 * i) / 3 - k) for k in range(4) for i in range(12)]
    cmap = spark.createDataFrame(rows, "colormap_id string, pos int, rgb_key int, lo double, hi double")
    hot = F.when(F.col("id") % 3 == 0, F.lit("m1")).otherwise(F.concat(F.lit("m"), F.col("id") % 5))
    v = F.when(F.col("id") % 3 == 0, F.lit(2.5)).when(F.col("id") % 17 != 0, F.col("id") / 3 - 9)
    px = spark.range(300).select("id", hot.alias("colormap_id"), v.alias("value"))
    want = colormap.forward(px, cmap)
    monkeypatch.setattr(colormap, "FORWARD_ROWS", 3)
    got = colormap.forward(px, cmap)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    assert got.count() == want.count() == 300 and got.filter("rgb_key IS NOT NULL").count() > 200
    assert got.exceptAll(want).count() == 0


def test_large_colormaps_and_probes(large, spark):
    cmap = spark.range(20).select(F.lit("m").alias("colormap_id"), F.col("id").alias("pos"), F.col("id").alias("rgb_key"), F.col("id").cast("double").alias("lo"), (F.col("id") + 1).cast("double").alias("hi"))
    px = spark.range(100).select(F.lit("m").alias("colormap_id"), F.lit(0).alias("r"), F.lit(0).alias("g"), F.when(F.col("id") < 60, F.lit(7)).otherwise(F.col("id") % 30).alias("b"), F.lit(255).alias("a"))
    values = colormap.invert(px, cmap)
    assert values.count() == px.filter("b < 20").count()
    assert colormap.forward(values.drop("rgb_key"), cmap).filter("rgb_key <> b").count() == 0
    import datetime as dt

    obs = spark.range(50).select((F.col("id") % 10).alias("pix"), F.lit(dt.date(2024, 1, 1)).alias("day"), F.col("id").cast("double").alias("v"))
    asked = spark.range(30).select("id", F.when(F.col("id") < 20, F.lit(3)).otherwise(F.col("id")).alias("pix"))
    got = rolling.probe(asked, obs, ["pix"], lambda o: rolling.window_mean(o, ["pix"], "v", dt.date(2024, 1, 1), 1))
    rows = {r["id"]: r["value"] for r in got.collect()}
    assert len(rows) == 30 and rows[0] == 23.0 and rows[25] is None
