"""Streams over several files give the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from isopleth.functions.geo import Grid
from isopleth.operators import grid as g
from isopleth.operators.points import latest_per_key
from isopleth.streaming.cells import CellTable, cell_means, write_closed
from isopleth.streaming.latest import LatestTable

GRID = Grid(-180.0, -90.0, 180.0, 90.0, 4, 2)


def land(spark, folder, files):
    rng = random.Random(5)
    rows = []
    for f in range(files):
        part = []
        for i in range(60):
            at = dt.datetime(2024, 1, 1 + f) + dt.timedelta(minutes=rng.randrange(1440))
            part.append((f * 60 + i, f"p{rng.randrange(7)}", at, rng.uniform(-180, 180), rng.uniform(-90, 90), float(rng.randrange(9))))
        spark.createDataFrame(part, "id long, pf string, ts timestamp, lon double, lat double, v double").coalesce(1).write.mode("append").parquet(folder)
        rows += part
    return spark.read.parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(got, want):
    return got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


def newest(batch):
    return latest_per_key(batch, ["pf"], "ts", "id", ["id", "lon", "lat"])


@pytest.mark.parametrize("fan", [2, 8])
def test_latest_over_several_batches(spark, tmp_path, fan):
    folder = str(tmp_path / "in")
    batch = land(spark, folder, 5)
    latest = LatestTable(str(tmp_path / "out"), ("pf",), "ts", "id", ("lon", "lat"), fan)
    assert latest.current(spark) is None
    got = latest.run(source(spark, folder, batch.schema), str(tmp_path / "cp"))
    assert same(got, newest(batch)) and got.count() == 7
    # Five batches: 0-3 merged twice over and 4 by itself, or five segments.
    held = latest._log(0).largest(spark)
    assert held == ([(0, 3), (4, 4)] if fan == 2 else [(i, i) for i in range(5)])
    # A restart with the same checkpoint goes on; with nothing new it changes nothing.
    more = spark.read.parquet(folder).limit(9).withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS"))
    more.coalesce(1).write.mode("append").parquet(folder)
    whole = spark.read.parquet(folder)
    for _ in range(2):
        assert same(latest.run(source(spark, folder, batch.schema), str(tmp_path / "cp")), newest(whole))


def test_a_batch_writes_the_keys_it_touched(spark, tmp_path):
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    row = lambda n, i, hour: n.select(
        F.col("id").alias("id"), F.concat(F.lit("p"), F.col("id") % i).alias("pf"),
        F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour)).alias("ts"), F.lit(1.0).alias("lon"), F.lit(float(hour)).alias("lat"),
    )
    first = row(spark.range(100_000), 100_000, 0)
    first.coalesce(1).write.parquet(folder)
    latest = LatestTable(str(out), ("pf",), "ts", "id", ("lon", "lat"))
    stream = lambda: source(spark, folder, first.schema)
    latest.run(stream(), str(tmp_path / "cp"))
    row(spark.range(77, 78), 100_000, 5).coalesce(1).write.mode("append").parquet(folder)
    got = latest.run(stream(), str(tmp_path / "cp"))
    assert spark.read.parquet(f"{out}/generation=0/segment=1-1").count() == 1
    assert got.count() == 100_000 and [r.pf for r in got.filter("lat = 5").collect()] == ["p77"]


def test_latest_survives_a_new_checkpoint(spark, tmp_path):
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    land(spark, folder, 4)
    latest = LatestTable(str(out), ("pf",), "ts", "id", ("lon", "lat"), 2)
    first = spark.read.parquet(folder)
    latest.run(source(spark, folder, first.schema), str(tmp_path / "cp1"))
    # Rows that only the old table knows stay, also where the new stream has older ones.
    later = str(tmp_path / "later")
    shifted = first.limit(6).withColumn("ts", F.col("ts") + F.when(F.col("id") % 2 == 0, F.expr("INTERVAL 90 DAYS")).otherwise(F.expr("INTERVAL -90 DAYS")))
    shifted.coalesce(1).write.parquet(later)
    whole = first.unionByName(spark.read.parquet(later))
    for _ in range(2):
        assert same(latest.run(source(spark, later, first.schema), str(tmp_path / "cp2")), newest(whole))
    assert [p.name for p in out.glob("generation=*")] == ["generation=1"]
    # A base that a lost run left half written isn't taken for one.
    (out / "generation=2" / "base").mkdir(parents=True)
    assert same(latest.current(spark), newest(whole))
    assert same(latest.run(source(spark, later, first.schema), str(tmp_path / "cp3")), newest(whole))


def test_replayed_batches_change_nothing(spark, tmp_path):
    batch = land(spark, str(tmp_path / "in"), 1)
    latest = LatestTable(str(tmp_path / "out"), ("pf",), "ts", "id", ("lon", "lat"), 2)
    parts = batch.randomSplit([1.0] * 4, 7)
    for number, part in enumerate(parts):
        for _ in range(2):
            latest.merge(part, number)
    assert same(latest.current(spark), newest(batch))
    # A batch that died while its segments were merged is written again.
    (tmp_path / "out" / "generation=0" / "segment=0-3" / "_SUCCESS").unlink()
    assert same(latest.current(spark), newest(batch))
    latest.merge(parts[3], 3)
    assert latest._log(0).largest(spark) == [(0, 3)] and same(latest.current(spark), newest(batch))


def test_closed_windows_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = land(spark, folder, 4)
    stream = cell_means(source(spark, folder, batch.schema), GRID, "ts", "v", "6 hours", "1 day")
    write_closed(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    closed = batch.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]
    want = g.bin_mean(batch.withColumn("window", F.window("ts", "6 hours")), GRID, "v", keys=("window",))
    want = want.filter(F.col("window.end") <= F.lit(closed))
    assert got.count() == want.count() > 0
    pick = lambda df: df.select("window.start", "ix", "iy", F.round("value", 9).alias("value"), "n")
    assert pick(got).exceptAll(pick(want)).count() == 0


def windows(rows, width="6 hours"):
    return g.bin_mean(rows.withColumn("window", F.window("ts", width)), GRID, "v", keys=("window",))


def picked(df):
    return df.select("window.start", "ix", "iy", F.round("value", 9).alias("value"), "n")


def test_all_windows_equal_the_batch(spark, tmp_path):
    """Open windows included, over several batches, and again after a restart with more files."""
    folder, table = str(tmp_path / "in"), CellTable(str(tmp_path / "out"), "10 days")
    batch = land(spark, folder, 2)
    for more in range(2):
        if more:
            batch.withColumn("ts", F.col("ts") + F.expr("INTERVAL 36 HOURS")).coalesce(1).write.mode("append").parquet(folder)
        stream = cell_means(source(spark, folder, batch.schema), GRID, "ts", "v", "6 hours", "10 days")
        got = table.run(stream, str(tmp_path / "cp"))
        assert same(picked(got), picked(windows(spark.read.parquet(folder))))
    assert not (tmp_path / "out" / "closed").exists()


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_closed_days_are_written_once(few_partitions, spark, tmp_path):
    """Fifty batches of a quarter day: as many folders as days and open segments."""
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    start = 1_704_067_200
    rows = spark.range(1500).select(
        F.timestamp_seconds(F.lit(start) + F.col("id") * 864 - F.when(F.col("id") % 7 == 0, 5000).otherwise(0)).alias("ts"),
        (F.col("id") * 7919 % 360 - 180).cast("double").alias("lon"), (F.col("id") * 104729 % 180 - 90).cast("double").alias("lat"), (F.col("id") % 9).cast("double").alias("v"),
    )
    (tmp_path / "in").mkdir()
    everything = rows.withColumn("batch", F.greatest(F.lit(0), F.least(F.lit(49), (F.unix_seconds("ts") - start) / 25_920)).cast("int")).toPandas()
    everything["ts"] = everything["ts"].dt.tz_localize("UTC")
    for i in range(50):
        part = everything[everything["batch"] == i].drop(columns="batch")
        part.astype({"ts": "datetime64[us, UTC]"}).to_parquet(f"{folder}/part-{i:02}.parquet")
    stored = spark.read.parquet(folder).count()
    table = CellTable(str(out), "3 hours", 4)
    schema = "ts timestamp, lon double, lat double, v double"
    stream = source(spark, folder, schema).withColumn("v", F.col("v"))
    got = table.run(cell_means(stream, GRID, "ts", "v", "6 hours", "3 hours"), str(tmp_path / "cp"))
    whole = spark.read.schema(schema).parquet(folder)
    assert stored == 1500 and same(picked(got), picked(windows(whole)))
    days = whole.select(F.to_date("ts")).distinct().count()
    closed, opened = list((out / "closed").glob("upto=*/day=*")), list((out / "open").glob("segment=*"))
    assert days - 2 <= len(closed) <= days and len({c.name for c in closed}) == len(closed)
    # Open segments: three of each tier at most, and what the last batch has just covered.
    assert len(opened) <= 12
    moved = spark.read.option("basePath", str(out / "closed")).parquet(*map(str, (out / "closed").glob("upto=*")))
    assert moved.filter(F.to_date(F.col("window.end") - F.expr("INTERVAL 1 SECOND")) != F.col("day")).count() == 0
    # A move that died after the days were written leaves windows in both places; they count once.
    log = table._log
    rest = log.rows(spark).select("window", "ix", "iy", "value", "n", "batch")
    again = moved.limit(5).select("window", "ix", "iy", "value", "n", F.lit(0).cast("long").alias("batch"))
    last = log.largest(spark)[-1][1]
    rest.unionByName(again).write.parquet(f"{out}/open/segment=0-{last + 1}")
    assert same(picked(table.current(spark)), picked(windows(whole)))
