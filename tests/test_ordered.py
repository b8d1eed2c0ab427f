"""Ordered operators against brute force, with one series holding most rows and many chunks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isopleth.operators import points as p
from isopleth.operators import quality as q
from isopleth.operators import series as s
from isopleth.plans import ordered as o


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(900):
        series = "hot" if rng.random() < 0.6 else ("(none)" if i % 5 == 0 else f"s{i % 5}")
        # many equal times, one of them crowded, so that chunks split inside a time
        t = 50 if rng.random() < 0.3 else rng.randrange(100)
        out.append((i, series, t, None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 2)))
    return pd.DataFrame(out, columns=["id", "series", "t", "v"]).astype({"v": "float64"})


def frame(spark, rows):
    data = [(int(a), None if b == "(none)" else b, int(c), None if np.isnan(d) else float(d)) for a, b, c, d in rows.itertuples(index=False)]
    return spark.createDataFrame(data, "id long, series string, t long, v double")


@pytest.fixture
def df(both_ways, rows):
    return frame(both_ways, rows)


def in_order(rows):
    return rows.sort_values(["series", "t", "id"])


def test_a_hot_series_spans_chunks(many_chunks, rows):
    tagged = o.ordered(frame(many_chunks, rows), ["series"], ["t", "id"])
    assert tagged.rows.filter("series = 'hot'").select(o.CHUNK).distinct().count() > 2
    crowded = tagged.rows.filter("series = 'hot' and t = 50").select(o.CHUNK).distinct().count()
    assert crowded > 1


def test_row_numbers(df, rows):
    got = o.row_numbers(o.ordered(df, ["series"], ["t", "id"])).toPandas().set_index("id")["rn"]
    want = (in_order(rows).groupby("series").cumcount() + 1).rename("rn")
    want.index = in_order(rows)["id"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_global_row_numbers(df, rows):
    got = o.row_numbers(o.ordered(df, [], ["t", "id"])).toPandas().sort_values("rn")["id"].tolist()
    assert got == rows.sort_values(["t", "id"])["id"].tolist()


def test_previous_keeps_nulls(df, rows):
    got = o.previous(o.ordered(df, ["series"], ["t", "id"]), F.col("v"), "before").toPandas().set_index("id")["before"]
    want = in_order(rows).groupby("series")["v"].shift()
    want.index = in_order(rows)["id"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_block_mean(df, rows):
    got = s.block_mean(df, ["series"], "t", "id", ["v"], step=7).fillna("(none)", ["series"]).toPandas().sort_values(["series", "block"])
    want = []
    for name, group in in_order(rows).groupby("series"):
        for b in range(len(group) // 7):
            part = group.iloc[b * 7 : b * 7 + 7]
            want.append((name, b, part["t"].iloc[3], part["v"].mean()))
    want = pd.DataFrame(want, columns=["series", "block", "t", "v"])
    assert got[["series", "block", "t"]].values.tolist() == want[["series", "block", "t"]].values.tolist()
    np.testing.assert_allclose(got["v"].astype(float), want["v"])


def test_only_summaries_meet_in_one_task(many_chunks, rows):
    """Without series, one row per chunk crosses ``SinglePartition``; the rows never do."""
    for series in (["series"], []):
        tagged = o.ordered(frame(many_chunks, rows), series, ["t", "id"])
        for out in (o.row_numbers(tagged), o.running_sum(tagged, F.col("id"), "total"), o.previous(tagged, F.col("v"), "p"), o.neighbours(tagged, F.col("v"), "b", "a")):
            lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
            windows = [line for line in lines if "Window [" in line]
            rowwise = [line for line in windows if "_part" not in line and "_last" not in line and "_newest" not in line and "_oldest" not in line]
            assert rowwise and all(f"{o.CHUNK}#" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in rowwise)


def shuffles_of_rows(df):
    """Exchanges that aren't on the way to a broadcast, with the lines under which they stand."""
    out, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, text) for d, text in above if d < depth]
        if " Exchange " in f" {line.strip(' :+-')} " and not any("BroadcastExchange" in text for _, text in above):
            out.append(line.strip())
        above.append((depth, line))
    return out


def test_rows_are_not_shuffled_again(many_chunks, rows):
    """Above the scan of the tagged table only summary rows move."""
    for series in (["series"], []):
        tagged = o.ordered(frame(many_chunks, rows), series, ["t", "id"])
        for out in (o.row_numbers(tagged), o.running_sum(tagged, F.col("id"), "total"), o.previous(tagged, F.col("v"), "p"), o.neighbours(tagged, F.col("v"), "b", "a")):
            assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
            assert shuffles_of_rows(out) == []
        assert len(shuffles_of_rows(tagged.rows.groupBy("v").count())) == 1


def test_two_summary_rows_a_chunk(many_chunks):
    """A thousand short series: only those at the ends of chunks can go on in another one."""
    df = many_chunks.range(4000).select((F.col("id") % 1000).alias("s"), "id")
    tagged = o.ordered(df, ["s"], ["id"])
    chunks = tagged.rows.select(o.CHUNK).distinct().count()
    assert chunks > 3 and tagged.summary(F.count(F.lit(1)).alias("n")).count() <= 2 * chunks
    assert o.row_numbers(tagged).filter("rn <> (id - s) / 1000 + 1").count() == 0


def test_block_of_missing_samples_is_missing(both_ways):
    df = both_ways.createDataFrame([("a", i, None) for i in range(4)], "series string, t long, v double")
    got = s.block_mean(df.withColumn("id", F.col("t")), ["series"], "t", "id", ["v"], step=2).collect()
    assert [(r["t"], r["v"]) for r in sorted(got)] == [(1, None), (3, None)]


def test_gap_segments(df, rows):
    got = {(r["series"], r["start"], r["end"], r["n"]) for r in s.gap_segments(df, ["series"], "t", "id", "v").fillna("(none)", ["series"]).collect()}
    want = set()
    for name, group in in_order(rows).groupby("series"):
        run = []
        for t, v in [*zip(group["t"], group["v"]), (None, float("nan"))]:
            if np.isnan(v):
                if run:
                    want.add((name, run[0], run[-1], len(run)))
                run = []
            else:
                run.append(t)
    assert got == want


@pytest.mark.parametrize("outside", ["none", "clamp"])
def test_nearest_sample(df, rows, outside):
    samples = df.filter("v is not null").groupBy("series", "t").agg(F.avg("v").alias("v"))
    probes = df.select("id", "series", (F.col("t") * 2 - 50).alias("t"))
    got = s.nearest_sample(probes, samples, ["series"], "t", "id", "v", outside).fillna("(none)", ["series"]).collect()
    known = rows.dropna().groupby(["series", "t"])["v"].mean()
    assert len(got) == len(rows)
    for r in got:
        times = known[r["series"]].index.to_numpy()
        best = min(times, key=lambda x: (abs(x - r["t"]), -x))
        if outside == "none" and not times.min() <= r["t"] <= times.max():
            assert r["sample_t"] is None and r["v"] is None
        else:
            assert r["sample_t"] == best and r["v"] == pytest.approx(known[r["series"]][best])


def test_pages_cover_the_whole_ranking(df, rows):
    got = p.paged(df.filter("v is not null"), "v", "id", size=50).toPandas().sort_values("rank")
    want = rows.dropna().sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["page"].tolist() == [i // 50 for i in range(len(want))]


def test_descending_check_counts_every_step(df, rows):
    got = q.descending(df.filter("v is not null"), "d", "id", "v").first()
    v = rows.dropna().sort_values("id")["v"]
    assert got["observed"] == (v.diff() > 0).sum() and not got["passed"]
