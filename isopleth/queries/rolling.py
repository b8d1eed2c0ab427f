"""Rolling windows, differences, accumulations and probes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.dates import compare_date_value, sample_date_values
from ..functions.geo import located, pixel_x, pixel_y, tile_x, tile_y
from ..functions.missing import rounded
from ..operators import rolling
from .base import d, observations, query, table, with_obs
from .grids import PROBE_POINTS, probe_points

END = dt.date(2024, 1, 30)
PIXEL = ["x", "y", "px", "py"]
SIZE = 16


def pixelled(df, z: int = 0, size: int = SIZE, known: bool = False):
    """Rows with their pixel. ``known`` leaves out rows without a place first."""
    df = located(df) if known else df
    placed = df.withColumn("x", tile_x("lon", z, known)).withColumn("y", tile_y("lat", z, known))
    return placed.withColumn("px", pixel_x("lon", "x", z, size, known)).withColumn("py", pixel_y("lat", "y", z, size, known))


def pixel_sql(source: str, name: str, columns: str, size: int = SIZE) -> str:
    """Level-0 imagery tiles are 288 degrees wide: 2 x 1 of them, 16 pixels a side by default."""
    return f"""{name} AS (
  SELECT {columns}, x, y,
         CAST(greatest(0, least({size - 1}, floor((lon - ({d(-180)} + x * {d(288)})) / {d(288)} * {size}))) AS BIGINT) AS px,
         CAST(greatest(0, least({size - 1}, floor((({d(90)} - y * {d(288)}) - lat) / {d(288)} * {size}))) AS BIGINT) AS py
  FROM (SELECT *, CAST(greatest(0, least(1, floor((lon + {d(180)}) / {d(288)}))) AS BIGINT) AS x,
               CAST(greatest(0, least(0, floor(({d(90)} - lat) / {d(288)}))) AS BIGINT) AS y FROM {source})
)"""


OBS_PIXELS = pixel_sql("obs", "pixels", "day, member, v")


def dates_sql(dates) -> str:
    return ", ".join(f"DATE '{x}'" for x in dates)


WINDOW_DATES = sample_date_values(END, 30)


@query(
    with_obs(f""", {OBS_PIXELS}
SELECT x, y, px, py, round(avg(v), 9) AS value, count(v) AS n FROM pixels
WHERE v IS NOT NULL AND day IN ({dates_sql(WINDOW_DATES)}) GROUP BY x, y, px, py""")
)
def window_mean(spark, sf_dir):
    obs = pixelled(observations(spark, sf_dir), known=True)
    out = rolling.window_mean(obs, PIXEL, "v", END, 30, time="ts")
    return out.select(*PIXEL, rounded("value", 9).alias("value"), "n")


@query(
    with_obs(f""", {OBS_PIXELS},
daily AS (SELECT x, y, px, py, day, sum(v) AS s, count(*) AS n FROM pixels WHERE v IS NOT NULL GROUP BY ALL)
SELECT x, y, px, py, day, round(sum(s) OVER w / sum(n) OVER w, 9) AS value, CAST(sum(n) OVER w AS BIGINT) AS n
FROM daily WINDOW w AS (PARTITION BY x, y, px, py ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
)
def window_exact(spark, sf_dir):
    out = rolling.rolling_mean(pixelled(observations(spark, sf_dir), known=True), PIXEL, "v", 7)
    return out.select(*PIXEL, "day", rounded("value", 9).alias("value"), "n")


LEAP_END = dt.date(2000, 2, 29)


def order_cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("cell"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.round(F.col("o_totalprice") * 100).alias("cents"),
    )


def delta_class_sql(x: str, scale: float) -> str:
    hidden = f"abs({x}) < {d(scale * colour.DELTA_DEAD_ZONE)}"
    t = f"greatest({d(-1)}, least({d(1)}, {x} / {d(scale)}))"
    channels = ", ".join(
        f"CASE WHEN {hidden} THEN 0 WHEN {t} > 0 THEN {w} ELSE {c} END AS {n}"
        for w, c, n in zip(colour.DELTA_WARM, colour.DELTA_COOL, "rgb")
    )
    return f"""CASE WHEN {hidden} THEN 'none' WHEN {x} > 0 THEN 'increase' ELSE 'decrease' END AS direction, {channels},
  CASE WHEN {hidden} THEN 0 ELSE CAST(floor(least({d(1)}, abs({t}) + {d(colour.DELTA_ALPHA_FLOOR)}) * {colour.DELTA_ALPHA} + {d(0.5)}) AS INTEGER) END AS a"""


DELTA_NOW = sample_date_values(LEAP_END, 60)
DELTA_PAST = sample_date_values(compare_date_value(LEAP_END, 1), 60)
DELTA_SCALE = 20_000.0


@query(f"""
WITH o AS (SELECT o_custkey % 50 AS cell, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
m AS (
  SELECT cell, CAST(sum(CASE WHEN now THEN cents END) AS DOUBLE) / count(CASE WHEN now THEN 1 END) AS now,
         CAST(sum(CASE WHEN past THEN cents END) AS DOUBLE) / count(CASE WHEN past THEN 1 END) AS past,
         count(CASE WHEN now THEN 1 END) AS n_now, count(CASE WHEN past THEN 1 END) AS n_past
  FROM (SELECT *, day IN ({dates_sql(DELTA_NOW)}) AS now, day IN ({dates_sql(DELTA_PAST)}) AS past FROM o)
  GROUP BY cell
), dd AS (SELECT cell, n_now, n_past, round((now - past) / 100, 6) AS delta FROM m WHERE n_now > 0 AND n_past > 0)
SELECT cell, n_now, n_past, delta, {delta_class_sql("delta", DELTA_SCALE)} FROM dd
""")
def window_delta(spark, sf_dir):
    out = rolling.window_delta(order_cells(spark, sf_dir), ["cell"], "cents", LEAP_END, 1, 60, time="ts")
    out = out.select("cell", "n_now", "n_past", rounded(F.col("delta") / 100, 6).alias("delta"))
    return out.withColumn("direction", colour.delta_direction("delta", DELTA_SCALE)).select(
        "*", colour.delta_colour("delta", DELTA_SCALE).alias("c")
    ).select("cell", "n_now", "n_past", "delta", "direction", "c.*")


@query(f"""
WITH o AS (SELECT o_custkey % 50 AS cell, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT cell, CAST(sum(now) AS DOUBLE) / 100 AS now, CAST(sum(past) AS DOUBLE) / 100 AS past,
       (CAST(sum(now) AS DOUBLE) - CAST(sum(past) AS DOUBLE)) / 100 AS change
FROM (SELECT cell, CASE WHEN day BETWEEN DATE '1999-06-02' AND DATE '1999-08-30' THEN cents END AS now,
             CASE WHEN day BETWEEN DATE '1997-06-02' AND DATE '1997-08-30' THEN cents END AS past FROM o)
GROUP BY cell HAVING sum(now) IS NOT NULL AND sum(past) IS NOT NULL
""")
def window_accum(spark, sf_dir):
    out = rolling.window_accumulation(
        order_cells(spark, sf_dir), ["cell"], "cents", dt.date(1999, 8, 30), 2, 90, time="ts"
    )
    return out.select("cell", *[(F.col(c) / 100).alias(c) for c in ("now", "past", "change")])



@query(
    f"""
WITH m AS (SELECT o_custkey % 50 AS cell, date_trunc('month', o_orderdate)::DATE AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
months AS (SELECT DISTINCT unnest([{dates_sql(sample_date_values(dt.date(1999, 6, 15), 400, monthly=True, latest=dt.date(2001, 1, 1)))}]) AS day)
SELECT cell, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS value, count(*) AS n
FROM m JOIN months USING (day) GROUP BY cell
"""
)
def window_monthly(spark, sf_dir):
    """A monthly product: sample dates snap to published months and repeats count once."""
    monthly = order_cells(spark, sf_dir).withColumn("day", F.trunc("day", "MM"))
    out = rolling.window_mean(
        monthly, ["cell"], "cents", dt.date(1999, 6, 15), 400, monthly=True, latest=dt.date(2001, 1, 1)
    )
    return out.select("cell", rounded(F.col("value") / 100, 6).alias("value"), "n")


@query(
    with_obs(f""", {PROBE_POINTS}, {OBS_PIXELS}, {pixel_sql("probes", "asked", "c_custkey")},
field AS (SELECT x, y, px, py, avg(v) AS value, count(v) AS n FROM pixels
          WHERE v IS NOT NULL AND day IN ({dates_sql(WINDOW_DATES)}) GROUP BY x, y, px, py)
SELECT c_custkey, round(value, 9) AS value, n, value IS NULL AS no_data, 'past 30 days' AS label
FROM asked LEFT JOIN field USING (x, y, px, py)""")
)
def point_probe(spark, sf_dir):
    points = pixelled(probe_points(spark, sf_dir)).select("c_custkey", *PIXEL)
    obs = pixelled(observations(spark, sf_dir), known=True)
    out = rolling.probe(points, obs, PIXEL, lambda o: rolling.window_mean(o, PIXEL, "v", END, 30, time="ts"))
    return out.select(
        "c_custkey", rounded("value", 9).alias("value"), "n", F.col("value").isNull().alias("no_data"),
        F.lit("past 30 days").alias("label"),
    )


PROBE_END = dt.date(2024, 1, 20)
PROBE_NOW = sample_date_values(PROBE_END, 10)
PROBE_PAST = sample_date_values(compare_date_value(PROBE_END, 1), 10)


@query(
    with_obs(f""", {PROBE_POINTS}, {OBS_PIXELS}, {pixel_sql("probes", "asked", "c_custkey")},
dated AS (SELECT *, CASE WHEN day(day) % 2 = 0 THEN day ELSE CAST(day - INTERVAL 1 YEAR AS DATE) END AS seen FROM pixels WHERE v IS NOT NULL),
field AS (
  SELECT x, y, px, py, avg(CASE WHEN seen IN ({dates_sql(PROBE_NOW)}) THEN v END) - avg(CASE WHEN seen IN ({dates_sql(PROBE_PAST)}) THEN v END) AS delta
  FROM dated GROUP BY x, y, px, py HAVING delta IS NOT NULL)
SELECT c_custkey, round(delta, 9) AS delta, delta IS NULL AS no_data FROM asked LEFT JOIN field USING (x, y, px, py)""")
)
def point_probe_delta(spark, sf_dir):
    """The change against the year before under each point; every other day is taken as one of the year before."""
    points = pixelled(probe_points(spark, sf_dir)).select("c_custkey", *PIXEL)
    back = F.when(F.dayofmonth("day") % 2 == 0, F.col("day")).otherwise(F.add_months("day", -12))
    obs = pixelled(observations(spark, sf_dir), known=True).withColumn("day", back)
    out = rolling.probe(points, obs, PIXEL, lambda o: rolling.window_delta(o, PIXEL, "v", PROBE_END, 1, 10))
    return out.select("c_custkey", rounded("delta", 9).alias("delta"), F.col("delta").isNull().alias("no_data"))


DATED_SQL = "DATE '1997-01-01' + CAST(c_custkey % 365 AS INTEGER)"


@query(f"""
WITH o AS (SELECT o_custkey % 50 AS cell, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
asked AS (
  SELECT c_custkey, CASE WHEN c_custkey % 17 <> 3 THEN c_custkey % 60 END AS cell, CASE WHEN c_custkey % 19 <> 3 THEN CAST({DATED_SQL} AS DATE) END AS till FROM customer
), ends AS (
  SELECT DISTINCT cell, till, make_date(year(till) - 1, month(till), CASE WHEN month(till) = 2 AND day(till) = 29 THEN 28 ELSE day(till) END) AS before FROM asked
), field AS (
  SELECT e.cell, e.till, CAST(sum(CASE WHEN day > e.till - 45 AND day <= e.till THEN cents END) AS DOUBLE) AS s, count(CASE WHEN day > e.till - 45 AND day <= e.till THEN 1 END) AS n,
         CAST(sum(CASE WHEN day > e.before - 45 AND day <= e.before THEN cents END) AS DOUBLE) AS s_past, count(CASE WHEN day > e.before - 45 AND day <= e.before THEN 1 END) AS n_past
  FROM ends e LEFT JOIN o ON o.cell = e.cell AND ((day > e.till - 45 AND day <= e.till) OR (day > e.before - 45 AND day <= e.before))
  WHERE e.cell IS NOT NULL AND e.till IS NOT NULL GROUP BY e.cell, e.till
)
SELECT c_custkey, asked.till AS day, round(s / n / 100, 6) AS value, n, round(s_past / n_past / 100, 6) AS past, n_past, round((s / n - s_past / n_past) / 100, 6) AS delta
FROM asked LEFT JOIN field ON field.cell = asked.cell AND field.till = asked.till
""")
def point_probe_dated(spark, sf_dir):
    """45 days up to a date of each customer's own, and the same days a year before; some lack the date or the cell."""
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(
        key, F.when(key % 17 != 3, key % 60).alias("cell"), F.when(key % 19 != 3, F.date_add(F.lit("1997-01-01").cast("date"), (key % 365).cast("int"))).alias("till")
    )
    out = rolling.probe_dated(points, order_cells(spark, sf_dir), ["cell"], "cents", "till", 45, years=1)
    part = lambda c: rounded(F.col(c) / 100, 6).alias(c)
    return out.select(key, F.col("till").alias("day"), part("value"), "n", part("past"), "n_past", part("delta"))
