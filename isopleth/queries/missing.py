"""Operators on tables that hold null, NaN and infinite numbers and longitudes of 0 to 360."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import dates as dd
from ..functions.missing import rounded
from ..operators import grid as g
from ..operators import points as p
from ..operators import series as s
from .base import d, observations, query, table, with_obs
from .calendar import LATEST
from .grids import COARSE, cells_sql, ramp_sql
from .rolling import delta_class_sql
from .tiles import FINEST

NAN, INF = float("nan"), float("inf")


def spoilt(number, key, by: int):
    """A number that every ``by`` rows is null, NaN, plus and minus infinity in turn."""
    odd = key % by
    return F.when(odd == 1, F.lit(None)).when(odd == 2, F.lit(NAN)).when(odd == 3, F.lit(INF)).when(odd == 4, F.lit(-INF)).otherwise(number)


def spoilt_sql(number: str, key: str, by: int) -> str:
    return f"""CASE {key} % {by} WHEN 1 THEN NULL WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE)
    WHEN 4 THEN CAST('-Infinity' AS DOUBLE) ELSE {number} END"""


def spoilt_observations(spark, sf_dir):
    """Every third longitude counts from 0 to 360; some places and values are no numbers."""
    i = F.col("event_id")
    lon = F.when((i % 3 == 0) & (F.col("lon") < 0), F.col("lon") + 360.0).otherwise(F.col("lon"))
    return observations(spark, sf_dir).withColumns({
        "lon": spoilt(lon, i, 31), "lat": spoilt(F.col("lat"), i, 37), "v": spoilt(F.col("v"), i, 41),
    })


WRAPPED = f"CASE WHEN lon BETWEEN -180 AND 180 THEN lon ELSE (lon + {d(180)}) % {d(360)} - {d(180)} END"
SPOILT = f""", turned AS (
  SELECT event_id, member, CASE WHEN event_id % 3 = 0 AND lon < 0 THEN lon + {d(360)} ELSE lon END AS lon, lat, v FROM obs
), spoilt AS (
  SELECT member, {spoilt_sql("lon", "event_id", 31)} AS lon, {spoilt_sql("lat", "event_id", 37)} AS lat, {spoilt_sql("v", "event_id", 41)} AS v FROM turned
), known AS (SELECT member, {WRAPPED} AS lon, lat, v FROM spoilt WHERE isfinite(lon) AND isfinite(lat))"""


@query(
    with_obs(SPOILT + f"""
SELECT member, {FINEST} AS z, least({2 ** (FINEST + 1) - 1}, CAST(floor((lon + {d(180)}) / {d(180 / 2**FINEST)}) AS BIGINT)) AS x,
       greatest(0, least({2**FINEST - 1}, CAST(floor(({d(90)} - lat) / {d(180 / 2**FINEST)}) AS BIGINT))) AS y, count(*) AS n
FROM known GROUP BY ALL""")
)
def tile_density_missing(spark, sf_dir):
    return p.density(spoilt_observations(spark, sf_dir), FINEST, ["member"])


@query(
    with_obs(SPOILT + f""", edged AS (SELECT CASE WHEN lon = 180 THEN {d(-180)} ELSE lon END AS lon, lat, CASE WHEN isfinite(v) THEN v END AS v FROM known),
placed AS ({cells_sql(COARSE, source="edged")}),
cells AS (SELECT ix, iy, round(avg(v), 6) AS value FROM placed GROUP BY ix, iy),
dense AS (
  SELECT x.range AS ix, y.range AS iy, CASE WHEN (x.range + y.range) % 23 = 5 THEN CAST('NaN' AS DOUBLE) WHEN (x.range + y.range) % 23 = 6 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS value
  FROM range({COARSE.nx}) x CROSS JOIN range({COARSE.ny}) y LEFT JOIN cells ON cells.ix = x.range AND cells.iy = y.range
), scaled AS (SELECT ix, iy, isfinite(value) AS shown, greatest({d(0)}, least({d(1)}, value / {d(300)})) AS t FROM dense)
SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, {", ".join(f"CASE WHEN shown THEN {ramp_sql(colour.RAMPS['precip'], 't', k)} ELSE 0 END AS {c}" for k, c in ((1, "r"), (2, "g"), (3, "b")))},
       CASE WHEN shown THEN {colour.GRID_ALPHA} ELSE 0 END AS a
FROM scaled""")
)
def painted_missing(spark, sf_dir):
    """Every cell of a grid, also those without a value or with one that is no number."""
    cells = g.bin_mean(spoilt_observations(spark, sf_dir), COARSE, "v").withColumn("value", rounded("value", 6))
    dense = g.spine(spark, COARSE).join(cells, ["ix", "iy"], "left")
    odd = (F.col("ix") + F.col("iy")) % 23
    spoiled = dense.withColumn("value", F.when(odd == 5, F.lit(NAN)).when(odd == 6, F.lit(INF)).otherwise(F.col("value")))
    return g.ramp_painted(spoiled, "precip", 0, 300).select("ix", "iy", "rgba.*")


DELTA_SCALE = 100_000.0


@query(f"""
WITH o AS (SELECT o_orderkey, {spoilt_sql(f"round(o_totalprice - {d(150_000)}, 2)", "o_orderkey", 9)} AS x FROM orders),
known AS (SELECT o_orderkey, CASE WHEN isfinite(x) THEN x END AS x FROM o),
classed AS (SELECT o_orderkey, x, {delta_class_sql("x", DELTA_SCALE)} FROM known)
SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN direction END AS direction,
       CASE WHEN x IS NOT NULL THEN r ELSE 0 END AS r, CASE WHEN x IS NOT NULL THEN g ELSE 0 END AS g,
       CASE WHEN x IS NOT NULL THEN b ELSE 0 END AS b, CASE WHEN x IS NOT NULL THEN a ELSE 0 END AS a
FROM classed
""")
def delta_class_missing(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key, spoilt(F.round(F.col("o_totalprice") - 150_000.0, 2), key, 9).alias("x"))
    return orders.select(
        key, colour.delta_direction("x", DELTA_SCALE).alias("direction"), colour.delta_colour("x", DELTA_SCALE).alias("c")
    ).select("o_orderkey", "direction", "c.*")


@query(f"""
WITH o AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders), k AS (SELECT DATE '{LATEST}' AS latest)
SELECT day, count(*) AS n, CAST(day + INTERVAL 5 DAYS AS DATE) AS plus_five,
  make_date(year(day) - 5, month(day), CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END) AS five_years_before,
  CASE WHEN day IS NOT NULL THEN CAST(least(date_trunc('month', day), date_trunc('month', latest) - INTERVAL 1 MONTH) AS DATE) END AS composite,
  CASE WHEN day IS NOT NULL THEN least(latest, greatest(DATE '2000-01-01', CAST(day - INTERVAL 1 MONTH AS DATE))) END AS month_back,
  round(year(day) + (dayofyear(day) - 1) / CAST(CASE WHEN make_date(year(day), 12, 31) - make_date(year(day), 1, 1) = 365 THEN 366 ELSE 365 END AS DOUBLE), 9) AS decimal_year
FROM o, k GROUP BY day, latest
""")
def calendar_missing(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    days = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    latest = F.lit(LATEST)
    return days.select(
        "day", "n", dd.add_days("day", 5).alias("plus_five"), dd.compare_date("day", 5).alias("five_years_before"),
        dd.month_snap("day", latest).alias("composite"), dd.step_date("day", "month", -1, latest).alias("month_back"),
        rounded(dd.decimal_year("day"), 9).alias("decimal_year"),
    )


@query(f"""
WITH o AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {spoilt_sql(f"CAST((o_custkey * 6007) % 36000 AS DOUBLE) / {d(100)}", "o_orderkey", 31)} AS lon,
         {spoilt_sql(f"CAST((o_custkey * 3571) % 18000 AS DOUBLE) / {d(100)} - {d(90)}", "o_orderkey", 37)} AS lat,
         {spoilt_sql("o_totalprice", "o_orderkey", 41)} AS v FROM orders
), w AS (
  SELECT month, v, cos(radians(lat)) AS w, (lon >= 310 OR lon < 10) AND lat >= 20 AND lat < 70 AS inside
  FROM o WHERE isfinite(lon) AND isfinite(lat) AND isfinite(v)
)
SELECT month, round(sum(CASE WHEN inside THEN w * v END) / sum(CASE WHEN inside THEN w END), 5) AS box, round(sum(w * v) / sum(w), 5) AS globe,
       round(sum(CASE WHEN inside THEN w * v END) / sum(CASE WHEN inside THEN w END) - sum(w * v) / sum(w), 5) AS index
FROM w GROUP BY month
""")
def fingerprint_wrapped(spark, sf_dir):
    """Longitudes of 0 to 360, some of them no numbers, against a box across the prime meridian."""
    k, row = F.col("o_custkey"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderdate", spoilt(((k * 6007) % 36000).cast("double") / F.lit(100.0), row, 31).alias("lon"),
        spoilt(((k * 3571) % 18000).cast("double") / F.lit(100.0) - 90.0, row, 37).alias("lat"), spoilt(F.col("o_totalprice"), row, 41).alias("v"),
    )
    out = s.fingerprint(orders, "o_orderdate", "lon", "lat", "v", (-50, 20, 10, 70))
    return out.select("month", *[rounded(c, 5).alias(c) for c in ("box", "globe", "index")])
