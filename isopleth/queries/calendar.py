"""Calendar functions over order dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as dd
from ..functions.missing import rounded
from .base import d, query, table

LATEST = dt.date(2001, 6, 20)


@query(f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), k AS (SELECT DATE '{LATEST}' AS latest)
SELECT day, CAST(day + INTERVAL 5 DAYS AS DATE) AS plus_five,
  make_date(year(day) - 5, month(day), CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END) AS five_years_before,
  CAST(least(date_trunc('month', day), date_trunc('month', latest) - INTERVAL 1 MONTH) AS DATE) AS composite,
  least(latest, greatest(DATE '2000-01-01', CAST(day - INTERVAL 1 MONTH AS DATE))) AS month_back,
  least(latest, greatest(DATE '2000-01-01', CAST(day + INTERVAL 1 YEAR AS DATE))) AS year_on,
  least(latest, greatest(DATE '2000-01-01', CAST(day + INTERVAL 1 DAY AS DATE))) AS day_on,
  round(year(day) + (dayofyear(day) - 1) / CAST(CASE WHEN make_date(year(day), 12, 31) - make_date(year(day), 1, 1) = 365 THEN 366 ELSE 365 END AS DOUBLE), 9) AS decimal_year
FROM days, k
""")
def calendar_rules(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    latest = F.lit(LATEST)
    return days.select(
        "day",
        dd.add_days("day", 5).alias("plus_five"),
        dd.compare_date("day", 5).alias("five_years_before"),
        dd.month_snap("day", latest).alias("composite"),
        dd.step_date("day", "month", -1, latest).alias("month_back"),
        dd.step_date("day", "year", 1, latest).alias("year_on"),
        dd.step_date("day", "day", 1, latest).alias("day_on"),
        rounded(dd.decimal_year("day"), 9).alias("decimal_year"),
    )


def offsets_sql(days: int) -> str:
    return f"""SELECT DISTINCT CAST(floor(i * CAST({days} - 1 AS DOUBLE) / (least(12, {days}) - 1) + {d(0.5)}) AS INTEGER) AS off
    FROM (SELECT unnest(range(least(12, {days}))) AS i)"""


@query(f"""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), f AS ({offsets_sql(30)})
SELECT CAST(day - off AS DATE) AS sample_day, CAST(sum(n) AS BIGINT) AS used, 'past 30 days' AS label FROM o, f GROUP BY 1
""")
def sample_dates(spark, sf_dir):
    """How often each date is sampled when a 30-day window ends on every order."""
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    listed = ends.select("n", F.explode(dd.window_sample_dates("day", 30, 12)).alias("sample_day"))
    out = listed.groupBy("sample_day").agg(F.sum("n").alias("used"))
    return out.withColumn("label", dd.window_label(F.lit(30)))
