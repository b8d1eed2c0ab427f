"""The dashboard numbers and the closure checks over yearly and monthly series of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dashboards as dash
from ..functions.missing import rounded
from ..operators import quality as q
from .base import query, table


def rounded_all(df, *names, decimals: int = 6):
    return df.withColumns({n: rounded(n, decimals) for n in names})


@query(f"""
WITH s AS (SELECT make_date(CAST(2000 + o_orderkey % 25 AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS t, CAST(max(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY 1),
p AS (SELECT *, year(t) >= {dash.EARLY_YEARS[0]} AND year(t) < {dash.EARLY_YEARS[1]} AS e, year(t) >= {dash.RECENT_YEARS[0]} AND year(t) < {dash.RECENT_YEARS[1]} AS r FROM s WHERE v IS NOT NULL)
SELECT round(avg(v) FILTER (WHERE e), 6) AS early, round(avg(v) FILTER (WHERE r), 6) AS recent,
  round(avg(v) FILTER (WHERE r) - avg(v) FILTER (WHERE e), 6) AS change, count(*) FILTER (WHERE e) AS n_early, count(*) FILTER (WHERE r) AS n_recent,
  arg_max(v, t) AS latest, max(t) AS latest_at, min(v) AS vmin, max(v) AS vmax, round(avg(v), 6) AS mean
FROM p
""")
def dashboard_transport(spark, sf_dir):
    t = F.make_date((2000 + F.col("o_orderkey") % 25).cast("int"), F.month("o_orderdate"), F.lit(1))
    monthly = table(spark, sf_dir, "orders").groupBy(t.alias("t")).agg(F.max("o_totalprice").cast("double").alias("moc"))
    return rounded_all(dash.transport_numbers(monthly), "early", "recent", "change", "mean")


RISES = ("observed", *dash.COMPONENTS)
_RISES_SQL = ", ".join(f"arg_max({c}, year) FILTER (WHERE {c} IS NOT NULL) - arg_min({c}, year) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in RISES)
_PARTS_SQL = ", ".join(f"CAST(max(CASE WHEN o_custkey % 5 = {k} AND o_orderkey % 25 <> {k} THEN o_totalprice END) AS DOUBLE) AS {c}" for k, c in enumerate(dash.COMPONENTS))


@query(f"""
WITH b AS (SELECT CAST(2000 + o_orderkey % 25 AS BIGINT) AS year, CAST(max(o_totalprice) AS DOUBLE) AS observed, {_PARTS_SQL} FROM orders GROUP BY 1),
r AS (SELECT {_RISES_SQL} FROM b), g AS (SELECT *, greatest({", ".join(dash.COMPONENTS)}) AS largest FROM r)
SELECT observed AS total_rise, CASE {" ".join(f"WHEN {c} = largest THEN '{c}'" for c in dash.COMPONENTS)} END AS driver, largest AS driver_rise,
  (SELECT round(regr_slope(observed, CAST(year AS DOUBLE)), 6) FROM b) AS rate FROM g
""")
def dashboard_sea_level(spark, sf_dir):
    """Components lack a year each, so first and last samples differ between them."""
    price, k = F.col("o_totalprice"), F.col("o_orderkey") % 25
    part = lambda i: F.when((F.col("o_custkey") % 5 == i) & (k != i), price)
    parts = [F.max(part(i)).cast("double").alias(c) for i, c in enumerate(dash.COMPONENTS)]
    budget = table(spark, sf_dir, "orders").groupBy((2000 + k).alias("year")).agg(F.max(price).cast("double").alias("observed"), *parts)
    altimetry = budget.select(F.col("year").cast("double").alias("t"), F.col("observed").alias("v"))
    return rounded_all(dash.sea_level_numbers(budget, altimetry), "rate")


YEARS_SQL = """y AS (
  SELECT CAST(2000 + o_orderkey % 25 AS BIGINT) AS year, CAST(max(CASE WHEN o_orderkey % 25 <> 24 THEN o_totalprice END) AS DOUBLE) AS land_ocean,
         CAST(min(CASE WHEN o_orderkey % 25 <> 0 THEN o_totalprice END) AS DOUBLE) AS land_only FROM orders GROUP BY 1)"""


def yearly(spark, sf_dir):
    """The one series lacks its last year, the other its first."""
    k, price = F.col("o_orderkey") % 25, F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy((2000 + k).alias("year")).agg(
        F.max(F.when(k != 24, price)).cast("double").alias("land_ocean"), F.min(F.when(k != 0, price)).cast("double").alias("land_only")
    )


@query(f"""
WITH {YEARS_SQL}, f AS (SELECT * FROM y WHERE land_ocean IS NOT NULL)
SELECT arg_max(land_ocean, year) AS land_ocean, (SELECT arg_max(land_only, year) FROM y WHERE land_only IS NOT NULL) AS land_only,
  arg_max(land_ocean, year) - arg_min(land_ocean, year) AS since_start, max(year) AS year FROM f
""")
def dashboard_temperature(spark, sf_dir):
    return dash.temperature_numbers(yearly(spark, sf_dir))


@query(f"""
WITH {YEARS_SQL}, f AS (SELECT * FROM y WHERE land_ocean IS NOT NULL AND land_only IS NOT NULL),
raw("check", observed, low, high) AS (
  SELECT 'closure:land_ocean-land_only', (SELECT arg_max(abs(land_ocean - land_only), year) FROM f), NULL, 1000
  UNION ALL SELECT 'last:land_only', (SELECT arg_max(land_only, year) FROM f), 0, NULL
  UNION ALL SELECT 'rise:land_ocean', (SELECT arg_max(land_ocean, year) - arg_min(land_ocean, year) FROM f), -1000000, 1000000
  UNION ALL SELECT 'mean:land_only', (SELECT avg(land_only) FROM f), 0, 1000000)
SELECT 'yearly' AS dataset, "check", round(CAST(observed AS DOUBLE), 6) AS observed, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high,
  coalesce(observed > low, true) AND coalesce(observed < high, true) AS passed FROM raw
""")
def dq_closure(spark, sf_dir):
    """Checks on the last, first and mean values of series; the closure fails on these data."""
    both = yearly(spark, sf_dir).dropna()
    checks = [
        q.last_gap("year", "land_ocean", "land_only", 1000), q.last_positive("year", "land_only"),
        q.rise("year", "land_ocean", -1e6, 1e6), q.mean_between("land_only", 0, 1e6),
    ]
    return rounded_all(q.report(both, "yearly", checks), "observed")
