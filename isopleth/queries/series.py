"""Time-series statistics over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import decimal_year, micros
from ..functions.missing import rounded
from ..operators import series as s
from .base import d, observations, query, table, with_obs


@query("""
WITH numbered AS (
  SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events
)
SELECT event_type, CAST(i // 20 AS BIGINT) AS block, max(CASE WHEN i % 20 = 10 THEN ts END) AS ts, round(avg(value), 9) AS value
FROM numbered GROUP BY event_type, i // 20 HAVING count(*) = 20
""")
def block_mean(spark, sf_dir):
    out = s.block_mean(table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", ["value"], 20)
    return out.select("event_type", "block", "ts", rounded("value", 9).alias("value"))


@query("""
WITH numbered AS (SELECT ts, v, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM (
  SELECT ts, event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS v FROM events))
SELECT CAST(i // 20 AS BIGINT) AS block, max(CASE WHEN i % 20 = 10 THEN ts END) AS ts, round(avg(v), 9) AS v
FROM numbered GROUP BY i // 20 HAVING count(*) = 20
""")
def block_mean_single(spark, sf_dir):
    """All events as one series with missing samples: no key to divide the work by."""
    out = s.block_mean(observations(spark, sf_dir), [], "ts", "event_id", ["v"], 20)
    return out.select("block", "ts", rounded("v", 9).alias("v"))


def order_cents(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.round(F.col("o_totalprice") * 100).alias("cents"),
    )


ORDERS_SQL = """o AS (
  SELECT o_orderpriority AS series, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
)"""
DAILY_SQL = ORDERS_SQL + """, daily AS (
  SELECT series, day, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS value FROM o GROUP BY series, day
)"""


def daily(spark, sf_dir):
    return order_cents(spark, sf_dir).groupBy("series", "day").agg((F.avg("cents") / 100).alias("value"))


@query(f"""
WITH {DAILY_SQL}
SELECT series, round(avg(CASE WHEN year(day) >= 1995 AND year(day) < 1998 THEN value END), 6) AS early,
       round(avg(CASE WHEN year(day) >= 1999 AND year(day) < 2002 THEN value END), 6) AS recent,
       count(CASE WHEN year(day) >= 1995 AND year(day) < 1998 THEN 1 END) AS n_early,
       count(CASE WHEN year(day) >= 1999 AND year(day) < 2002 THEN 1 END) AS n_recent,
       round(arg_max(value, day), 6) AS latest, max(day) AS latest_at,
       round(min(value), 6) AS vmin, round(max(value), 6) AS vmax, round(avg(value), 6) AS mean
FROM daily GROUP BY series
""")
def period_stats(spark, sf_dir):
    out = s.period_stats(daily(spark, sf_dir), ["series"], "day", "value", (1995, 1998), (1999, 2002))
    return out.select(
        "series", "n_early", "n_recent", "latest_at",
        *[rounded(c, 6).alias(c) for c in ("early", "recent", "latest", "vmin", "vmax", "mean")],
    )


@query(f"""
WITH {ORDERS_SQL}, t AS (
  SELECT series, cents / {d(100)} AS v, year(day) + (dayofyear(day) - 1) / CAST(make_date(year(day) + 1, 1, 1) - make_date(year(day), 1, 1) AS DOUBLE) AS t FROM o
)
SELECT series, round(regr_slope(v, t), 4) AS slope, count(*) AS n FROM t GROUP BY series
""")
def trend(spark, sf_dir):
    orders = order_cents(spark, sf_dir).select(
        "series", decimal_year("day").alias("t"), (F.col("cents") / 100).alias("v")
    )
    return s.trend(orders, ["series"], "t", "v").select("series", rounded("slope", 4).alias("slope"), "n")


def yearly_by_region(spark, sf_dir):
    """Revenue per region and full year; the dimension tables are 25 and 5 rows."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )
    by_customer = orders.groupBy("o_custkey", "year").agg(F.sum("cents").alias("cents"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("component"), F.col("r_regionkey").alias("rank"), "year")
        .agg((F.sum("cents").cast("double") / 100).alias("value"))
    )


REGION_SQL = """yearly AS (
  SELECT r_name AS component, r_regionkey AS rank, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ALL
), changes AS (
  SELECT component, rank, arg_min(value, year) AS first, arg_max(value, year) AS last, min(year) AS first_t, max(year) AS last_t FROM yearly GROUP BY ALL
)"""


@query(f"WITH {REGION_SQL} SELECT *, round(last - first, 4) AS change FROM changes")
def total_change(spark, sf_dir):
    out = s.total_change(yearly_by_region(spark, sf_dir), ["component", "rank"], "year", "value")
    return out.withColumn("change", rounded("change", 4))


@query(f"WITH {REGION_SQL} SELECT component, round(last - first, 4) AS change FROM changes ORDER BY last - first DESC, rank LIMIT 1")
def top_driver(spark, sf_dir):
    changes = s.total_change(yearly_by_region(spark, sf_dir), ["component", "rank"], "year", "value")
    return s.largest_change(changes, "component", "rank").withColumn("change", rounded("change", 4))


@query("""
WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS orders FROM orders GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS lines FROM lineitem GROUP BY 1)
SELECT month, round(lines, 6) AS lines, round(orders, 6) AS orders FROM b LEFT JOIN a USING (month)
""")
def series_align(spark, sf_dir):
    """Monthly means; shipments go on for some months after the last order."""
    mean = lambda df, t, v, name: df.groupBy(F.trunc(t, "MM").alias("month")).agg(
        rounded(F.avg(F.round(F.col(v) * 100)) / 100, 6).alias(name)
    )
    orders = mean(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "orders")
    lines = mean(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice", "lines")
    return s.align(lines, orders, ["month"])


@query("""
WITH y AS (
  SELECT c_mktsegment AS series, CAST(year(o_orderdate) AS INTEGER) AS t, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
), base AS (SELECT c_mktsegment AS series, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS base FROM customer GROUP BY 1),
anchors AS (SELECT series, arg_min(value, t) AS anchor FROM y WHERE t >= 1998 GROUP BY series)
SELECT series, t, round(value + (base - anchor), 6) AS value FROM y JOIN base USING (series) JOIN anchors USING (series)
""")
def rebase(spark, sf_dir):
    cents = lambda c: F.round(F.col(c) * 100)
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series"), cents("c_acctbal").alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("t"), cents("o_totalprice").alias("v"))
    yearly = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("series", "t").agg((F.avg("v") / 100).alias("value"))
    )
    base = customers.groupBy("series").agg((F.avg("b") / 100).alias("base"))
    out = s.rebase(yearly, ["series"], "t", "value", 1998, base, "base")
    return out.select("series", "t", rounded("value", 6).alias("value"))


@query(
    with_obs(""", marked AS (
  SELECT member, ts, v, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY member ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM obs
)
SELECT member, segment, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM marked WHERE v IS NOT NULL GROUP BY member, segment""")
)
def gap_segments(spark, sf_dir):
    return s.gap_segments(observations(spark, sf_dir), ["member"], "ts", "event_id", "v")


NEAREST_SQL = """, timed AS (SELECT event_id, member, v, epoch_us(ts) AS t FROM obs),
samples AS (SELECT member, t, avg(v) AS v FROM timed WHERE v IS NOT NULL GROUP BY ALL),
probes AS (SELECT event_id, member, t FROM timed WHERE v IS NULL),
back AS (SELECT p.event_id, s.t AS bt, s.v AS bv FROM probes p ASOF LEFT JOIN samples s ON p.member = s.member AND p.t >= s.t),
ahead AS (SELECT p.event_id, s.t AS nt, s.v AS nv FROM probes p ASOF LEFT JOIN samples s ON p.member = s.member AND p.t <= s.t),
paired AS (SELECT * FROM probes JOIN back USING (event_id) JOIN ahead USING (event_id))"""


def _nearest(spark, sf_dir, outside):
    timed = observations(spark, sf_dir).withColumn("t", micros("ts"))
    samples = timed.filter(F.col("v").isNotNull()).groupBy("member", "t").agg(F.avg("v").alias("v"))
    probes = timed.filter(F.col("v").isNull()).select("event_id", "member", "t")
    out = s.nearest_sample(probes, samples, ["member"], "t", "event_id", "v", outside)
    return out.select("member", "event_id", "t", "sample_t", rounded("v", 9).alias("v"))


@query(
    with_obs(NEAREST_SQL + """
SELECT member, event_id, t, CASE WHEN nt IS NULL OR bt IS NULL THEN NULL WHEN nt - t <= t - bt THEN nt ELSE bt END AS sample_t,
       round(CASE WHEN nt IS NULL OR bt IS NULL THEN NULL WHEN nt - t <= t - bt THEN nv ELSE bv END, 9) AS v FROM paired""")
)
def nearest_sample(spark, sf_dir):
    return _nearest(spark, sf_dir, "none")


@query(
    with_obs(NEAREST_SQL + """
SELECT member, event_id, t, CASE WHEN nt IS NULL THEN bt WHEN bt IS NULL OR nt - t <= t - bt THEN nt ELSE bt END AS sample_t,
       round(CASE WHEN nt IS NULL THEN bv WHEN bt IS NULL OR nt - t <= t - bt THEN nv ELSE bv END, 9) AS v FROM paired""")
)
def nearest_sample_clamped(spark, sf_dir):
    return _nearest(spark, sf_dir, "clamp")


@query("""
WITH m AS (
  SELECT o_custkey % 25 AS cell, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS s, count(*) AS n FROM orders GROUP BY ALL
), c AS (SELECT cell, month, sum(s) / sum(n) AS clim FROM m WHERE year >= 1995 AND year < 1998 GROUP BY cell, month)
SELECT cell, year, month, n, round((s / n) / 100, 6) AS value, round(clim / 100, 6) AS clim, round((s / n - clim) / 100, 6) AS anomaly
FROM m LEFT JOIN c USING (cell, month)
""")
def anomaly(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).alias("cell"), "o_orderdate", F.round(F.col("o_totalprice") * 100).alias("cents")
    )
    out = s.anomaly(orders, ["cell"], "o_orderdate", "cents", (1995, 1998))
    return out.select("cell", "year", "month", "n", *[rounded(F.col(c) / 100, 6).alias(c) for c in ("value", "clim", "anomaly")])


BUDGET_SQL = """parts AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS component, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
  FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE), 'observed', CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 FROM orders GROUP BY ALL
), wide AS (
  SELECT month, max(CASE WHEN component = 'observed' THEN value END) AS observed, max(CASE WHEN component = 'A' THEN value END) AS a,
         max(CASE WHEN component = 'N' THEN value END) AS n, max(CASE WHEN component = 'R' THEN value END) AS r FROM parts GROUP BY month
), resid AS (SELECT month, observed, a, n, r, a + n + r AS "sum", observed - (a + n + r) AS residual FROM wide WHERE observed IS NOT NULL AND a + n + r IS NOT NULL)"""


def budget(spark, sf_dir):
    total = lambda df, t, v, c: df.groupBy(F.trunc(t, "MM").alias("month"), c.alias("component")).agg(
        (F.sum(F.round(F.col(v) * 100)) / 100).alias("value")
    )
    parts = total(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice", F.col("l_returnflag"))
    whole = total(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", F.lit("observed"))
    return s.budget_residual(parts.unionByName(whole), ["month"], "component", "value", "observed", ["A", "N", "R"])


@query(f'WITH {BUDGET_SQL} SELECT month, round(observed, 2) AS observed, round("sum", 2) AS "sum", round(residual, 2) AS residual FROM resid')
def budget_residual(spark, sf_dir):
    return budget(spark, sf_dir).withColumnRenamed("total", "sum").select("month", *[rounded(c, 2).alias(c) for c in ("observed", "sum", "residual")])


@query(f"""WITH {BUDGET_SQL} SELECT count(*) AS n, round(arg_max(abs(residual), month), 2) AS last_gap,
round(max(abs(residual)), 2) AS max_gap, round(sqrt(avg(residual * residual)), 2) AS rms FROM resid""")
def budget_closure(spark, sf_dir):
    out = s.closure(budget(spark, sf_dir), "month")
    return out.select("n", *[rounded(c, 2).alias(c) for c in ("last_gap", "max_gap", "rms")])


MONTHLY_SQL = ORDERS_SQL + """, monthly AS (
  SELECT series, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(cents) AS DOUBLE) / count(*) AS value FROM o GROUP BY ALL
)"""


@query(f"""
WITH {MONTHLY_SQL}, k AS (SELECT *, year(month) * 12 + month(month) - 1 AS k FROM monthly),
r AS (SELECT series, month, k, value - (regr_slope(value, k) OVER (PARTITION BY series) * k + regr_intercept(value, k) OVER (PARTITION BY series)) AS resid FROM k),
p AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY series ORDER BY k) = k - 1 THEN lag(resid) OVER (PARTITION BY series ORDER BY k) END AS before FROM r),
e AS (SELECT series, month, resid,
  var_pop(resid) OVER (PARTITION BY series ORDER BY k RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS variance,
  corr(resid, before) OVER (PARTITION BY series ORDER BY k RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS lag1,
  count(*) OVER (PARTITION BY series ORDER BY k RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM p)
SELECT series, month, round(resid / 1e6::DOUBLE, 6) AS resid, round(variance / 1e12::DOUBLE, 6) AS variance, round(lag1, 6) AS lag1 FROM e WHERE n = 12
""")
def ews_stats(spark, sf_dir):
    out = s.early_warning(order_cents(spark, sf_dir), ["series"], "day", "cents", 12)
    return out.select(
        "series", "month", rounded(F.col("resid") / 1e6, 6).alias("resid"),
        rounded(F.col("variance") / 1e12, 6).alias("variance"), rounded("lag1", 6).alias("lag1"),
    )


@query("""
WITH m AS (
  SELECT o_orderstatus AS channel, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value
  FROM orders GROUP BY ALL
), z AS (SELECT channel, month, (value - avg(value) OVER (PARTITION BY channel)) / stddev_pop(value) OVER (PARTITION BY channel) AS z FROM m)
SELECT month, round(max(CASE WHEN channel = 'F' THEN z END), 6) AS f, round(max(CASE WHEN channel = 'O' THEN z END), 6) AS o, round(max(CASE WHEN channel = 'P' THEN z END), 6) AS p
FROM z GROUP BY month
""")
def state_vector(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", F.round(F.col("o_totalprice") * 100).alias("cents")
    )
    out = s.state_vector(orders, "o_orderstatus", "o_orderdate", "cents", ["F", "O", "P"])
    return out.select("month", *[rounded(c, 6).alias(c.lower()) for c in ("F", "O", "P")])


@query(f"""
WITH o AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST((o_custkey * 6007) % 36000 AS DOUBLE) / {d(100)} - {d(180)} AS lon,
         CAST((o_custkey * 3571) % 18000 AS DOUBLE) / {d(100)} - {d(90)} AS lat, o_totalprice AS v FROM orders
), w AS (SELECT *, cos(radians(lat)) AS w, lon >= -50 AND lon < 10 AND lat >= 20 AND lat < 70 AS inside FROM o)
SELECT month, round(sum(CASE WHEN inside THEN w * v END) / sum(CASE WHEN inside THEN w END), 5) AS box, round(sum(w * v) / sum(w), 5) AS globe,
       round(sum(CASE WHEN inside THEN w * v END) / sum(CASE WHEN inside THEN w END) - sum(w * v) / sum(w), 5) AS index
FROM w GROUP BY month
""")
def fingerprint(spark, sf_dir):
    k = F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderdate", (((k * 6007) % 36000).cast("double") / F.lit(100.0) - 180.0).alias("lon"),
        (((k * 3571) % 18000).cast("double") / F.lit(100.0) - 90.0).alias("lat"), "o_totalprice",
    )
    out = s.fingerprint(orders, "o_orderdate", "lon", "lat", "o_totalprice", (-50, 20, 10, 70))
    return out.select("month", *[rounded(c, 5).alias(c) for c in ("box", "globe", "index")])
