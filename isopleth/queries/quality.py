"""One report of expectations over several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import quality as q
from .base import query, table

CHECKS_SQL = """
WITH c AS (SELECT *, CAST((c_custkey * 6007) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 3571) % 18000 AS DOUBLE) / 100 - 90 AS lat FROM customer),
y AS (SELECT year(o_orderdate) AS y, CAST(avg(o_totalprice) AS DOUBLE) AS a, min(o_totalprice) AS b FROM orders GROUP BY 1),
steps AS (SELECT p_retailprice, lag(p_retailprice) OVER (ORDER BY p_partkey) AS before FROM part),
raw(dataset, "check", observed, low, high, strict) AS (
  SELECT 'customer', 'required:c_name', (SELECT count(*) FROM c WHERE c_name IS NULL OR trim(c_name) = ''), 0, 0, false
  UNION ALL SELECT 'customer', 'unique:c_custkey', (SELECT count(c_custkey) - count(DISTINCT c_custkey) FROM c), 0, 0, false
  UNION ALL SELECT 'customer', 'row_count', (SELECT count(*) FROM c), 100, 1e12, false
  UNION ALL SELECT 'customer', 'flagged:debt', (SELECT count(*) FROM c WHERE c_acctbal < 0), 1, NULL, false
  UNION ALL SELECT 'customer', 'coordinates', (SELECT count(*) FROM c WHERE abs(lon) > 180 OR abs(lat) > 90), 0, 0, false
  UNION ALL SELECT 'customer', 'share:debt', (SELECT count(CASE WHEN c_acctbal < 0 THEN 1 END) / count(*)::DOUBLE FROM c), NULL, 0.6, true
  UNION ALL SELECT 'orders', 'min:o_totalprice', (SELECT min(o_totalprice) FROM orders), 0, NULL, true
  UNION ALL SELECT 'orders', 'max:o_totalprice', (SELECT max(o_totalprice) FROM orders), NULL, 1e5, true
  UNION ALL SELECT 'orders', 'starts:year', (SELECT min(year(o_orderdate)) FROM orders), NULL, 1995, false
  UNION ALL SELECT 'orders', 'reaches:year', (SELECT max(year(o_orderdate)) FROM orders), 2001, NULL, false
  UNION ALL SELECT 'orders', 'counts:o_orderkey=o_custkey', (SELECT count(o_orderkey) - count(o_custkey) FROM orders), 0, 0, false
  UNION ALL SELECT 'yearly', 'order:mean over min', (SELECT count(*) FROM y WHERE y = 2000 AND a > b), 1, NULL, false
  UNION ALL SELECT 'pages', 'url:url', (SELECT count(*) FROM pages WHERE NOT regexp_matches(url, '^https?://')), 0, 0, false
  UNION ALL SELECT 'embeddings', 'aligned:embedding', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64), 0, 0, false
  UNION ALL SELECT 'part', 'descending:p_retailprice', (SELECT count(*) FROM steps WHERE p_retailprice > before), 0, 0, false
)
SELECT dataset, "check", CAST(observed AS DOUBLE) AS observed, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high,
  coalesce(CASE WHEN strict THEN observed > low ELSE observed >= low END, true) AND coalesce(CASE WHEN strict THEN observed < high ELSE observed <= high END, true) AS passed
FROM raw
"""


@query(CHECKS_SQL)
def dq_report(spark, sf_dir):
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer").withColumn(
        "lon", ((k * 6007) % 36000).cast("double") / F.lit(100.0) - 180.0
    ).withColumn("lat", ((k * 3571) % 18000).cast("double") / F.lit(100.0) - 90.0)
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    yearly = orders.groupBy("year").agg(F.avg("o_totalprice").alias("a"), F.min("o_totalprice").alias("b"))
    embeddings = table(spark, sf_dir, "embeddings").withColumn("grid", F.sequence(F.lit(1), F.lit(64)))
    debt = F.col("c_acctbal") < 0
    reports = [
        q.report(customer, "customer", [
            q.required("c_name"), q.unique("c_custkey"), q.row_count(100, 1e12), q.flagged("debt", debt, 1),
            q.coordinates(), q.share("debt", debt, F.lit(True), None, 0.6),
        ]),
        q.report(orders, "orders", [
            *q.between("o_totalprice", 0, 1e5), *q.spans(F.col("year"), "year", 1995, 2001),
            q.counts_agree("o_orderkey", "o_custkey"),
        ]),
        q.report(yearly, "yearly", [q.ordered_at("mean over min", F.col("year") == 2000, "a", "b")]),
        q.report(table(spark, sf_dir, "pages"), "pages", [q.url("url")]),
        q.report(embeddings, "embeddings", [q.aligned("embedding", "grid")]),
        q.descending(table(spark, sf_dir, "part"), "part", "p_partkey", "p_retailprice"),
    ]
    return reduce(lambda a, b: a.unionByName(b), reports)
