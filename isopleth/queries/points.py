"""Point inventories, taxonomy totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.missing import rounded
from ..functions.text import sparse
from ..operators import points as p
from .base import d, observations, query, table, with_obs


@query(
    with_obs(f"""SELECT platform, round(lon, 3) AS lon, round(lat, 3) AS lat, CAST(ts AS DATE) AS date
FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, event_id) AS r FROM obs)
WHERE r = 1""")
)
def latest_position(spark, sf_dir):
    return p.latest_positions(observations(spark, sf_dir), "platform", "ts", "event_id", "lon", "lat")


@query(
    with_obs("""SELECT platform, round(lon, 3) AS lon, round(lat, 3) AS lat, CAST(ts AS DATE) AS date
FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, event_id) AS r FROM obs
      WHERE ts >= DATE '2024-01-30' - INTERVAL 10 DAYS)
WHERE r = 1""")
)
def active_fleet(spark, sf_dir):
    """Latest positions among platforms seen in the ten days before the given date."""
    recent = p.since(observations(spark, sf_dir), "ts", F.lit("2024-01-30").cast("date"), 10)
    return p.latest_positions(recent, "platform", "ts", "event_id", "lon", "lat")


ASSETS_SQL = """assets AS (
  SELECT p_partkey, CASE WHEN p_brand <> 'Brand#13' THEN round(CAST((p_partkey * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180, 4) END AS lon,
         round(CAST((p_partkey * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90, 4) AS lat,
         CASE WHEN p_type <> 'SMALL' THEN p_retailprice * 1000 END AS q,
         coalesce(p_name, '') AS name, p_brand AS country, p_type AS sector
  FROM part
), kept AS (
  SELECT p_partkey, round(lon, 4) AS lon, round(lat, 4) AS lat, q, name, country, sector
  FROM assets WHERE lon IS NOT NULL AND lat IS NOT NULL AND q IS NOT NULL
)"""


def assets(spark, sf_dir):
    """Parts as facilities, with the nested summary the raw pages have."""
    k = F.col("p_partkey")
    entry = lambda gas, q: F.struct(F.lit(gas).alias("Gas"), q.cast("double").alias("EmissionsQuantity"))
    main = F.when(F.col("p_type") != "SMALL", F.array(
        entry("ch4", F.col("p_size")), entry("co2e_100yr", F.col("p_retailprice") * 1000), entry("co2e_100yr", F.lit(1.0))
    )).otherwise(F.array(entry("ch4", F.col("p_size"))))
    return table(spark, sf_dir, "part").select(
        k,
        F.when(F.col("p_brand") != "Brand#13", ((k * 7919) % 36000).cast("double") / F.lit(100.0) - 180.0).alias("lon"),
        (((k * 104729) % 18000).cast("double") / F.lit(100.0) - 90.0).alias("lat"),
        main.alias("summary"),
        F.coalesce("p_name", F.lit("")).alias("name"),
        F.col("p_brand").alias("country"),
        F.col("p_type").alias("sector"),
    )


def emitters(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("q", p.first_quantity("summary")).drop("summary")
    return p.complete(a, "lon", "lat", "q")


def _emitter_columns(df, *extra):
    return df.select(
        "p_partkey", rounded("lon", 4).alias("lon"), rounded("lat", 4).alias("lat"),
        rounded(F.col("q") / p.TONNES_PER_MEGATONNE, 3).alias("mt_co2e"), "name", "country", "sector", *extra,
    )


@query(f"""
WITH {ASSETS_SQL}
SELECT p_partkey, lon, lat, round(q / {d(1e6)}, 3) AS mt_co2e, name, country, sector
FROM kept ORDER BY q DESC, p_partkey LIMIT 1000
""")
def top_emitters(spark, sf_dir):
    return _emitter_columns(p.top(emitters(spark, sf_dir), "q", "p_partkey", 1000))


@query(f"""
WITH {ASSETS_SQL}
SELECT p_partkey, lon, lat, round(q / {d(1e6)}, 3) AS mt_co2e, name, country, sector
FROM kept ORDER BY q DESC, p_partkey LIMIT 100 OFFSET 100
""")
def page_emitters(spark, sf_dir):
    return _emitter_columns(p.page(emitters(spark, sf_dir), "q", "p_partkey", 100, 100))


@query(f"""
WITH {ASSETS_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY q DESC, p_partkey) AS rank FROM kept)
SELECT p_partkey, lon, lat, round(q / {d(1e6)}, 3) AS mt_co2e, name, country, sector,
       rank, CAST((rank - 1) // 250 AS BIGINT) AS page FROM ranked
""")
def all_pages(spark, sf_dir):
    return _emitter_columns(p.paged(emitters(spark, sf_dir), "q", "p_partkey"), "rank", "page")


RATES_SQL = """rates AS (
  SELECT l_partkey AS id, CASE WHEN count(*) > 12 THEN 'NaN'::DOUBLE
         ELSE CAST(sum(CAST(round((l_tax - l_discount) * 100) AS BIGINT)) AS DOUBLE) / count(*) / 4 END AS rate
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey
), inventory AS (
  SELECT p_partkey AS id, p_brand, p_retailprice AS area,
         CASE WHEN isnan(rate) THEN NULL ELSE round(rate, 6) END AS rate
  FROM part LEFT JOIN rates ON rates.id = p_partkey
)"""


def inventory(spark, sf_dir):
    hundredths = F.round((F.col("l_tax") - F.col("l_discount")) * 100)
    n = F.count(F.lit(1))
    rates = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .groupBy(F.col("l_partkey").alias("id"))
        .agg(F.when(n > 12, F.lit(float("nan"))).otherwise(F.sum(hundredths) / n / 4).alias("rate"))
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", F.col("p_retailprice").alias("area")
    )
    return p.with_rates(parts, rates, "id", "rate", decimals=6)


def _channel(nodata, thin, stable):
    return f"round(CASE WHEN rate IS NULL THEN {nodata} WHEN rate < 0 THEN {thin} ELSE {stable} END, 9)"


SHARE = f"least({d(1)}, -rate / {d(1.5)})"
STRENGTH = f"least({d(1)}, abs(greatest({d(-1)}, least({d(1)}, rate / {d(1.5)}))) + {d(0.1)})"


@query(f"""
WITH {RATES_SQL}
SELECT id, rate, CASE WHEN rate IS NULL THEN 'nodata' WHEN rate < 0 THEN 'thinning' ELSE 'stable' END AS class,
       CASE WHEN area > 50 THEN 'large' ELSE 'small' END AS extent,
       {_channel(d(107 / 255), d(0.95), d(0.22))} AS r,
       {_channel(d(114 / 255), f"{d(0.75)} - {d(0.6)} * {SHARE}", d(0.55))} AS g,
       {_channel(d(128 / 255), d(0.15), d(0.95))} AS b,
       round(CASE WHEN rate IS NULL THEN {d(0.35)} ELSE {d(0.55)} + {d(0.4)} * {STRENGTH} END, 9) AS a
FROM inventory
""")
def inventory_rates(spark, sf_dir):
    painted = inventory(spark, sf_dir).withColumn("c", colour.rate_colour("rate"))
    return painted.select(
        "id", "rate", colour.rate_class("rate").alias("class"), colour.extent_class("area").alias("extent"),
        *[rounded(F.col(f"c.{k}"), 9).alias(k) for k in "rgba"],
    )


@query(f"""
WITH {RATES_SQL}
SELECT count(*) AS n, round(CAST(sum(CAST(round(area * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS total_area,
       count(rate) AS matched, count(CASE WHEN rate < 0 THEN 1 END) AS thinning FROM inventory
""")
def inventory_totals(spark, sf_dir):
    out = p.inventory_totals(inventory(spark, sf_dir), "area", "rate")
    return out.withColumn("total_area", rounded("total_area", 2))


@query("""
WITH items AS (
  SELECT r_name, n_nationkey, n_name, count(c_custkey) AS records
  FROM nation JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_nationkey = n_nationkey GROUP BY ALL
), t AS (SELECT count(*) AS total FROM customer)
SELECT r_name, CAST(sum(records) AS BIGINT) AS records, any_value(total) AS total,
       CAST(sum(records) AS DOUBLE) / any_value(total) AS share,
       CAST(any_value(total) - (SELECT sum(records) FROM items) AS BIGINT) AS unplaced
FROM items, t GROUP BY r_name
""")
def taxonomy_residual(spark, sf_dir):
    items = taxa(spark, sf_dir)
    total = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)))
    return p.group_totals(items, "r_name", "records", total)


def taxa(spark, sf_dir):
    counts = (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") > 0)
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nations.join(counts, "n_nationkey", "left").select(
        "r_name", "n_nationkey", "n_name", F.coalesce("records", F.lit(0)).alias("records")
    )


@query("""
WITH items AS (
  SELECT n_nationkey, n_name, count(c_custkey) AS records FROM nation
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_nationkey = n_nationkey GROUP BY ALL
)
SELECT s_suppkey, n_name AS name, records, records < 50 AS sparse
FROM supplier LEFT JOIN items ON n_nationkey = s_nationkey
""")
def taxon_notes(spark, sf_dir):
    selected = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    lookup = taxa(spark, sf_dir).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "records")
    out = p.taxonomy_lookup(selected, lookup)
    return out.select("s_suppkey", "name", "records", sparse("records", 50).alias("sparse"))
