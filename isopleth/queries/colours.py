"""Colours to values and values to colours, with colormaps derived from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import rounded
from ..operators import colormap as cm
from .base import d, query, table

# Sizes above 40 reuse the colour of (size - 40): a colour that appears twice.
# Sizes below 15 have half a bin, which leaves gaps; sizes from 15 to 24 are single values.
MAP_SQL = """sizes AS (SELECT DISTINCT p_type AS colormap_id, p_size FROM part),
cmap AS (
  SELECT colormap_id, CAST(p_size AS BIGINT) AS pos,
         CAST((CASE WHEN p_size > 40 THEN p_size - 40 ELSE p_size END) * 5 * 65536 + 10 * 256 + 7 AS BIGINT) AS rgb_key,
         CAST(p_size AS DOUBLE) AS lo, CASE WHEN p_size < 15 THEN p_size + 0.5::DOUBLE WHEN p_size < 25 THEN p_size::DOUBLE ELSE p_size + 1::DOUBLE END AS hi
  FROM sizes
)"""


def part_colormap(spark, sf_dir):
    size = F.col("p_size")
    sizes = table(spark, sf_dir, "part").select(F.col("p_type").alias("colormap_id"), size).distinct()
    return sizes.select(
        "colormap_id",
        size.cast("long").alias("pos"),
        (F.when(size > 40, size - 40).otherwise(size) * 5 * 65536 + 10 * 256 + 7).cast("long").alias("rgb_key"),
        size.cast("double").alias("lo"),
        (size + F.when(size < 15, F.lit(0.5)).when(size < 25, F.lit(0.0)).otherwise(F.lit(1.0))).alias("hi"),
    )


PIXELS_SQL = """pixels AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_type AS colormap_id,
         CAST(l_quantity AS INTEGER) * 5 AS r, 10 AS g, 7 AS b, CASE WHEN l_linenumber = 7 THEN 0 ELSE 255 END AS a
  FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def pixels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("colormap_id"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "colormap_id",
        (F.col("l_quantity").cast("int") * 5).alias("r"), F.lit(10).alias("g"), F.lit(7).alias("b"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )


@query(f"""
WITH {MAP_SQL}, {PIXELS_SQL}, lut AS (
  SELECT colormap_id, rgb_key, value FROM (
    SELECT colormap_id, rgb_key, (lo + hi) / 2 AS value, row_number() OVER (PARTITION BY colormap_id, rgb_key ORDER BY lo DESC, pos DESC) AS rn FROM cmap
  ) WHERE rn = 1
)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p.colormap_id, value
FROM pixels p JOIN lut ON lut.colormap_id = p.colormap_id AND lut.rgb_key = CAST(r * 65536 + g * 256 + b AS BIGINT) WHERE a <> 0
""")
def color_invert(spark, sf_dir):
    out = cm.invert(pixels(spark, sf_dir), part_colormap(spark, sf_dir))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "colormap_id", "value")


@query(f"""
WITH RECURSIVE {MAP_SQL},
bins AS (
  SELECT colormap_id, rgb_key, lo, hi, CAST(row_number() OVER w - 1 AS INTEGER) AS k, CAST(count(*) OVER (PARTITION BY colormap_id) AS INTEGER) AS n,
         lead(lo) OVER w AS next_lo
  FROM cmap WINDOW w AS (PARTITION BY colormap_id ORDER BY lo, pos)
),
search AS (
  SELECT colormap_id, k AS gap, 0 AS lo, n - 1 AS hi FROM bins WHERE next_lo > hi
  UNION ALL
  SELECT colormap_id, gap, CASE WHEN (lo + hi) // 2 > gap THEN lo ELSE (lo + hi) // 2 + 1 END,
         CASE WHEN (lo + hi) // 2 > gap THEN (lo + hi) // 2 - 1 ELSE hi END
  FROM search WHERE lo < hi
),
ends AS (SELECT colormap_id, gap, lo AS colour_of FROM search WHERE lo >= hi),
spans AS (
  SELECT colormap_id, k AS colour_of, lo AS f, hi AS t FROM bins WHERE hi > lo
  UNION ALL
  SELECT b.colormap_id, e.colour_of, b.hi, b.next_lo FROM bins b JOIN ends e ON e.colormap_id = b.colormap_id AND e.gap = b.k
),
painted AS (SELECT s.colormap_id, f, t, rgb_key FROM spans s JOIN bins b ON b.colormap_id = s.colormap_id AND b.k = s.colour_of),
edges AS (
  SELECT colormap_id, min(lo) AS lowest, arg_max(hi, lo) AS highest, arg_min(rgb_key, lo) AS first_rgb, arg_max(rgb_key, lo) AS last_rgb
  FROM cmap GROUP BY colormap_id
),
vals AS (
  SELECT p_partkey, p_type AS colormap_id, round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) * {d(1.5)} - 10, 6) AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
)
SELECT p_partkey, v.colormap_id, value,
       CASE WHEN value <= lowest THEN first_rgb WHEN value >= highest THEN last_rgb ELSE rgb_key END AS rgb_key
FROM vals v JOIN edges e ON e.colormap_id = v.colormap_id
LEFT JOIN painted p ON p.colormap_id = v.colormap_id AND value >= f AND value < t
""")
def color_forward(spark, sf_dir):
    """Mean quantity per part, painted through the colormap of the part's type."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("q"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("colormap_id"))
    values = lines.join(parts, "p_partkey").select(
        "p_partkey", "colormap_id", rounded(F.col("q") * 1.5 - 10, 6).alias("value")
    )
    return cm.forward(values, part_colormap(spark, sf_dir))
