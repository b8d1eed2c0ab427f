"""Layer views over line items read as tile pixels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.dates import compare_date_value, sample_date_values
from ..functions.missing import rounded
from ..operators import raster
from ..plans import layers as ly
from .base import d, query, table
from .rolling import dates_sql, delta_class_sql

SHOWN = ("sst", "aod", "precip", "seaice")
END = dt.date(1999, 6, 15)
NOW = sample_date_values(END, 60)
PAST = sample_date_values(compare_date_value(END, 1), 60)

PIXELS_SQL = f"""pixels AS (
  SELECT [{", ".join(f"'{x}'" for x in SHOWN)}][l_suppkey % 4 + 1] AS layer, CAST(l_shipdate AS DATE) AS date, l_suppkey % 20 AS x,
         CAST(l_linenumber AS BIGINT) AS px, CAST(l_quantity AS INTEGER) AS i, l_linenumber <> 7 AS opaque
  FROM lineitem
), cmap AS (SELECT DISTINCT p_size AS i, p_size + {d(0.5)} AS v FROM part),
valued AS (
  SELECT layer, x, px, date IN ({dates_sql(NOW)}) AS now, date IN ({dates_sql(PAST)}) AS past, v
  FROM pixels JOIN cmap USING (i) WHERE opaque
)"""


def tile_pixels(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in SHOWN])
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.get(names, (F.col("l_suppkey") % 4).cast("int")).alias("layer"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.lit(3).alias("z"), (F.col("l_suppkey") % 20).alias("x"), zero.alias("y"),
        F.col("l_linenumber").cast("long").alias("px"), zero.alias("py"),
        (F.col("l_quantity").cast("int") * 5).alias("r"), F.lit(10).alias("g"), F.lit(7).alias("b"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )


def size_colormaps(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(size).distinct().select(
        F.explode(F.array(*[F.lit(x) for x in SHOWN])).alias("colormap_id"), size.cast("long").alias("pos"),
        (size * 5 * 65536 + 10 * 256 + 7).cast("long").alias("rgb_key"),
        size.cast("double").alias("lo"), (size + 1).cast("double").alias("hi"),
    )


def _delta_sql(layer: str, scale: float) -> str:
    return f"""SELECT layer, 'delta' AS display, 'change' AS side, x, px, n, value, r, g, b, a FROM (
  SELECT *, {delta_class_sql("value", scale)} FROM (
    SELECT layer, x, px, least(count(CASE WHEN now THEN 1 END), count(CASE WHEN past THEN 1 END)) AS n,
           round(avg(CASE WHEN now THEN v END) - avg(CASE WHEN past THEN v END), 9) AS value
    FROM valued WHERE layer = '{layer}' GROUP BY layer, x, px) WHERE value IS NOT NULL)"""


@query(f"""
WITH {PIXELS_SQL}, means AS (
  SELECT layer, x, px, count(*) AS n, round(avg(v), 9) AS value FROM valued WHERE layer = 'aod' AND now GROUP BY layer, x, px
)
{_delta_sql("sst", 4.0)} UNION ALL {_delta_sql("seaice", 50.0)}
UNION ALL SELECT layer, 'mean', 'now', x, px, n, value, CAST(floor(value) AS INTEGER) * 5, 10, 7, {colour.MEAN_ALPHA} FROM means
""")
def layer_view(spark, sf_dir):
    """Four layers under a 60-day window in difference mode: two differ, one averages, one is hidden."""
    out = raster.view(
        tile_pixels(spark, sf_dir), size_colormaps(spark, sf_dir), ly.layer_table(spark), END, 60, 1, "delta",
        latest=dt.date(2001, 1, 1),
    )
    return out.select("layer", "display", "side", "x", "px", "n", rounded("value", 9).alias("value"), "r", "g", "b", "a")


TILED = tuple(row[0] for row in ly.LAYERS if not row[9])
MEAN_LAYERS = tuple(row[0] for row in ly.LAYERS if row[8] and (row[6] is not None or row[7]))
MAPPED = tuple(row[0] for row in ly.LAYERS if row[8])
FIXED = dt.date(2016, 1, 1)
LATEST = dt.date(2001, 1, 1)
SPLIT_DAYS = 20


def names_sql(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


# Pixels of all layers, on the days up to END and the same days a year before.
ALL_PIXELS_SQL = f"""tiles AS (
  SELECT [{names_sql(TILED)}][l_suppkey % {len(TILED)} + 1] AS layer, l_suppkey % 20 AS x, CAST(l_linenumber AS BIGINT) AS px,
         CAST(l_quantity AS INTEGER) AS i, l_linenumber <> 7 AS opaque, l_orderkey % 2 AS years, CAST(l_partkey % 20 AS INTEGER) AS back
  FROM lineitem
), pixels AS (
  SELECT layer, x, px, i, opaque, CASE WHEN layer = 'nightlights' THEN DATE '{FIXED}'
    ELSE (CASE WHEN years = 0 THEN DATE '{END}' ELSE DATE '{compare_date_value(END, 1)}' END) - back END AS date
  FROM tiles
), cmap AS (SELECT DISTINCT p_size AS i, p_size + {d(0.5)} AS v FROM part WHERE p_size % 7 <> 0)"""


def all_pixels(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in TILED])
    layer = F.get(names, (F.col("l_suppkey") % len(TILED)).cast("int"))
    zero = F.lit(0).cast("long")
    at = F.when(F.col("l_orderkey") % 2 == 0, F.lit(END)).otherwise(F.lit(compare_date_value(END, 1)))
    day = F.date_sub(at, (F.col("l_partkey") % 20).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        layer.alias("layer"),
        F.when(layer == "nightlights", F.lit(FIXED)).otherwise(day).alias("date"),
        F.lit(3).alias("z"), (F.col("l_suppkey") % 20).alias("x"), zero.alias("y"),
        F.col("l_linenumber").cast("long").alias("px"), zero.alias("py"),
        (F.col("l_quantity").cast("int") * 5).alias("r"), F.lit(10).alias("g"), F.lit(7).alias("b"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )


def all_colormaps(spark, sf_dir):
    """Colours of every seventh size are in no table."""
    maps = size_colormaps(spark, sf_dir).filter((F.col("colormap_id") == SHOWN[0]) & (F.col("pos") % 7 != 0))
    return maps.withColumn("colormap_id", F.explode(F.array(*[F.lit(x) for x in MAPPED])))


DAY_SQL = f"""CASE layer WHEN 'nightlights' THEN DATE '{FIXED}' WHEN 'salinity' THEN DATE '{END.replace(day=1)}' ELSE DATE '{END}' END"""


@query(f"""
WITH {ALL_PIXELS_SQL}
SELECT layer, 'raw' AS display, 'now' AS side, x, px, CAST(1 AS BIGINT) AS n,
       CASE WHEN layer IN ({names_sql(MAPPED)}) THEN v END AS value, i * 5 AS r, 10 AS g, 7 AS b, 255 AS a
FROM pixels LEFT JOIN cmap USING (i) WHERE opaque AND date = {DAY_SQL}
""")
def layer_view_day(spark, sf_dir):
    """All tiled layers on one day: true colour and fixed composites too, in their own colours."""
    out = raster.view(all_pixels(spark, sf_dir), all_colormaps(spark, sf_dir), ly.layer_table(spark), END, latest=LATEST)
    return out.select("layer", "display", "side", "x", "px", "n", "value", "r", "g", "b", "a")


def _split_sql(side: str, at: dt.date) -> str:
    daily, monthly = (sample_date_values(at, SPLIT_DAYS, None, m, LATEST) for m in (False, True))
    return f"""SELECT layer, 'mean' AS display, '{side}' AS side, x, px, count(*) AS n, round(avg(v), 9) AS value, {colour.MEAN_ALPHA} AS a
FROM pixels JOIN cmap USING (i)
WHERE opaque AND layer IN ({names_sql(MEAN_LAYERS)})
  AND CASE WHEN layer = 'salinity' THEN date IN ({dates_sql(monthly)}) ELSE date IN ({dates_sql(daily)}) END
GROUP BY layer, x, px"""


@query(f"""
WITH {ALL_PIXELS_SQL}
{_split_sql("now", END)} UNION ALL {_split_sql("past", compare_date_value(END, 1))}
UNION ALL SELECT layer, 'raw', 'now', x, px, 1, NULL, 255 FROM pixels WHERE layer = 'nightlights' AND opaque
""")
def layer_view_split(spark, sf_dir):
    """Window means side by side with the year before; composites stay, instants are hidden."""
    out = raster.view(
        all_pixels(spark, sf_dir), all_colormaps(spark, sf_dir), ly.layer_table(spark), END, SPLIT_DAYS, 1, "split", latest=LATEST
    )
    return out.select("layer", "display", "side", "x", "px", "n", rounded("value", 9).alias("value"), "a")


MEMBERS = ("a", "b", "c")


@query(f"""
WITH p AS (SELECT [{names_sql(MEMBERS)}][l_partkey % 3 + 1] AS member, l_suppkey % 20 AS x, CAST(l_linenumber AS BIGINT) AS px, CAST(l_quantity AS INTEGER) AS i FROM lineitem WHERE l_linenumber <> 7),
m AS (SELECT x, px, member, avg(p_size + {d(0.5)}) AS v FROM p JOIN (SELECT DISTINCT p_size FROM part WHERE p_size % 7 <> 0) ON p_size = i GROUP BY ALL),
e AS (SELECT x, px, count(*) AS n_members, avg(v) AS mean, stddev_pop(v) AS spread FROM m GROUP BY x, px HAVING count(*) >= 2)
SELECT 'mean' AS mode, x, px, n_members, round(mean, 9) AS value FROM e
UNION ALL SELECT 'spread', x, px, n_members, round(spread, 9) FROM e
""")
def ensemble_view(spark, sf_dir):
    """Mean and spread of three products read as tiles of one day."""
    zero = F.lit(0).cast("long")
    px = table(spark, sf_dir, "lineitem").select(
        F.get(F.array(*[F.lit(x) for x in MEMBERS]), (F.col("l_partkey") % 3).cast("int")).alias("layer"), F.lit(END).alias("date"),
        F.lit(3).alias("z"), (F.col("l_suppkey") % 20).alias("x"), zero.alias("y"),
        F.col("l_linenumber").cast("long").alias("px"), zero.alias("py"),
        (F.col("l_quantity").cast("int") * 5).alias("r"), F.lit(10).alias("g"), F.lit(7).alias("b"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )
    one = all_colormaps(spark, sf_dir).filter(F.col("colormap_id") == MAPPED[0])
    views = [raster.ensemble_view(px, one, list(MEMBERS), END, mode).withColumn("mode", F.lit(mode)) for mode in ("mean", "spread")]
    pick = [v.select("mode", "x", "px", "n_members", rounded("value", 9).alias("value")) for v in views]
    return pick[0].unionByName(pick[1])
