"""Gridding: binning, dense grids, coarsening, climatologies, sampling, painting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.geo import Grid
from ..functions.missing import rounded
from ..operators import grid as g
from .base import d, observations, query, table, with_obs

COARSE = Grid(-180.0, -90.0, 180.0, 90.0, 72, 36)
FINE = Grid(-180.0, -90.0, 180.0, 90.0, 144, 72)
REGION = Grid(-40.375, 25.375, 75.375, 75.375, 463, 200)


def cells_sql(grid: Grid, keys: str = "", source: str = "obs", value: str = "v") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""
  SELECT {lead}CAST(floor((lon - {d(grid.west)}) / {d(grid.dlon)}) AS BIGINT) AS ix,
         CAST(floor((lat - {d(grid.south)}) / {d(grid.dlat)}) AS BIGINT) AS iy, {value}
  FROM {source}
  WHERE {value} IS NOT NULL AND lon >= {d(grid.west)} AND lon < {d(grid.east)}
    AND lat >= {d(grid.south)} AND lat < {d(grid.north)}
"""


@query(
    with_obs(f""", placed AS ({cells_sql(FINE)})
SELECT ix, iy, round(avg(v), 9) AS value, count(*) AS n FROM placed GROUP BY ix, iy""")
)
def grid_bin_mean(spark, sf_dir):
    cells = g.bin_mean(observations(spark, sf_dir), FINE, "v")
    return cells.select("ix", "iy", rounded("value", 9).alias("value"), "n")


@query(
    with_obs(f""", placed AS ({cells_sql(REGION)})
SELECT ix, iy, round(avg(v), 9) AS value, count(*) AS n FROM placed
WHERE ix BETWEEN 0 AND {REGION.nx - 1} AND iy BETWEEN 0 AND {REGION.ny - 1} GROUP BY ix, iy""")
)
def grid_bin_region(spark, sf_dir):
    cells = g.bin_mean(observations(spark, sf_dir), REGION, "v", wrapped=True)
    return cells.select("ix", "iy", rounded("value", 9).alias("value"), "n")


DENSE_SQL = f""", placed AS ({cells_sql(FINE)}),
cells AS (SELECT iy * {FINE.nx} + ix AS pos, avg(v) AS value FROM placed GROUP BY ix, iy),
dense AS (
  SELECT s.pos, CAST(s.pos % {FINE.nx} AS BIGINT) AS ix, CAST(s.pos // {FINE.nx} AS BIGINT) AS iy,
         round(c.value, 6) AS value
  FROM (SELECT CAST(range AS BIGINT) AS pos FROM range({FINE.cells})) s LEFT JOIN cells c USING (pos)
)"""


@query(with_obs(DENSE_SQL + "SELECT pos, ix, iy, value FROM dense"))
def grid_dense(spark, sf_dir):
    return g.densify(g.bin_mean(observations(spark, sf_dir), FINE, "v"), FINE, decimals=6)


@query(
    with_obs(DENSE_SQL + """
SELECT count(*) AS cells, count(value) AS filled, min(value) AS vmin, max(value) AS vmax FROM dense""")
)
def grid_coverage(spark, sf_dir):
    return g.grid_summary(grid_dense(spark, sf_dir))


COARSEN_SQL = f""", placed AS ({cells_sql(FINE)}),
cells AS (SELECT ix, iy, avg(v) AS value FROM placed GROUP BY ix, iy),
centred AS (
  SELECT {d(FINE.west)} + (ix + {d(0.5)}) * {d(FINE.dlon)} AS lon,
         {d(FINE.south)} + (iy + {d(0.5)}) * {d(FINE.dlat)} AS lat, value FROM cells
),
coarse AS (
  SELECT CAST(floor((lon - {d(COARSE.west)}) / {d(COARSE.dlon)}) AS BIGINT) AS ix,
         CAST(floor((lat - {d(COARSE.south)}) / {d(COARSE.dlat)}) AS BIGINT) AS iy,
         value, cos(radians(lat)) AS w FROM centred
)"""


@query(with_obs(COARSEN_SQL + "SELECT ix, iy, round(avg(value), 9) AS value, count(*) AS n FROM coarse GROUP BY ix, iy"))
def grid_coarsen(spark, sf_dir):
    fine = g.bin_mean(observations(spark, sf_dir), FINE, "v").drop("n")
    out = g.coarsen(fine, FINE, COARSE)
    return out.select("ix", "iy", rounded("value", 9).alias("value"), "n")


@query(
    with_obs(COARSEN_SQL + """
SELECT ix, iy, round(sum(value * w) / sum(w), 9) AS value, count(*) AS n FROM coarse GROUP BY ix, iy""")
)
def grid_coarsen_area(spark, sf_dir):
    fine = g.bin_mean(observations(spark, sf_dir), FINE, "v").drop("n")
    out = g.coarsen(fine, FINE, COARSE, area_weighted=True)
    return out.select("ix", "iy", rounded("value", 9).alias("value"), "n")


@query("""
SELECT CAST(o_custkey % 500 AS BIGINT) AS cell, CAST(month(o_orderdate) AS INTEGER) AS month,
       round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) * CAST(365.25 AS DOUBLE) / 100, 6) AS clim,
       count(*) AS n
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2
""")
def climatology(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 500).alias("cell"),
        F.month("o_orderdate").alias("month"),
        F.round(F.col("o_totalprice") * 100).alias("cents"),
    )
    out = g.climatology(orders, ["cell", "month"], "cents")
    return out.select("cell", "month", rounded(F.col("clim") / 100, 6).alias("clim"), "n")


PROBE_POINTS = """probes AS (
  SELECT c_custkey, CAST((c_custkey * 6007) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
         CAST((c_custkey * 3571) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat
  FROM customer
)"""


def probe_points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k,
        (((k * 6007) % 36000).cast("double") / F.lit(100.0) - 180.0).alias("lon"),
        (((k * 3571) % 18000).cast("double") / F.lit(100.0) - 90.0).alias("lat"),
    )


@query(
    with_obs(f""", {PROBE_POINTS}, placed AS ({cells_sql(REGION)}),
cells AS (SELECT ix, iy, avg(v) AS value FROM placed
          WHERE ix BETWEEN 0 AND {REGION.nx - 1} AND iy BETWEEN 0 AND {REGION.ny - 1} GROUP BY ix, iy),
located AS (
  SELECT c_custkey, lon, lat,
    CASE WHEN inside THEN CAST(floor((lon - {d(REGION.west)}) / {d(REGION.dlon)}) AS BIGINT) END AS ix,
    CASE WHEN inside THEN CAST(floor((lat - {d(REGION.south)}) / {d(REGION.dlat)}) AS BIGINT) END AS iy
  FROM (SELECT *, lon >= {d(REGION.west)} AND lon < {d(REGION.east)}
               AND lat >= {d(REGION.south)} AND lat < {d(REGION.north)} AS inside FROM probes)
)
SELECT c_custkey, l.ix, l.iy, round(value, 9) AS sampled FROM located l LEFT JOIN cells c ON c.ix = l.ix AND c.iy = l.iy""")
)
def grid_sample(spark, sf_dir):
    cells = g.bin_mean(observations(spark, sf_dir), REGION, "v", wrapped=True)
    out = g.sample(probe_points(spark, sf_dir), cells, REGION)
    return out.select("c_custkey", "ix", "iy", rounded("sampled", 9).alias("sampled"))


EMB = Grid(-180.0, -90.0, 180.0, 90.0, 8, 8)


def embedding_cells(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").alias("grid_id"), F.posexplode("embedding").alias("pos", "value"))
    return flat.filter(F.col("value").isNotNull()).select(
        "grid_id",
        (F.col("pos") % 8).cast("long").alias("ix"),
        F.floor(F.col("pos") / 8).cast("long").alias("iy"),
        F.col("value").cast("double").alias("value"),
    )


EMB_CELLS = """cells AS (
  SELECT vec_id AS grid_id, CAST((pos - 1) % 8 AS BIGINT) AS ix, CAST((pos - 1) // 8 AS BIGINT) AS iy, CAST(value AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  WHERE value IS NOT NULL
)"""


@query(f"""
WITH {EMB_CELLS}, pixels AS (
  SELECT tx.range AS x, ty.range AS y, i.range AS px, j.range AS py,
         {d(-180)} + tx.range * {d(180)} + (i.range + {d(0.5)}) / {d(8)} * {d(180)} AS lon,
         {d(90)} - (j.range + {d(0.5)}) / {d(8)} * {d(180)} AS lat
  FROM range(2) tx, range(1) ty, range(8) i, range(8) j
)
SELECT grid_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, value
FROM pixels JOIN cells
  ON cells.ix = CAST(floor((lon + {d(180)}) / {d(45)}) AS BIGINT) AND cells.iy = CAST(floor((lat + {d(90)}) / {d(22.5)}) AS BIGINT)
""")
def tile_resample(spark, sf_dir):
    cells = embedding_cells(spark, sf_dir)
    return g.paint_tiles(cells, EMB, z=0, size=8, keys=("grid_id",))


def ramp_sql(stops, t: str, k: int) -> str:
    arms = []
    for left, right in zip(stops, stops[1:]):
        share = f"({t} - {d(left[0])}) / {d(float(right[0]) - float(left[0]))}"
        arms.append(f"WHEN {t} <= {d(right[0])} THEN floor({d(left[k])} + {share} * {d(right[k] - left[k])} + {d(0.5)})")
    return "CAST(CASE " + " ".join(arms) + f" ELSE {stops[-1][k]} END AS INTEGER)"


@query(
    with_obs(f""", placed AS ({cells_sql(COARSE)}),
cells AS (SELECT ix, iy, round(avg(v), 6) AS value FROM placed GROUP BY ix, iy),
scaled AS (SELECT ix, iy, value, greatest({d(0)}, least({d(1)}, (value - {d(0)}) / {d(300)})) AS t FROM cells)
SELECT ix, iy, value, {ramp_sql(colour.RAMPS["precip"], "t", 1)} AS r, {ramp_sql(colour.RAMPS["precip"], "t", 2)} AS g,
       {ramp_sql(colour.RAMPS["precip"], "t", 3)} AS b, {colour.GRID_ALPHA} AS a FROM scaled""")
)
def grid_painted(spark, sf_dir):
    cells = g.bin_mean(observations(spark, sf_dir), COARSE, "v").withColumn("value", rounded("value", 6))
    return g.ramp_painted(cells.drop("n"), "precip", 0, 300).select("ix", "iy", "value", "rgba.*")
