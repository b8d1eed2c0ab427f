"""Tile addresses and occurrence pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import pixel_x, pixel_y, tile_bounds, tile_counts, tile_x, tile_y
from ..operators import points as p
from .base import d, observations, query, with_obs

LEVELS = (0, 2, 5)


@query(
    with_obs(f""", leveled AS (SELECT event_id, lon, lat, unnest([{", ".join(map(str, LEVELS))}]) AS z FROM obs),
spans AS (SELECT *, {d(288)} / pow({d(2)}, z) AS span FROM leveled),
tiles AS (
  SELECT *, CAST(ceil({d(360)} / span) AS BIGINT) AS nx, CAST(ceil({d(180)} / span) AS BIGINT) AS ny,
    greatest(0, least(CAST(ceil({d(360)} / span) AS BIGINT) - 1, CAST(floor((lon + {d(180)}) / span) AS BIGINT))) AS x,
    greatest(0, least(CAST(ceil({d(180)} / span) AS BIGINT) - 1, CAST(floor(({d(90)} - lat) / span) AS BIGINT))) AS y
  FROM spans
)
SELECT event_id, z, x, y, nx, ny,
  CAST(greatest(0, least(511, floor((lon - ({d(-180)} + x * span)) / span * 512))) AS BIGINT) AS px,
  CAST(greatest(0, least(511, floor((({d(90)} - y * span) - lat) / span * 512))) AS BIGINT) AS py,
  {d(-180)} + x * span AS west, {d(90)} - y * span - span AS south,
  {d(-180)} + x * span + span AS east, {d(90)} - y * span AS north
FROM tiles""")
)
def tile_address(spark, sf_dir):
    obs = observations(spark, sf_dir).select("event_id", "lon", "lat", F.explode(F.array(*map(F.lit, LEVELS))).alias("z"))
    nx, ny = tile_counts("z")
    placed = obs.withColumn("x", tile_x("lon", "z")).withColumn("y", tile_y("lat", "z"))
    return placed.select(
        "event_id", "z", "x", "y", nx.alias("nx"), ny.alias("ny"),
        pixel_x("lon", "x", "z").alias("px"), pixel_y("lat", "y", "z").alias("py"),
        tile_bounds("x", "y", "z").alias("t"),
    ).select("event_id", "z", "x", "y", "nx", "ny", "px", "py", "t.*")


FINEST = 6
DENSITY_SQL = f""", finest AS (
  SELECT member, CAST(floor((lon + {d(180)}) / {d(180 / 2**FINEST)}) AS BIGINT) AS x,
         greatest(0, least({2**FINEST - 1}, CAST(floor(({d(90)} - lat) / {d(180 / 2**FINEST)}) AS BIGINT))) AS y
  FROM obs
)"""


@query(with_obs(DENSITY_SQL + f"SELECT member, {FINEST} AS z, x, y, count(*) AS n FROM finest GROUP BY ALL"))
def tile_density(spark, sf_dir):
    return p.density(observations(spark, sf_dir), FINEST, ["member"])


@query(
    with_obs(DENSITY_SQL + f"""
SELECT member, CAST(z AS INTEGER) AS z, x // CAST(pow(2, {FINEST} - z) AS BIGINT) AS x, y // CAST(pow(2, {FINEST} - z) AS BIGINT) AS y, count(*) AS n
FROM finest, (SELECT unnest(range({FINEST + 1})) AS z) GROUP BY ALL""")
)
def pyramid(spark, sf_dir):
    finest = p.density(observations(spark, sf_dir), FINEST, ["member"])
    return p.pyramid(finest, FINEST, ["member"])
