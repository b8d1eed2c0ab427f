"""Ensembles of products on shared pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.missing import rounded
from ..operators import ensemble as en
from ..operators import grid as g
from .base import d, observations, query, with_obs
from .grids import COARSE, FINE, cells_sql, ramp_sql
from .rolling import OBS_PIXELS, PIXEL, SIZE, pixel_sql, pixelled

# One day has few observations, so its pixels are larger.
DAILY_SIZE = 4

MEMBERS = ["signup", "click", "view", "error", "purchase"]

ENSEMBLE_SQL = f""", {OBS_PIXELS},
per AS (SELECT x, y, px, py, member, avg(v) AS m FROM pixels WHERE v IS NOT NULL GROUP BY ALL),
ens AS (
  SELECT x, y, px, py, avg(m) AS mean, stddev_pop(m) AS spread, count(*) AS n_members
  FROM per GROUP BY x, y, px, py HAVING count(*) >= 2
)"""


def _ensemble(spark, sf_dir, extra=(), size=SIZE):
    obs = pixelled(observations(spark, sf_dir), size=size, known=True)
    return en.ensemble(obs, [*extra, *PIXEL], MEMBERS, "v")


@query(with_obs(ENSEMBLE_SQL + "SELECT x, y, px, py, round(mean, 9) AS mean, n_members FROM ens"))
def ensemble_mean(spark, sf_dir):
    return _ensemble(spark, sf_dir).select(*PIXEL, rounded("mean", 9).alias("mean"), "n_members")


def spread_sql(s: str) -> str:
    t = f"greatest({d(0)}, least({d(1)}, {s} / {d(colour.SPREAD_MAX)}))"
    shown = f"{s} > {d(colour.SPREAD_MIN)}"
    channels = ", ".join(
        f"CASE WHEN {shown} THEN {ramp_sql(colour.SPREAD_STOPS, t, k)} ELSE 0 END AS {n}"
        for k, n in ((1, "r"), (2, "g"), (3, "b"))
    )
    alpha = f"CASE WHEN {shown} THEN CAST(floor(({d(0.35)} + {d(0.6)} * {t}) * 255 + {d(0.5)}) AS INTEGER) ELSE 0 END AS a"
    return f"{channels}, {alpha}"


@query(
    with_obs(ENSEMBLE_SQL + f""", s AS (SELECT x, y, px, py, n_members, round(spread, 6) AS spread, round(spread, 6) / 40 AS scaled FROM ens)
SELECT x, y, px, py, n_members, spread, {spread_sql("scaled")} FROM s""")
)
def ensemble_spread(spark, sf_dir):
    out = _ensemble(spark, sf_dir).select(*PIXEL, "n_members", rounded("spread", 6).alias("spread"))
    painted = out.withColumn("c", colour.spread_colour(F.col("spread") / 40))
    return painted.select(*PIXEL, "n_members", "spread", "c.*")


@query(
    with_obs(f""", {pixel_sql("obs", "pixels", "day, member, v", DAILY_SIZE)},
per AS (SELECT day, x, y, px, py, member, avg(v) AS m FROM pixels WHERE v IS NOT NULL GROUP BY ALL)
SELECT day, x, y, px, py, round(avg(m), 9) AS mean, round(stddev_pop(m), 6) AS spread, count(*) AS n_members
FROM per GROUP BY day, x, y, px, py HAVING count(*) >= 2""")
)
def ensemble_daily(spark, sf_dir):
    """The single-date ensemble, for every date at once."""
    out = _ensemble(spark, sf_dir, ("day",), DAILY_SIZE)
    return out.select(
        "day", *PIXEL, rounded("mean", 9).alias("mean"), rounded("spread", 6).alias("spread"), "n_members"
    )


def _member_cells(spark, sf_dir):
    obs = observations(spark, sf_dir)
    fine = g.bin_mean(obs.filter(F.col("member") == "view"), FINE, "v").drop("n")
    coarse = g.bin_mean(obs.filter(F.col("member") != "view"), COARSE, "v").drop("n")
    return fine, coarse


MEMBER_CELLS_SQL = f""", fine_pts AS ({cells_sql(FINE, source="(SELECT * FROM obs WHERE member = 'view')")}),
fine AS (SELECT ix, iy, avg(v) AS value FROM fine_pts GROUP BY ix, iy),
coarse_pts AS ({cells_sql(COARSE, source="(SELECT * FROM obs WHERE member <> 'view')")}),
coarse AS (SELECT ix, iy, avg(v) AS value FROM coarse_pts GROUP BY ix, iy),
lifted AS (
  SELECT CAST(floor(({d(FINE.west)} + (ix + {d(0.5)}) * {d(FINE.dlon)} - {d(COARSE.west)}) / {d(COARSE.dlon)}) AS BIGINT) AS ix,
         CAST(floor(({d(FINE.south)} + (iy + {d(0.5)}) * {d(FINE.dlat)} - {d(COARSE.south)}) / {d(COARSE.dlat)}) AS BIGINT) AS iy, value
  FROM fine
), up AS (SELECT ix, iy, avg(value) AS value FROM lifted GROUP BY ix, iy)"""


@query(
    with_obs(MEMBER_CELLS_SQL + """
SELECT ix, iy, round((u.value + c.value) / 2, 9) AS mean, round(abs(u.value - c.value) / 2, 6) AS spread, CAST(2 AS BIGINT) AS n_members
FROM up u JOIN coarse c USING (ix, iy)""")
)
def regrid_ensemble(spark, sf_dir):
    fine, coarse = _member_cells(spark, sf_dir)
    out = en.ensemble_on_common_grid({"fine": (fine, FINE), "coarse": (coarse, COARSE)}, COARSE)
    return out.select("ix", "iy", rounded("mean", 9).alias("mean"), rounded("spread", 6).alias("spread"), "n_members")


@query(
    with_obs(MEMBER_CELLS_SQL + """
SELECT count(*) AS cells, round(avg(u.value - c.value), 6) AS bias, round(sqrt(avg((u.value - c.value) * (u.value - c.value))), 6) AS rmse
FROM up u JOIN coarse c USING (ix, iy)""")
)
def nested_products(spark, sf_dir):
    fine, coarse = _member_cells(spark, sf_dir)
    out = en.bias_rmse(en.compare_products(fine, FINE, coarse, COARSE))
    return out.select("cells", rounded("bias", 6).alias("bias"), rounded("rmse", 6).alias("rmse"))
