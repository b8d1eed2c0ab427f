"""Layer rules applied to observations tagged with a layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import rounded
from ..plans import layers as ly
from ..plans.joins import lookup_join
from .base import observations, query, with_obs

IDS = [row[0] for row in ly.LAYERS]
IDS_SQL = "[" + ", ".join(f"'{i}'" for i in IDS) + "]"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else repr(v)


REGISTRY_SQL = (
    "registry(id, timed, monthly, sub_daily, start, fixed_time, delta_range, aggregable, has_colormap, grid, max_level, ramp, vmin, vmax, units) AS (VALUES "
    + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in ly.LAYERS)
    + ")"
)


def layered(spark, sf_dir):
    ids = F.array(*[F.lit(i) for i in IDS])
    at = (F.col("event_id") % len(IDS)).cast("int")
    return observations(spark, sf_dir).withColumn("layer", F.get(ids, at))


@query(
    with_obs(f""", {REGISTRY_SQL}, l AS (SELECT {IDS_SQL}[event_id % {len(IDS)} + 1] AS id, v FROM obs)
SELECT id AS layer, delta_range IS NOT NULL AS can_delta, (delta_range IS NOT NULL OR aggregable) AND has_colormap AS can_window,
  CASE WHEN delta_range IS NOT NULL AND has_colormap THEN 'both' WHEN aggregable AND has_colormap THEN 'mean only' ELSE 'neither' END AS posture,
  CASE WHEN timed AND NOT ((delta_range IS NOT NULL OR aggregable) AND has_colormap) THEN 'suppressed' WHEN grid THEN 'grid'
       WHEN timed AND delta_range IS NOT NULL THEN 'delta' WHEN timed THEN 'mean' ELSE 'raw' END AS display,
  timed AND delta_range IS NULL AS not_differenced, 4 AS level_cap,
  CASE WHEN timed THEN NULL WHEN grid THEN 'climatology' ELSE 'fixed composite' END AS dateless_reason,
  count(*) AS n, round(avg(CASE WHEN timed AND (delta_range IS NOT NULL OR aggregable) THEN v END), 9) AS mean
FROM l JOIN registry USING (id) GROUP BY ALL""")
)
def layer_posture(spark, sf_dir):
    """What each layer shows in difference mode under a 30-day window, with its mean where one is allowed."""
    rules = ly.with_date_rule(ly.with_posture(ly.layer_table(spark), 30, comparing=True, mode="delta"))
    rules = rules.withColumnRenamed("id", "layer").select(
        "layer", "timed", "can_delta", "can_window", "posture", "display", "not_differenced", "level_cap", "dateless_reason"
    )
    stats = layered(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    out = lookup_join(stats, rules, ["layer"], "inner", bound=len(IDS))
    allowed = F.col("timed") & F.col("can_window")
    return out.withColumn("mean", F.when(allowed, rounded("mean", 9))).drop("timed")


@query(
    with_obs(f""", {REGISTRY_SQL}, l AS (SELECT {IDS_SQL}[event_id % {len(IDS)} + 1] AS id, day, v FROM obs)
SELECT id AS layer, count(*) AS n, count(v) AS observed, min(day) AS first_day
FROM l JOIN registry USING (id) WHERE start IS NULL OR day >= CAST(start AS DATE) GROUP BY id""")
)
def within_record(spark, sf_dir):
    kept = ly.within_record(layered(spark, sf_dir), ly.layer_table(spark))
    return kept.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("observed"), F.min("day").alias("first_day")
    )
