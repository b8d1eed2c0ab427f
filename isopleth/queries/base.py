"""Query registry and the observation view both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql.strip()
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(table(spark, sf_dir, "events"))


def observed(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as observations with coordinates and missing values."""
    i = F.col("event_id")
    return events.select(
        i,
        "ts",
        F.col("user_id").alias("platform"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_type").alias("member"),
        (((i * 7919) % 36000).cast("double") / F.lit(100.0) - 180.0).alias("lon"),
        (((i * 104729) % 18000).cast("double") / F.lit(100.0) - 90.0).alias("lat"),
        F.when(i % 7 != 3, F.col("value")).alias("v"),
    )


OBS = """
obs AS (
  SELECT event_id, ts, user_id AS platform, CAST(ts AS DATE) AS day, event_type AS member,
         CAST((event_id * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
         CAST((event_id * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat,
         CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS v
  FROM events
)
"""


def with_obs(body: str) -> str:
    return f"WITH {OBS.strip()}{body}"


def d(x) -> str:
    """A DOUBLE literal in SQL; a bare decimal would be a DECIMAL there."""
    return f"CAST({float(x)!r} AS DOUBLE)"
