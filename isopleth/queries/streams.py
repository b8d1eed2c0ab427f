"""Streams over the events file, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import utc, utc_date
from ..functions.missing import rounded
from ..session import scratch_path
from ..streaming.cells import CellTable, cell_means
from ..streaming.latest import LatestTable
from .base import observed, query, table, with_obs
from .grids import COARSE, cells_sql


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return observed(events)


@query(
    with_obs("""SELECT platform, ts, event_id, lon, lat FROM obs
QUALIFY row_number() OVER (PARTITION BY platform ORDER BY ts DESC, event_id) = 1""")
)
def stream_latest(spark, sf_dir):
    path = scratch_path(spark, "latest")
    latest = LatestTable(f"{path}/table", ("platform",), "ts", "event_id", ("lon", "lat"))
    return latest.run(event_stream(spark, sf_dir), f"{path}/checkpoint")


@query(
    with_obs(f""", placed AS ({cells_sql(COARSE, keys="ts")})
SELECT CAST(ts AS DATE) AS day, ix, iy, round(avg(v), 9) AS value, count(*) AS n FROM placed GROUP BY ALL""")
)
def stream_cells(spark, sf_dir):
    """Every window, also those the watermark hasn't closed when the input ends."""
    path = scratch_path(spark, "cells")
    stream = event_stream(spark, sf_dir).withColumn("at", utc("ts"))
    means = cell_means(stream, COARSE, "at", "v", "1 day", "1 hour")
    cells = CellTable(f"{path}/table", "1 hour").run(means, f"{path}/checkpoint")
    return cells.select(
        utc_date("window.start").alias("day"), "ix", "iy", rounded("value", 9).alias("value"), "n"
    )
