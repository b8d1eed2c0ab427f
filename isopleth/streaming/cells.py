"""Tumbling-window cell means with a watermark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import utc_date
from ..functions.geo import Grid
from ..operators import grid as g
from ..session import exists, folders
from .segments import SegmentLog

DAY = 86_400_000_000
_CLOSED = re.compile(r"upto=(-?\d+)$")


def cell_means(
    stream: DataFrame, grid: Grid, time: str, value: str, width: str, late: str, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Mean per window and cell; rows later than ``late`` behind the newest are dropped.

    ``time`` is a timestamp. State holds one row per open window and cell.
    """
    timed = stream.withWatermark(time, late).withColumn("window", F.window(time, width))
    return g.bin_mean(timed, grid, value, lon, lat, keys=("window",))


def write_closed(stream: DataFrame, path: str, checkpoint: str):
    """Append windows to Parquet once the watermark has closed them; runs to the end of
    the available input. Files and offsets commit together, so a restart neither
    loses nor repeats a window."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _end() -> Column:
    return F.unix_micros("window.end")


@dataclass(frozen=True)
class CellTable:
    """All windows seen so far, those still open included.

    Each micro-batch writes the cells it changed to a ``SegmentLog``. Once the watermark has
    passed the end of a day, the windows that end in it can't change any more: they are moved
    into a partition of that day, for good, and the log keeps the open ones only. So there
    are as many folders as days and open segments, and a closed day is written once.

    ``late`` is the delay given to ``cell_means``. One table belongs to one checkpoint: both
    start empty.
    """

    path: str
    late: str
    fan: int = 8

    @property
    def _log(self) -> SegmentLog:
        def newest(df: DataFrame) -> DataFrame:
            row = F.max_by(F.struct("value", "n", "batch"), "batch").alias("_row")
            return df.groupBy("window", "ix", "iy").agg(row).select("window", "ix", "iy", "_row.*")

        return SegmentLog(f"{self.path}/open", newest, self.fan)

    def _closed(self, spark: SparkSession) -> list[int]:
        """The ends, in microseconds, up to which windows have been moved."""
        found = [int(m[1]) for name in folders(spark, f"{self.path}/closed") if (m := _CLOSED.search(name))]
        return sorted(e for e in found if exists(spark, f"{self.path}/closed/upto={e}/_SUCCESS"))

    def _passed(self, spark: SparkSession, batch: int) -> int | None:
        """The last midnight that the watermark had passed after ``batch``.

        The newest row of a batch is not older than the start of its newest window, so the
        watermark is not behind that start less the delay.
        """
        if (batch, batch) not in self._log.complete(spark):
            return None
        start = F.max("window.start") - F.expr(f"INTERVAL '{self.late}'")
        return self._log.read(spark, [(batch, batch)]).agg(F.unix_micros(start) - F.pmod(F.unix_micros(start), F.lit(DAY))).first()[0]

    def _move(self, spark: SparkSession, upto: int, batch: int) -> None:
        """Windows that end by ``upto`` go to their days; the log goes on with the others."""
        since = (self._closed(spark) or [None])[-1]
        log = self._log
        ripe = log.rows(spark, batch).filter(_end() <= upto)
        if since is not None:
            ripe = ripe.filter(_end() > since)
        if ripe.isEmpty():
            return
        last_instant = F.timestamp_micros(_end() - 1)
        days = ripe.withColumn("day", utc_date(last_instant)).repartitionByRange("day", "ix", "iy")
        days.drop("batch").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/closed/upto={upto}")
        log.merge(spark, 0, batch, lambda df: df.filter(_end() > upto))

    def merge(self, changed: DataFrame, batch: int) -> None:
        """For ``foreachBatch`` in update mode."""
        spark, log = changed.sparkSession, self._log
        # The batch before is committed: what it had passed stays passed.
        passed, closed = self._passed(spark, batch - 1), self._closed(spark)
        if passed is not None and (not closed or passed > closed[-1]):
            self._move(spark, passed, batch - 1)
        log.clean(spark, batch)
        log.write(changed.withColumn("batch", F.lit(batch).cast("long")), batch)

    def run(self, means: DataFrame, checkpoint: str) -> DataFrame:
        """Take in everything available now and return all windows."""
        query = (
            means.writeStream.outputMode("update")
            .foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.current(means.sparkSession)

    def current(self, spark: SparkSession) -> DataFrame:
        opened = self._log.rows(spark).select("window", "ix", "iy", "value", "n")
        closed = self._closed(spark)
        if not closed:
            return opened
        # A day without windows has no file to read the columns from.
        reader = spark.read.schema(opened.schema).option("basePath", f"{self.path}/closed")
        days = reader.parquet(*[f"{self.path}/closed/upto={e}" for e in closed]).select(*opened.columns)
        return days.unionByName(opened.filter(_end() > closed[-1]))
