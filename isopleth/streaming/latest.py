"""Newest position per platform, kept up to date by a stream."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.points import latest_per_key
from ..session import discard, exists, folders
from .segments import SegmentLog

_GENERATION = re.compile(r"generation=(\d+)$")


@dataclass(frozen=True)
class LatestTable:
    """A table of newest rows per key.

    The newest rows are the state of a streaming aggregation, so a batch writes the keys it
    touched and no others; ``SegmentLog`` merges what the batches wrote. Rows are compared by
    time and tie, not by batch, so a replayed batch or one written twice changes nothing.

    A new checkpoint knows nothing of the table's keys: the table then starts a new
    generation, whose base holds the rows of the one before.
    """

    path: str
    keys: tuple[str, ...]
    time: str
    tiebreak: str
    keep: tuple[str, ...]
    fan: int = 8

    def _newest(self, df: DataFrame) -> DataFrame:
        kept = [c for c in self.keep if c != self.tiebreak]
        return latest_per_key(df, list(self.keys), self.time, self.tiebreak, [self.tiebreak, *kept])

    def _log(self, generation: int) -> SegmentLog:
        return SegmentLog(f"{self.path}/generation={generation}", self._newest, self.fan)

    def _base(self, generation: int) -> str:
        return f"{self.path}/generation={generation}/base"

    def _generation(self, spark: SparkSession) -> int | None:
        """The newest generation that has its base; the first one needs none."""
        found = sorted(int(m[1]) for name in folders(spark, self.path) if (m := _GENERATION.search(name)))
        ready = [g for g in found if g == 0 or exists(spark, f"{self._base(g)}/_SUCCESS")]
        return ready[-1] if ready else None

    def _started(self, spark: SparkSession) -> int:
        """The generation for a new checkpoint. Older ones go once its base is complete."""
        last = self._generation(spark)
        if last is None:
            return 0
        rows = self.current(spark)
        if rows is None:
            return last
        rows.write.mode("overwrite").parquet(self._base(last + 1))
        for generation in range(last + 1):
            discard(spark, f"{self.path}/generation={generation}")
        return last + 1

    def merge(self, changed: DataFrame, batch: int, generation: int | None = None) -> None:
        """For ``foreachBatch``: newest rows of the keys that a batch touched."""
        spark = changed.sparkSession
        log = self._log(self._generation(spark) or 0 if generation is None else generation)
        log.clean(spark, batch)
        log.write(changed, batch)

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Take in everything available now and return the table."""
        spark = stream.sparkSession
        known = exists(spark, f"{checkpoint}/offsets")
        generation = (self._generation(spark) or 0) if known else self._started(spark)
        columns = dict.fromkeys([*self.keys, self.time, self.tiebreak, *self.keep])
        query = (
            self._newest(stream.select(*columns))
            .writeStream.outputMode("update")
            .foreachBatch(lambda changed, batch: self.merge(changed, batch, generation))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.current(spark)

    def current(self, spark: SparkSession) -> DataFrame | None:
        """The newest row of every key; None before the first batch."""
        generation = self._generation(spark)
        if generation is None:
            return None
        rows = self._log(generation).rows(spark)
        if not exists(spark, f"{self._base(generation)}/_SUCCESS"):
            return rows
        base = spark.read.parquet(self._base(generation))
        return base if rows is None else self._newest(base.unionByName(rows))
