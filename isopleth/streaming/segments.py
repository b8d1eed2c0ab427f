"""A log of changed rows, written by the micro-batches of a stream and merged in tiers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..session import discard, exists, folders

_NAME = re.compile(r"segment=(\d+)-(\d+)$")


@dataclass(frozen=True)
class SegmentLog:
    """Rows that changed, one segment for each micro-batch, from the first batch to the last.

    When a tier has ``fan`` segments they are merged into one of the next, so a row is
    rewritten once per tier and at most ``fan`` segments of each tier are read, however many
    batches there were. ``reduced`` drops the rows that later ones supersede.

    A segment counts once it is complete. What it covers stays until the next batch starts:
    by then this one is committed, so a replayed batch finds all that it merges, and a
    reader has the length of a batch to finish.
    """

    path: str
    reduced: Callable[[DataFrame], DataFrame]
    fan: int = 8

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/segment={first}-{last}"

    def complete(self, spark: SparkSession) -> list[tuple[int, int]]:
        """First and last batch of every complete segment."""
        found = [(int(m[1]), int(m[2])) for name in folders(spark, self.path) if (m := _NAME.search(name))]
        return sorted(s for s in found if exists(spark, f"{self._folder(*s)}/_SUCCESS"))

    def largest(self, spark: SparkSession, upto: int | None = None) -> list[tuple[int, int]]:
        """The complete segments that no other one covers, up to a batch."""
        held = [s for s in self.complete(spark) if upto is None or s[1] <= upto]
        return [s for s in held if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in held)]

    def read(self, spark: SparkSession, segments: list[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.parquet(self._folder(*s)) for s in segments])

    def rows(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """What the log holds, superseded rows left out; None before the first batch."""
        held = self.largest(spark, upto)
        return self.reduced(self.read(spark, held)) if held else None

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows changed by a batch; a replayed batch writes the same again."""
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(self._folder(batch, batch))
        size = self.fan
        while (batch + 1) % size == 0:
            self.merge(spark, batch + 1 - size, batch)
            size *= self.fan

    def merge(self, spark: SparkSession, first: int, last: int, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """One segment for the batches ``first`` to ``last``, with the rows that ``kept`` keeps."""
        parts = [s for s in self.largest(spark, last) if s[0] >= first and s != (first, last)]
        if parts:
            kept(self.reduced(self.read(spark, parts))).write.mode("overwrite").parquet(self._folder(first, last))

    def clean(self, spark: SparkSession, batch: int) -> None:
        """Delete what the segments of batches before ``batch`` cover, and what a lost run left half done."""
        largest = set(self.largest(spark, batch - 1))
        for name in folders(spark, self.path):
            found = _NAME.search(name)
            if found and int(found[2]) < batch and (int(found[1]), int(found[2])) not in largest:
                discard(spark, f"{self.path}/{name}")
