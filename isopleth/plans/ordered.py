"""Ordered work over series of any length.

A plain window puts a whole series into one task, which fails when one series
holds a large share of the rows. So rows are range-partitioned on (series, order),
and a long series spreads over many chunks of similar size. A chunk's rows are
handled by a window on (series, chunk), and what must flow from one chunk to the
next is computed on one summary row per (series, chunk).

The chunk number comes from a sampled range partitioning, so the tagged rows are
written once to the shared scratch folder; every later step reads that table and
sees the same numbers even when tasks are rerun. The table is bucketed by chunk, so
the windows find their rows together and shuffle nothing. Only the first and the
last series of a chunk can go on in another one: at most two summary rows a chunk
are passed on, and they are broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK = "_chunk"
SERIES = "_series"


@dataclass(frozen=True)
class Ordered:
    """Rows tagged with chunk numbers. ``order`` must be a total order within a series.

    The series columns are held together in one struct: structs with missing parts
    compare equal, so a series whose key is missing joins like any other.
    """

    rows: DataFrame
    series: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def _group(self) -> list[str]:
        return [*self.series, CHUNK]

    def untagged(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*self._group)

    def local(self) -> Window:
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def local_down(self) -> Window:
        return Window.partitionBy(*self._group).orderBy(*[F.col(c).desc() for c in self.order])

    def across_down(self) -> Window:
        return Window.partitionBy(*self.series).orderBy(F.col(CHUNK).desc())

    def across(self) -> Window:
        """Over the summary rows: one per (series, chunk), so at most as many as chunks."""
        return Window.partitionBy(*self.series).orderBy(CHUNK)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per chunk for each series that may go on beyond it: its first and its last."""
        parts = self.rows.groupBy(*self._group).agg(*aggregates)
        if not self.series:
            return parts
        chunk = Window.partitionBy(CHUNK)
        ends = parts.withColumn("_first", F.min(SERIES).over(chunk)).withColumn("_last_one", F.max(SERIES).over(chunk))
        return ends.filter(F.col(SERIES).eqNullSafe(F.col("_first")) | F.col(SERIES).eqNullSafe(F.col("_last_one"))).drop("_first", "_last_one")

    def join_summary(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Rows with what reaches their chunk from the others, missing where nothing does. At
        most two summary rows a chunk, and there are no more chunks than tasks."""
        return rows.join(F.broadcast(summary), self._group, "left")

    def newest(self, value: Column) -> Column:
        """Aggregate: the value on the last row, by order, where it is not null."""
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))

    def oldest(self, value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order)))


def ordered(df: DataFrame, series: list[str], order: list[str]) -> Ordered:
    """Tag rows with chunk numbers. Ends ``order`` with a unique column to split ties.

    Runs a job: the tagged rows are written, as a table of the session's catalog, since only
    those tell Spark how they are bucketed.
    """
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"isopleth_ordered_{uuid.uuid4().hex}"
    (
        df.repartitionByRange(*[F.col(c) for c in (*series, *order)])
        .withColumn(CHUNK, F.spark_partition_id())
        .write.bucketBy(buckets, CHUNK)
        .sortBy(CHUNK, *series, *order)
        .option("path", scratch_path(spark, "ordered"))
        .saveAsTable(name)
    )
    rows = spark.table(name)
    if series:
        rows = rows.withColumn(SERIES, F.struct(*series))
    return Ordered(rows, (SERIES,) if series else (), tuple(order))


def running_sum(o: Ordered, value: Column, name: str) -> DataFrame:
    """Rows plus the running total of ``value`` within the series, this row included."""
    before = F.sum("_part").over(o.across().rowsBetween(Window.unboundedPreceding, -1))
    offsets = o.summary(F.sum(value).alias("_part")).select(
        *o._group, before.alias("_before")
    )
    here = F.sum(value).over(o.local().rowsBetween(Window.unboundedPreceding, 0))
    rows = o.rows.withColumn("_here", here)
    out = (
        o.join_summary(rows, offsets)
        .withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0).cast("long")))
        .drop("_here", "_before")
    )
    return o.untagged(out)


def row_numbers(o: Ordered, name: str = "rn") -> DataFrame:
    """Rows numbered 1, 2, ... in order within their series."""
    before = F.sum("_part").over(o.across().rowsBetween(Window.unboundedPreceding, -1))
    offsets = o.summary(F.count(F.lit(1)).alias("_part")).select(
        *o._group, before.alias("_before")
    )
    rows = o.rows.withColumn("_here", F.row_number().over(o.local()))
    out = (
        o.join_summary(rows, offsets)
        .withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0).cast("long")))
        .drop("_here", "_before")
    )
    return o.untagged(out)


def previous(o: Ordered, value: Column, name: str) -> DataFrame:
    """Rows plus the value on the row before, within the series (null on the first row)."""
    packed = F.struct(value.alias("v"))
    summary = o.summary(F.max_by(packed, F.struct(*o.order)).alias("_last")).select(
        *o._group, F.lag("_last").over(o.across()).alias("_carried")
    )
    rows = o.rows.withColumn("_lag", F.lag(packed).over(o.local()))
    out = (
        o.join_summary(rows, summary)
        .withColumn(name, F.coalesce(F.col("_lag"), F.col("_carried"))["v"])
        .drop("_lag", "_carried")
    )
    return o.untagged(out)


def neighbours(o: Ordered, value: Column, before: str, after: str) -> DataFrame:
    """Rows plus the nearest non-null ``value`` at or before, and at or after, each row."""
    # Looking ahead is looking back in descending order: a frame that grows at its
    # start would be recomputed for every row.
    until_here = (Window.unboundedPreceding, 0)
    left = o.across().rowsBetween(Window.unboundedPreceding, -1)
    right = o.across_down().rowsBetween(Window.unboundedPreceding, -1)
    summary = o.summary(o.newest(value).alias("_newest"), o.oldest(value).alias("_oldest")).select(
        *o._group,
        F.last("_newest", ignorenulls=True).over(left).alias("_carried_before"),
        F.last("_oldest", ignorenulls=True).over(right).alias("_carried_after"),
    )
    nearest = F.last(value, ignorenulls=True)
    rows = o.rows.withColumn("_b", nearest.over(o.local().rowsBetween(*until_here))).withColumn(
        "_a", nearest.over(o.local_down().rowsBetween(*until_here))
    )
    out = (
        o.join_summary(rows, summary)
        .withColumn(before, F.coalesce("_b", "_carried_before"))
        .withColumn(after, F.coalesce("_a", "_carried_after"))
        .drop("_b", "_a", "_carried_before", "_carried_after")
    )
    return o.untagged(out)
