"""Places of rows in the files they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join


def numbered(scan: DataFrame, name: str) -> DataFrame:
    """Rows of a file scan with their place, 0, 1, ..., over all files by path.

    A file is read in blocks, by tasks in any order. A first pass counts the rows of each
    block, as many summary rows as blocks; the place is what lies before the block, by file
    and offset, and the rows before this one inside it. So it depends neither on the order in
    which the files are named nor on how they are cut. ``scan`` is the reader's result itself.
    """
    tagged = scan.withColumns({
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id(),
    })
    blocks = tagged.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    placed = lookup_join(tagged, starts, ["_file", "_block"], "inner")
    return placed.withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_block", "_row", "_start")
