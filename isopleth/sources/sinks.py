"""Snapshot writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.missing import rounded
from ..session import discard, folders, read_text, replace_text

# A JSON document is one row of one task, so only results of known size become one.
DOCUMENT_ROWS = 1_000_000


# The file that names the version in force; versions older than the one before it go.
MANIFEST = "current.txt"


def write_snapshot(df: DataFrame, path: str, snapshot: str, **envelope: str) -> None:
    """Data as Parquet and a one-row envelope, published together.

    Both are written to a folder of their own first; then the manifest, which names that
    folder, is replaced by a rename. A reader sees the old snapshot or the new one, never data
    of one with the envelope of the other, and a write that dies leaves the old one in force.
    The version before stays for those still reading it. ``snapshot`` is the date the data
    stand for.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    df.write.parquet(f"{folder}/data")
    row = {"snapshot": snapshot, **envelope}
    spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in row.items()]).write.json(f"{folder}/meta")
    before = _versions(spark, path)[:1]
    replace_text(spark, f"{path}/{MANIFEST}", "\n".join([version, *before]))
    for old in set(folders(spark, f"{path}/versions")) - {version, *before}:
        discard(spark, f"{path}/versions/{old}")


def _versions(spark, path: str) -> list[str]:
    """The version in force and the one before it."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    return text.split("\n") if text else []


def read_snapshot(spark, path: str) -> tuple[DataFrame, DataFrame]:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no snapshot has been published at {path}")
    folder = f"{path}/versions/{versions[0]}"
    return spark.read.parquet(f"{folder}/data"), spark.read.json(f"{folder}/meta")


def parallel_arrays(df: DataFrame, order: str, columns: list[str], rows: int = DOCUMENT_ROWS) -> DataFrame:
    """A small result as one row of equally long arrays in the given order.

    Larger results are refused: write those with ``write_snapshot``.
    """
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows do not belong in one document")
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    one = df.agg(packed.alias("_all"))
    return one.select(*[F.col(f"_all.{c}").alias(c) for c in columns])


def grid_document(dense: DataFrame, grid: Grid, decimals: int = 0, value: str = "value", **envelope) -> DataFrame:
    """Dense cells ``(pos, value)`` as one grid document, row-major from the south-west.

    Larger grids are refused: ``grid_rows`` takes grids of any size.
    """
    if grid.cells > DOCUMENT_ROWS:
        raise ValueError(f"{grid.cells} cells do not belong in one document")
    v = rounded(value, decimals)
    packed = F.array_sort(F.collect_list(F.struct("pos", (v.cast("long") if decimals == 0 else v).alias("v"))))
    one = dense.agg(packed.alias("_all"))
    return one.select(*[F.lit(x).alias(k) for k, x in _geometry(grid, **envelope).items()], F.col("_all.v").alias("values"))


def grid_rows(dense: DataFrame, grid: Grid, decimals: int = 0, value: str = "value", **envelope) -> DataFrame:
    """Dense cells ``(pos, value)`` as one document per grid row ``iy``, west to east.

    No task holds more than the rows of its share, so grids of any height are fine.
    """
    v = rounded(value, decimals)
    packed = F.array_sort(F.collect_list(F.struct("pos", (v.cast("long") if decimals == 0 else v).alias("v"))))
    rows = dense.groupBy(F.floor(F.col("pos") / F.lit(grid.nx)).cast("long").alias("iy")).agg(packed.alias("_all"))
    return rows.select(*[F.lit(x).alias(k) for k, x in _geometry(grid, **envelope).items()], "iy", F.col("_all.v").alias("values"))


def _geometry(grid: Grid, **envelope) -> dict:
    return {
        "west": grid.west, "south": grid.south, "east": grid.east, "north": grid.north,
        "dlon": round(grid.dlon, 6), "dlat": round(grid.dlat, 6), "nx": grid.nx, "ny": grid.ny, **envelope,
    }


def write_document(one: DataFrame, path: str) -> None:
    """Rows as JSON documents; null elements and fields are kept."""
    one.write.mode("overwrite").option("ignoreNullFields", False).json(path)
