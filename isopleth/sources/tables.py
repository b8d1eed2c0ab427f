"""Delimited text and Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import interleaved
from ..functions.missing import finite, number, rounded
from ..operators.points import keep_parsed
from .lines import numbered

# Positions of the mean columns in the sea-level budget sheet.
BUDGET_COLUMNS = {
    2: "observed", 5: "sum", 8: "steric", 11: "glaciers", 14: "greenland", 17: "antarctica", 20: "tws",
}
# Position of the January-December mean in the temperature table,
# and the period of the elevation-change rates.
ANNUAL_COLUMN = 13
ANNUAL_WIDTH = 19
RATE_PERIOD = "2000-01-01_2020-01-01"

# Inventory region codes and labels.
INVENTORY_REGIONS = {
    "01": "Alaska", "02": "W Canada & US", "03": "Arctic Canada N", "04": "Arctic Canada S",
    "05": "Greenland periphery", "06": "Iceland", "07": "Svalbard", "08": "Scandinavia",
    "09": "Russian Arctic", "10": "North Asia", "11": "Central Europe", "12": "Caucasus & M.East",
    "13": "Central Asia", "14": "South Asia West", "15": "South Asia East", "16": "Low latitudes",
    "17": "Southern Andes", "18": "New Zealand", "19": "Subantarctic & Antarctic",
}


def _positional(spark: SparkSession, path, width: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(width))
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def read_budget_sheet(spark: SparkSession, path) -> DataFrame:
    """CSV export of the budget sheet; rows without a year (the header too) are skipped."""
    sheet = _positional(spark, path, max(BUDGET_COLUMNS) + 1)
    year = number("c0").try_cast("int")
    return sheet.filter(year.isNotNull()).select(
        year.alias("year"), *[rounded(number(f"c{i}"), 1).alias(name) for i, name in BUDGET_COLUMNS.items()]
    )


def read_missions(spark: SparkSession, path) -> DataFrame:
    """Decimal year and the last non-blank mission column; any number of missions.

    Comments, the header and rows without a value are skipped. ``position`` is the number
    of the line over all files, since missions can share a time.
    """
    lines = numbered(spark.read.text(path), "position").filter(~F.col("value").startswith("#"))
    fields = F.split("value", ",")
    filled = F.filter(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1))), lambda x: F.trim(x) != "")
    parsed = lines.select(
        "position",
        rounded(number(F.get(fields, F.lit(0))), 3).alias("t"),
        rounded(number(F.try_element_at(filled, F.lit(-1))), 1).alias("v"),
    )
    return parsed.filter(F.col("t").isNotNull() & F.col("v").isNotNull())


def read_annual(spark: SparkSession, path) -> DataFrame:
    """Year and annual mean; banner rows and years without a mean are skipped."""
    raw = _positional(spark, path, ANNUAL_WIDTH).filter(F.col("c0").rlike("^[0-9]+$"))
    annual = raw.select(F.col("c0").try_cast("int").alias("year"), rounded(number(f"c{ANNUAL_COLUMN}"), 2).alias("value"))
    return annual.filter(F.col("value").isNotNull())


def read_inventory(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Regional attribute files: parsed rows, and the rows that did not parse.

    Columns are found by the header of each path, so regions may order them differently.
    """
    wanted = ["rgi_id", "cenlon", "cenlat", "area_km2"]
    paths = [paths] if isinstance(paths, str) else paths
    regions = [spark.read.option("header", True).csv(path).select(*wanted) for path in paths]
    raw = reduce(lambda a, b: a.unionByName(b), regions)
    good, bad = keep_parsed(raw, ["cenlon", "cenlat", "area_km2"])
    return good.select(
        "rgi_id", rounded("cenlon", 3).alias("lon"), rounded("cenlat", 3).alias("lat"),
        rounded("area_km2", 3).alias("area"),
    ), bad


def read_rates(spark: SparkSession, path, key: str = "rgi_id", period: str = RATE_PERIOD) -> DataFrame:
    """Rates of one period; the predicate and the two columns reach the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("period") == period).select(key, "dhdt")


# How finely a cube's rows are put in order of place, and how many bytes a row group has.
CLUSTER_BITS = 10
ROW_GROUP_BYTES = 16 << 20


def _share(c: str, low: float, high: float) -> Column:
    """A number of CLUSTER_BITS bits for a coordinate; missing ones come first."""
    steps = 1 << CLUSTER_BITS
    place = F.floor((F.col(c) - F.lit(float(low))) / F.lit(float(high - low)) * steps).cast("long")
    return F.when(finite(c), F.greatest(F.lit(0).cast("long"), F.least(F.lit(steps - 1).cast("long"), place))).otherwise(F.lit(0).cast("long"))


def write_cube(
    field: DataFrame, path: str, dataset: str, time: str = "time", cell: tuple[str, ...] = (),
    place: tuple[str, str] | None = None, row_group: int = ROW_GROUP_BYTES,
) -> None:
    """Field cells in long form, partitioned by dataset and year.

    With ``place``, the names of longitude and latitude, rows are ranged and sorted along a
    space-filling curve over the globe and then by time, so a row group covers a small box
    and a box skips most of them; else they are ranged by time and cell. Either way a crowded
    year spreads over files of similar size. The written years of the dataset replace what
    was there, so a rerun repeats no row; others stay.
    """
    rows = field.withColumn("dataset", F.lit(dataset)).withColumn("year", F.year(time))
    if place is None:
        dealt = rows.repartitionByRange("year", time, *cell)
    else:
        curve = interleaved(_share(place[0], -180, 180), _share(place[1], -90, 90))
        by = ["year", "_curve", time, *cell]
        dealt = rows.withColumn("_curve", curve).repartitionByRange(*by).sortWithinPartitions(*by).drop("_curve")
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group)
        .partitionBy("dataset", "year")
        .parquet(path)
    )


def read_cube(
    spark: SparkSession, path: str, dataset: str, years: tuple[int, int] | None = None,
    box: tuple[float, float, float, float] | None = None, place: tuple[str, str] = ("lon", "lat"),
) -> DataFrame:
    """One dataset of a cube. Years are a half-open range and prune partitions; ``box`` is
    west, south, east, north, half-open too, and skips the row groups outside it. A box whose
    west is above its east crosses the date line."""
    cube = spark.read.parquet(path).filter(F.col("dataset") == dataset)
    if years is not None:
        cube = cube.filter((F.col("year") >= years[0]) & (F.col("year") < years[1]))
    if box is not None:
        west, south, east, north = map(float, box)
        lon, lat = map(F.col, place)
        beside = ((lon >= west) & (lon < east)) if west <= east else ((lon >= west) | (lon < east))
        cube = cube.filter(beside & (lat >= south) & (lat < north))
    return cube
