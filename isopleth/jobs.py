"""Named refresh jobs: landed files in, snapshot out.

Each job reads landed files, applies operators, and writes Parquet with an envelope
row under ``out``. ``snapshot`` and ``as_of`` are dates given by the caller. Jobs
return the written data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import Grid
from .functions.missing import nan_to_null, rounded
from .operators import grid as g
from .operators import points as p
from .operators import series as s
from .sources import documents, sinks, tables

# Output names of the transport variables, their unit and precision.
TRANSPORTS = {
    "moc_mar_hc10": "moc", "t_gs10": "gulf_stream", "t_ek10": "ekman", "t_umo10": "upper_mid_ocean",
}
REBASE_FROM = 2005


@dataclass(frozen=True)
class Climatology:
    """How a field cube becomes a dense climatology grid."""

    units: str
    ramp: str
    vmin: float
    vmax: float
    factor: float = 1.0
    decimals: int = 0
    grid: Grid | None = None  # None: taken from the data
    step: float | None = None  # for curvilinear data: degrees per cell


# The climatology grids.
CLIMATOLOGIES = {
    "gpcp": Climatology("mm/yr", "precip", 0, 3000, factor=g.DAYS_PER_YEAR, grid=Grid(-180, -90, 180, 90, 144, 72)),
    "eobs": Climatology("mm/yr", "precip", 0, 2500, factor=g.DAYS_PER_YEAR),
    "oisst": Climatology("°C", "sst", -2, 32, decimals=1, grid=Grid(-180, -90, 180, 90, 360, 180)),
    "meteoswiss": Climatology("mm/yr", "precip", 0, 2500, step=0.02),
}


def _write(df: DataFrame, out: str, snapshot: str, **envelope) -> DataFrame:
    sinks.write_snapshot(df, out, snapshot, **envelope)
    return sinks.read_snapshot(df.sparkSession, out)[0]


def emitters(spark: SparkSession, pages, out: str, snapshot: str, year: int, n: int = 1000, lines: bool = False) -> DataFrame:
    """The largest facilities that have a place and a quantity."""
    found = p.complete(documents.read_asset_pages(spark, pages, lines), "lon", "lat", "q")
    ranked = found.orderBy(F.col("q").desc(), "name", "lon", "lat").limit(n)
    rows = ranked.select(
        rounded("lon", 4).alias("lon"), rounded("lat", 4).alias("lat"),
        rounded(F.col("q") / p.TONNES_PER_MEGATONNE, 3).alias("mt_co2e"), "name", "country", "sector",
    )
    return _write(rows, out, snapshot, year=year)


def floats(spark: SparkSession, positions, out: str, as_of: str, days: int = 10, lines: bool = False) -> DataFrame:
    """Latest position of every platform reporting in the ``days`` before ``as_of``."""
    fields = {"float_id": "string", "lat": "double", "lon": "double", "time": "timestamp_ntz"}
    rows = documents.read_row_table(spark, positions, fields, lines).distinct()
    recent = p.since(rows, "time", F.lit(as_of).cast("date"), days)
    # Reports of one platform at one time are told apart by their place.
    keyed = recent.withColumn("_tie", F.xxhash64("lon", "lat"))
    latest = p.latest_positions(keyed, "float_id", "time", "_tie", "lon", "lat")
    return _write(latest.select("lon", "lat", "float_id", "date"), out, as_of)


def transports(spark: SparkSession, samples, out: str, snapshot: str, step: int = 20) -> DataFrame:
    """Transport samples to means of ``step`` samples dated by the middle one."""
    raw = spark.read.parquet(samples).select("time", *[nan_to_null(c).alias(c) for c in TRANSPORTS])
    blocks = s.block_mean(raw, [], "time", None, list(TRANSPORTS), step)
    rows = blocks.select(
        F.col("time").cast("date").alias("t"), *[rounded(c, 2).alias(name) for c, name in TRANSPORTS.items()]
    )
    return _write(rows, out, snapshot, units="Sv", resolution_days=step / 2)


def sea_level(spark: SparkSession, sheet, missions, out: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Yearly budget components, and altimetry shifted onto the observed series."""
    budget = _write(tables.read_budget_sheet(spark, sheet), f"{out}/budget", snapshot, units="mm")
    one = F.lit("altimetry").alias("series")
    samples = tables.read_missions(spark, missions).select(one, "t", "v", "position")
    base = budget.filter(F.col("year") == REBASE_FROM).select(one, F.col("observed"))
    shifted = s.rebase(samples, ["series"], "t", "v", REBASE_FROM, base, "observed", "position")
    rows = shifted.select("position", "t", rounded("v", 1).alias("v"))
    return budget, _write(rows, f"{out}/altimetry", snapshot, units="mm")


def inventory(spark: SparkSession, attributes, rates, out: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Inventory with rates, and its totals; rows that did not parse go to ``quarantine``."""
    good, bad = tables.read_inventory(spark, attributes)
    rows = _write(
        p.with_rates(good, tables.read_rates(spark, rates), "rgi_id", "dhdt"), out, snapshot,
        region_names=json.dumps(tables.INVENTORY_REGIONS),
    )
    bad.write.mode("overwrite").parquet(f"{out}/quarantine")
    return rows, p.inventory_totals(rows, "area", "dhdt")


def temperature(spark: SparkSession, land_ocean, land_only, out: str, snapshot: str) -> DataFrame:
    """Land-only anomalies on the years of the land-and-ocean series."""
    whole = tables.read_annual(spark, land_ocean).withColumnRenamed("value", "land_ocean")
    land = tables.read_annual(spark, land_only).withColumnRenamed("value", "land_only")
    return _write(s.align(whole, land, ["year"]), out, snapshot, units="°C", baseline="1951-1980")


def climatology(spark: SparkSession, cube: str, dataset: str, out: str, snapshot: str, spec: Climatology | None = None) -> DataFrame:
    """Time mean of a cube ``(time, lon, lat, value)`` on its display grid, all cells."""
    spec = spec or CLIMATOLOGIES[dataset]
    field = tables.read_cube(spark, cube, dataset)
    mean = g.climatology(field, ["lon", "lat"], "value", spec.factor)
    if spec.grid is not None:
        grid = spec.grid
    elif spec.step is not None:
        grid = g.grid_from_extent(field, spec.step)
    else:
        grid = g.grid_from_axes(field.select("lon", "lat"))
    dense = g.densify(g.bin_mean(mean, grid, "clim"), grid, decimals=spec.decimals)
    return _write(
        dense, out, snapshot, id=dataset, units=spec.units, ramp=spec.ramp, vmin=spec.vmin, vmax=spec.vmax,
        west=grid.west, south=grid.south, east=grid.east, north=grid.north,
        dlon=round(grid.dlon, 6), dlat=round(grid.dlat, 6), nx=grid.nx, ny=grid.ny,
    )


def species(spark: SparkSession, occurrences, groups: DataFrame, out: str, snapshot: str, kingdoms: str) -> DataFrame:
    """Record counts of the groups ``(label, key, name)`` from an occurrence table with an
    array of the taxon keys each record belongs to; ``unplaced`` is what the groups labelled
    ``kingdoms`` leave over."""
    records = spark.read.parquet(occurrences)
    counts = records.select(F.explode(F.array_distinct("taxon_keys")).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("records")
    )
    items = groups.join(counts, "key", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    total = records.agg(F.count(F.lit(1))).scalar()
    placed = items.filter(F.col("label") == kingdoms).agg(F.sum("records")).scalar()
    rows = items.withColumn("total", total).withColumn("unplaced", F.col("total") - placed)
    return _write(rows, out, snapshot)


JOBS: dict[str, Callable] = {
    "emitters": emitters,
    "floats": floats,
    "transports": transports,
    "sea_level": sea_level,
    "inventory": inventory,
    "temperature": temperature,
    "climatology": climatology,
    "species": species,
}
