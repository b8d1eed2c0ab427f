"""Scattered points to grids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.geo import Grid, geo_span, wrap_lon
from ..functions.missing import col, finite, rounded
from ..plans.joins import lookup_join

DAYS_PER_YEAR = 365.25


def locate(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat", wrapped: bool = False) -> DataFrame:
    """Add ``ix, iy``; drop points outside the half-open box.

    The box predicate of a regional grid is on the coordinates, before any index
    arithmetic. With ``wrapped`` (longitudes already in [-180, 180)) it reaches the
    file scan.
    """
    x = col(lon) if wrapped else wrap_lon(lon)
    inside = df if grid.whole_globe else df.filter(grid.contains(x, lat))
    return inside.withColumn("ix", grid.ix(x)).withColumn("iy", grid.iy(lat)).filter(grid.in_range("ix", "iy"))


def bin_mean(
    df: DataFrame,
    grid: Grid,
    value: str,
    lon: str = "lon",
    lat: str = "lat",
    keys: tuple[str, ...] = (),
    weight: Column | None = None,
    wrapped: bool = False,
) -> DataFrame:
    """Mean of the points in each cell: ``(keys, ix, iy, value, n)``, filled cells only.

    Sums and counts are combined before the shuffle, so a crowded cell costs one
    row per task.
    """
    real = df.filter(finite(value) & finite(lon) & finite(lat))
    cells = locate(real, grid, lon, lat, wrapped).groupBy(*keys, "ix", "iy")
    mean = F.avg(value) if weight is None else F.sum(col(value) * weight) / F.sum(weight)
    return cells.agg(mean.alias("value"), F.count(F.lit(1)).alias("n"))


def coarsen(
    cells: DataFrame,
    fine: Grid,
    coarse: Grid,
    value: str = "value",
    keys: tuple[str, ...] = (),
    area_weighted: bool = False,
) -> DataFrame:
    """Mean of the filled fine cells whose centres fall in each coarse cell."""
    centred = cells.withColumn("_lon", fine.centre_lon("ix")).withColumn("_lat", fine.centre_lat("iy"))
    weight = F.cos(F.radians("_lat")) if area_weighted else None
    return bin_mean(centred.drop("ix", "iy"), coarse, value, "_lon", "_lat", keys, weight, wrapped=False)


def climatology(
    df: DataFrame,
    keys: list[str],
    value: str,
    factor: float = DAYS_PER_YEAR,
    name: str = "clim",
    weight: Column | None = None,
) -> DataFrame:
    """Time mean per cell, missing values ignored, times a unit factor.

    All times count alike unless given a ``weight``, such as ``dates.days_in_month``.
    """
    real = df.filter(finite(value))
    mean = F.avg(value) if weight is None else F.sum(col(value) * weight) / F.sum(weight)
    return real.groupBy(*keys).agg((mean * factor).alias(name), F.count(F.lit(1)).alias("n"))


def grid_from_axes(cells: DataFrame, lon: str = "lon", lat: str = "lat") -> Grid:
    """The grid whose cell centres are the distinct coordinates; one row reaches the driver."""
    axes = [F.min(lon), F.min(lat), F.max(lon), F.max(lat), F.count_distinct(lon), F.count_distinct(lat)]
    return Grid.from_centres(*cells.agg(*axes).first())


def grid_from_extent(cells: DataFrame, step: float, lon: str = "lon", lat: str = "lat") -> Grid:
    """A grid of about ``step`` degrees over the extent of scattered or curvilinear cells.

    Coordinates are taken as cell centres: half a step is added on every side, so that
    the outermost cells stay inside the half-open box.
    """
    real = cells.filter(finite(lon) & finite(lat))
    west, south, east, north = real.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    west, south, east, north = west - step / 2, south - step / 2, east + step / 2, north + step / 2
    return Grid(west, south, east, north, round((east - west) / step), round((north - south) / step))


def spine(spark, grid: Grid) -> DataFrame:
    """Every cell of the grid, row-major from the south-west corner."""
    pos = F.col("id")
    return spark.range(grid.cells).select(
        pos.alias("pos"), (pos % grid.nx).alias("ix"), F.floor(pos / F.lit(grid.nx)).cast("long").alias("iy")
    )


def densify(cells: DataFrame, grid: Grid, value: str = "value", decimals: int | None = None) -> DataFrame:
    """All cells of the grid, null where nothing was observed.

    With ``decimals=0`` values become whole numbers.
    """
    filled = cells.select((F.col("iy") * grid.nx + F.col("ix")).alias("pos"), F.col(value))
    dense = spine(cells.sparkSession, grid).join(filled, "pos", "left")
    if decimals is None:
        return dense
    out = rounded(value, decimals)
    return dense.withColumn(value, out.cast("long") if decimals == 0 else out)


def grid_summary(dense: DataFrame, value: str = "value") -> DataFrame:
    return dense.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(value).alias("filled"),
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"),
    )


def sample(
    points: DataFrame,
    cells: DataFrame,
    grid: Grid,
    lon: str = "lon",
    lat: str = "lat",
    value: str = "value",
    name: str = "sampled",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Value of the cell under each point; null outside the grid or over an empty cell."""
    x = wrap_lon(lon)
    inside = grid.contains(x, lat)
    placed = points.withColumn("ix", F.when(inside, grid.ix(x))).withColumn("iy", F.when(inside, grid.iy(lat)))
    lookup = cells.select(*keys, "ix", "iy", F.col(value).alias(name))
    # One grid has at most as many cells as its geometry says; of many grids nothing is known.
    bound = None if keys else grid.cells
    out = lookup_join(placed, lookup, [*keys, "ix", "iy"], "left", bound)
    return out.withColumn("ix", F.when(grid.in_range("ix", "iy"), F.col("ix"))).withColumn(
        "iy", F.when(F.col("ix").isNotNull(), F.col("iy"))
    )


def paint_tiles(
    cells: DataFrame,
    grid: Grid,
    z: int,
    size: int = 256,
    keys: tuple[str, ...] = (),
    value: str = "value",
    tasks: int | None = None,
) -> DataFrame:
    """Grid cells to the tile pixels whose centres they cover: ``(keys, x, y, px, py, value)``.

    Each cell writes its own pixels, so nothing is shuffled. Few cells at a fine level
    write many pixels each: ``tasks`` then spreads the pixel rows of every cell. Pixels are counted
    across the whole level (from 180W and 90N); the candidate range of a cell is one
    pixel wider on each side and the exact test is the cell index of the pixel centre.
    """
    width, height = 2 ** (z + 1) * size, 2**z * size
    span = geo_span(z)

    def lon_of(gx: Column) -> Column:
        x = F.floor(gx / F.lit(size))
        return (F.lit(-180.0) + x * span) + ((gx % size) + 0.5) / F.lit(size) * span

    def lat_of(gy: Column) -> Column:
        y = F.floor(gy / F.lit(size))
        return (F.lit(90.0) - y * span) - ((gy % size) + 0.5) / F.lit(size) * span

    def run(first: Column, last: Column, limit: int) -> Column:
        lo = F.greatest(F.lit(0).cast("long"), F.floor(first).cast("long") - 1)
        hi = F.least(F.lit(limit - 1).cast("long"), F.ceil(last).cast("long") + 1)
        return F.when(lo <= hi, F.sequence(lo, hi))

    per_lon, per_lat = width / 360.0, height / 180.0
    west = F.lit(grid.west) + F.col("ix") * grid.dlon
    south = F.lit(grid.south) + F.col("iy") * grid.dlat
    columns = run((west + 180.0) * per_lon, (west + grid.dlon + 180.0) * per_lon, width)
    rows = run((F.lit(90.0) - south - grid.dlat) * per_lat, (F.lit(90.0) - south) * per_lat, height)

    by_row = cells.select(*keys, "ix", "iy", F.col(value).alias("value"), F.explode(rows).alias("gy")).withColumn(
        "_lat", lat_of(F.col("gy"))
    )
    by_row = by_row.filter(
        (F.col("_lat") >= grid.south) & (F.col("_lat") < grid.north) & (grid.iy("_lat") == F.col("iy"))
    )
    if tasks is not None:
        by_row = by_row.repartition(tasks, *keys, "gy", "ix")
    by_pixel = by_row.select("*", F.explode(columns).alias("gx")).withColumn("_lon", lon_of(F.col("gx")))
    by_pixel = by_pixel.filter(
        (F.col("_lon") >= grid.west) & (F.col("_lon") < grid.east) & (grid.ix("_lon") == F.col("ix"))
    )
    return by_pixel.select(
        *keys,
        F.floor(F.col("gx") / F.lit(size)).cast("long").alias("x"),
        F.floor(F.col("gy") / F.lit(size)).cast("long").alias("y"),
        (F.col("gx") % size).alias("px"),
        (F.col("gy") % size).alias("py"),
        F.col("value"),
    )


def ramp_painted(pixels: DataFrame, ramp: str, vmin: float, vmax: float, value: str = "value") -> DataFrame:
    t = (F.col(value) - vmin) / F.lit(vmax - vmin)
    return pixels.withColumn("rgba", colour.ramp_colour(ramp, t))
