"""Longitude/latitude grids and tile pyramids as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .missing import col, finite

# Fixed values of the imagery pyramid: degrees per pixel at level 0, pixels per tile side.
BASE_DEGREES_PER_PIXEL = 0.5625
TILE_PIXELS = 512


def wrap_lon(lon: Column | str) -> Column:
    """Any longitude to [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


@dataclass(frozen=True)
class Grid:
    """A regular lon/lat grid. Row 0 is the southmost; cells are half-open boxes."""

    west: float
    south: float
    east: float
    north: float
    nx: int
    ny: int

    @property
    def dlon(self) -> float:
        return (self.east - self.west) / self.nx

    @property
    def dlat(self) -> float:
        return (self.north - self.south) / self.ny

    @property
    def cells(self) -> int:
        return self.nx * self.ny

    @staticmethod
    def from_centres(west, south, east, north, nx, ny) -> "Grid":
        """Build from the outermost cell centres by padding half a cell on each side."""
        half_x = (east - west) / (nx - 1) / 2
        half_y = (north - south) / (ny - 1) / 2
        return Grid(west - half_x, south - half_y, east + half_x, north + half_y, nx, ny)

    @property
    def whole_globe(self) -> bool:
        return (self.west, self.south, self.east, self.north) == (-180, -90, 180, 90)

    def contains(self, lon: Column | str, lat: Column | str) -> Column:
        lon, lat = col(lon), col(lat)
        return (lat >= self.south) & (lat < self.north) & (lon >= self.west) & (lon < self.east)

    def ix(self, lon: Column | str) -> Column:
        return F.floor((col(lon) - self.west) / F.lit(self.dlon)).cast("long")

    def iy(self, lat: Column | str) -> Column:
        return F.floor((col(lat) - self.south) / F.lit(self.dlat)).cast("long")

    def in_range(self, ix: Column | str, iy: Column | str) -> Column:
        """Guards the last cell against floating error in the division."""
        return col(ix).between(0, self.nx - 1) & col(iy).between(0, self.ny - 1)

    def centre_lon(self, ix: Column | str) -> Column:
        return F.lit(self.west) + (col(ix) + 0.5) * F.lit(self.dlon)

    def centre_lat(self, iy: Column | str) -> Column:
        return F.lit(self.south) + (col(iy) + 0.5) * F.lit(self.dlat)


def _level(z) -> Column:
    return F.lit(z) if isinstance(z, int) else col(z)


def tile_span(z) -> Column:
    """Degrees per tile at level ``z`` of the imagery pyramid."""
    return F.lit(BASE_DEGREES_PER_PIXEL * TILE_PIXELS) / F.pow(F.lit(2.0), _level(z))


def tile_counts(z) -> tuple[Column, Column]:
    span = tile_span(z)
    return F.ceil(F.lit(360.0) / span).cast("long"), F.ceil(F.lit(180.0) / span).cast("long")


def located(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows with a place: both coordinates are real numbers."""
    return df.filter(finite(lon) & finite(lat))


def _placed(lon: Column | str) -> Column:
    """Longitude on the map: wrapped unless it is within [-180, 180] already."""
    lon = col(lon)
    return F.when((lon >= -180) & (lon <= 180), lon).otherwise(wrap_lon(lon))


def _within(number: Column, most, of: Column | str, known: bool) -> Column:
    """Held to 0..most. The functions that do this skip nulls, so their result never is null
    and joins on it need no filter that repeats it; but a coordinate that is missing or not
    finite has to be kept apart, unless all are ``known`` to have a place."""
    held = F.greatest(F.lit(0).cast("long"), F.least(number, most))
    return held if known else F.when(finite(of), held)


def tile_x(lon: Column | str, z, known: bool = False) -> Column:
    """Tile column; longitudes wrap and 180 falls in the last tile. Null where there is no
    place. ``known`` promises that there is one, as in rows of ``located``."""
    nx, _ = tile_counts(z)
    return _within(F.floor((_placed(lon) + 180.0) / tile_span(z)).cast("long"), nx - 1, lon, known)


def tile_y(lat: Column | str, z, known: bool = False) -> Column:
    """Tile row counted from the north, clamped so latitude -90 falls in the last tile."""
    _, ny = tile_counts(z)
    return _within(F.floor((F.lit(90.0) - col(lat)) / tile_span(z)).cast("long"), ny - 1, lat, known)


def tile_bounds(x, y, z) -> Column:
    """West, south, east, north of a tile. Edge tiles run past the globe on purpose."""
    span = tile_span(z)
    west = F.lit(-180.0) + col(x) * span
    north = F.lit(90.0) - col(y) * span
    return F.struct(
        west.alias("west"), (north - span).alias("south"), (west + span).alias("east"), north.alias("north")
    )


def pixel_x(lon, x, z, size: int = TILE_PIXELS, known: bool = False) -> Column:
    span = tile_span(z)
    place = F.floor((_placed(lon) - (F.lit(-180.0) + col(x) * span)) / span * size).cast("long")
    return _within(place, F.lit(size - 1).cast("long"), lon, known)


def pixel_y(lat, y, z, size: int = TILE_PIXELS, known: bool = False) -> Column:
    span = tile_span(z)
    place = F.floor(((F.lit(90.0) - col(y) * span) - col(lat)) / span * size).cast("long")
    return _within(place, F.lit(size - 1).cast("long"), lat, known)


def geo_span(z) -> Column:
    """Degrees per tile of the power-of-two geographic pyramid (2x1 tiles at level 0)."""
    return F.lit(180.0) / F.pow(F.lit(2.0), _level(z))


def geo_tile_x(lon, z: int, known: bool = False) -> Column:
    return _within(F.floor((_placed(lon) + 180.0) / geo_span(z)).cast("long"), F.lit(2 ** (z + 1) - 1).cast("long"), lon, known)


def geo_tile_y(lat, z: int, known: bool = False) -> Column:
    return _within(F.floor((F.lit(90.0) - col(lat)) / geo_span(z)).cast("long"), F.lit(2**z - 1).cast("long"), lat, known)


def _spread(c: Column | str) -> Column:
    """The low 31 bits of a number with a zero bit between any two."""
    c = col(c).cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _gathered(c: Column) -> Column:
    """Every other bit of a number, from the lowest on: what ``_spread`` spread."""
    c = c.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        c = c.bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask))
    return c


def interleaved(x: Column | str, y: Column | str) -> Column:
    """One number of two: the bits of x at the even places, those of y at the odd ones. Two
    bits less name the cell one level up, and cells near each other have numbers near each other."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def cell_of(key: Column | str) -> tuple[Column, Column]:
    """x and y behind an interleaved key."""
    return _gathered(col(key)), _gathered(F.shiftright(col(key), 1))
