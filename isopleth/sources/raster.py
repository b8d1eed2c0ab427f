"""Colormaps and raster tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colour import pack_rgb
from ..functions.missing import finite
from .lines import numbered

ENTRY = "_rgb string, _transparent string, _value string"


def _bound(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(finite(value), value)


def read_colormaps(spark: SparkSession, path, colormap_id: str | None = None) -> DataFrame:
    """Colormap files to ``(colormap_id, pos, rgb_key, lo, hi, units)``.

    Visible entries only. A range open on one side takes its finite end; a single
    number is a range of width zero. Files are named after the colormap unless the
    directories carry a ``colormap_id=`` partition.
    """
    raw = spark.read.format("xml").option("rowTag", "ColorMapEntry").schema(ENTRY).load(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "")
    own = F.col(colormap_id) if colormap_id else name
    entries = numbered(raw.select(own.alias("colormap_id"), "_rgb", "_transparent", "_value", "_metadata"), "pos")

    inner = F.regexp_replace(F.trim("_value"), r"^[\[(]|[\])]$", "")
    sides = F.split(inner, ",")
    lo, hi = _bound(F.get(sides, F.lit(0))), _bound(F.coalesce(F.get(sides, F.lit(1)), F.get(sides, F.lit(0))))
    rgb = F.split("_rgb", ",")
    channel = [F.get(rgb, F.lit(i)).try_cast("int") for i in range(3)]
    parsed = entries.filter(F.col("_transparent") == "false").select(
        "colormap_id", "pos", pack_rgb(*channel).alias("rgb_key"),
        F.coalesce(lo, hi).alias("lo"), F.coalesce(hi, lo).alias("hi"),
    )
    units = _units(spark, path, colormap_id)
    return parsed.filter(F.col("lo").isNotNull() & F.col("rgb_key").isNotNull()).join(units, "colormap_id", "left")


def _units(spark: SparkSession, path, colormap_id: str | None) -> DataFrame:
    """Units per colormap: the first ``units`` attribute of the file."""
    files = spark.read.option("wholetext", True).text(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "")
    own = F.col(colormap_id) if colormap_id else name
    found = files.select(own.alias("colormap_id"), F.regexp_extract("value", r'units="([^"]+)"', 1).alias("units"))
    return found.groupBy("colormap_id").agg(F.max("units").alias("units"))


def read_tiles(spark: SparkSession, path) -> DataFrame:
    """Tile images to pixel rows ``(partition columns, px, py, r, g, b, a)``.

    Partition columns such as layer, date, z, x and y come from the directory names,
    so a filter on them skips files. Unreadable files are dropped. Decoded bytes
    arrive blue first; images without an alpha channel are opaque. Pixels are listed by
    number and their bytes read in compiled code, which passes the image on by reference.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    keys = [c for c in images.columns if c != "image"]
    width, channels, data = F.col("image.width"), F.col("image.nChannels"), F.col("image.data")
    cut = images.select(
        *keys, width.alias("_w"), channels.alias("_c"), data.alias("_data"),
        F.explode(F.sequence(F.lit(0), width * F.col("image.height") - 1)).alias("_i"),
    )
    at = F.substring("_data", F.col("_i") * F.col("_c") + 1, F.col("_c"))
    # Up to four bytes as one number, the first of them highest.
    px, py = (F.col("_i") % F.col("_w")).alias("px"), F.expr("CAST(_i div _w AS INT)").alias("py")
    pixel = cut.select(*keys, px, py, "_c", F.conv(F.hex(at), 16, 10).cast("long").alias("_p"))
    byte = lambda k: F.shiftright("_p", 8 * k).bitwiseAND(F.lit(255)).cast("int")
    deep, grey = F.col("_c") == 4, F.col("_c") == 1
    return pixel.select(
        *keys, "px", "py",
        F.when(deep, byte(1)).otherwise(byte(0)).alias("r"),
        F.when(deep, byte(2)).when(grey, byte(0)).otherwise(byte(1)).alias("g"),
        F.when(deep, byte(3)).when(grey, byte(0)).otherwise(byte(2)).alias("b"),
        F.when(deep, byte(0)).otherwise(F.lit(255)).alias("a"),
    )
