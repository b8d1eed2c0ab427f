"""JSON documents: pages, positional rows, parallel arrays, grids, features, taxonomies, catalogs.

One document is one row until it is exploded. ``lines=True`` reads one document
per line, which splits across tasks; the default reads one document per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null
from ..operators.points import first_quantity

ASSET_PAGES = (
    "assets array<struct<Name:string,Country:string,Sector:string,Centroid:struct<Geometry:array<double>>,"
    "EmissionsSummary:array<struct<Gas:string,EmissionsQuantity:double>>>>"
)
ROW_TABLE = "table struct<rows:array<array<string>>>"
GRID = (
    "id string, title string, units string, source string, citation string, doc string, ramp string, snapshot string, "
    "vmin double, vmax double, west double, south double, east double, north double, dlon double, dlat double, "
    "nx int, ny int, iy long, values array<double>"
)
FEATURES = (
    "features array<struct<properties:struct<name:string,type:string,url:string,description:string>,"
    "geometry:struct<type:string,coordinates:array<double>>>>"
)
TAXONOMY = (
    "source string, snapshot string, total long, unplaced long, note string, "
    "categories array<struct<label:string,items:array<struct<key:long,name:string,records:long>>>>, "
    "species array<struct<key:long,common:string,records:long,note:string>>"
)
CATALOG = (
    "record_count int, records array<struct<id:string,name:string,domain:string,subdomain:string,provider:string,"
    "url:string,access:string,license:string,variables:string,temporal:string,notes:string,globe:boolean,amoc:boolean>>"
)


def read_documents(spark: SparkSession, path, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_asset_pages(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Facility pages to one row per facility; incomplete ones are kept with nulls."""
    asset = read_documents(spark, path, ASSET_PAGES, lines).select(F.explode("assets").alias("a"))
    place = F.col("a.Centroid.Geometry")
    return asset.select(
        F.get(place, F.lit(0)).alias("lon"),
        F.get(place, F.lit(1)).alias("lat"),
        first_quantity("a.EmissionsSummary").alias("q"),
        F.coalesce("a.Name", F.lit("")).alias("name"),
        F.coalesce("a.Country", F.lit("")).alias("country"),
        F.coalesce("a.Sector", F.lit("")).alias("sector"),
    )


def named(row: Column, fields: dict[str, str]) -> list[Column]:
    """Positional text values to typed, named columns; bad values become null."""
    return [F.get(row, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())]


def read_row_table(spark: SparkSession, path, fields: dict[str, str], lines: bool = False) -> DataFrame:
    """``{"table": {"rows": [[...], ...]}}``"""
    rows = read_documents(spark, path, ROW_TABLE, lines).select(F.explode("table.rows").alias("r"))
    return rows.select(*named(F.col("r"), fields))


def read_positional(spark: SparkSession, path, field: str, fields: dict[str, str], lines: bool = False) -> DataFrame:
    """``{<field>: [[...], ...]}``: snapshots of point layers."""
    rows = read_documents(spark, path, f"`{field}` array<array<string>>", lines).select(F.explode(field).alias("r"))
    return rows.select(*named(F.col("r"), fields))


def read_parallel(
    spark: SparkSession, path, arrays: dict[str, str], inside: str | None = None, scalars: dict[str, str] | None = None, lines: bool = False, position: str = "position"
) -> DataFrame:
    """Equally long arrays, one per column, to rows. ``inside`` names the object that
    holds the arrays; ``scalars`` are copied to every row. ``position`` is the place in
    the arrays, which orders samples of equal time."""
    scalars = scalars or {}
    listed = ", ".join(f"`{n}` array<{t}>" for n, t in arrays.items())
    nested = ",".join(f"`{n}`:array<{t}>" for n, t in arrays.items())
    schema = [f"`{n}` {t}" for n, t in scalars.items()]
    schema.append(f"`{inside}` struct<{nested}>" if inside else listed)
    docs = read_documents(spark, path, ", ".join(schema), lines)
    prefix = f"{inside}." if inside else ""
    zipped = F.arrays_zip(*[F.col(f"{prefix}{n}").alias(n) for n in arrays])
    rows = docs.select(*scalars, F.posexplode(zipped).alias(position, "_z"))
    doubles = {n for n, t in arrays.items() if t == "double"}
    return rows.select(
        *scalars, position, *[(nan_to_null(F.col("_z")[n]) if n in doubles else F.col("_z")[n]).alias(n) for n in arrays]
    )


def read_components(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """``{"years": [...], "components": {name: [...]}}`` to ``(year, component, value)``."""
    docs = read_documents(spark, path, "years array<int>, components map<string,array<double>>", lines)
    each = docs.select("years", F.explode("components").alias("component", "series"))
    zipped = F.arrays_zip(F.col("years").alias("year"), F.col("series").alias("value"))
    return each.select("component", F.explode(zipped).alias("z")).select("z.year", "component", "z.value")


def read_grid(spark: SparkSession, path, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Grid documents: metadata rows, and filled cells ``(id, ix, iy, value)``.

    A document holds a whole grid or, with ``iy``, one row of it.
    """
    docs = read_documents(spark, path, GRID, lines)
    cells = docs.select("id", "nx", "iy", F.posexplode("values").alias("pos", "value")).filter(F.col("value").isNotNull())
    return docs.drop("values", "iy").distinct(), cells.select(
        "id",
        (F.col("pos") % F.col("nx")).cast("long").alias("ix"),
        F.coalesce("iy", F.floor(F.col("pos") / F.col("nx"))).cast("long").alias("iy"),
        "value",
    )


def read_features(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """GeoJSON point features."""
    feature = read_documents(spark, path, FEATURES, lines).select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    return feature.select("f.properties.*", F.get(place, F.lit(0)).alias("lon"), F.get(place, F.lit(1)).alias("lat"))


def read_taxonomy(spark: SparkSession, path, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals; group items ``(label, key, name, records)``; and the lookup by key, where
    an indicator species replaces a group of the same key and later groups earlier ones."""
    docs = read_documents(spark, path, TAXONOMY, lines)
    group = docs.select(F.posexplode("categories").alias("c", "g"))
    item = group.select("c", "g.label", F.posexplode("g.items").alias("i", "t"))
    items = item.select("c", "i", "label", "t.key", "t.name", "t.records")
    species = docs.select(F.posexplode("species").alias("i", "s")).select(
        F.lit(1 << 30).alias("c"), "i", F.lit("indicator").alias("label"), "s.key",
        F.col("s.common").alias("name"), "s.records", "s.note",
    )
    every = items.withColumn("note", F.lit(None).cast("string")).unionByName(species)
    last = F.max_by(F.struct("name", "records", "note"), F.struct("c", "i"))
    lookup = every.groupBy("key").agg(last.alias("t")).select("key", "t.*")
    return docs.select("total", "unplaced", "note"), items.drop("c", "i"), lookup


def read_catalog(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Catalog records with their position in the document."""
    docs = read_documents(spark, path, CATALOG, lines)
    return docs.select(F.posexplode("records").alias("position", "r")).select("position", "r.*")
