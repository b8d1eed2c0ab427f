"""Readers and writers in a round trip: whole tables are written in each landed format
by Spark, to the shared scratch folder, and read back through the library's readers.

Documents hold pages of at most 250 rows, as the landed files do, so no group grows
with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.missing import rounded
from ..operators import grid as g
from ..operators import points as p
from ..operators import quality as q
from ..session import scratch_path
from ..sources import documents, raster, sinks, tables
from .base import d, observations, query, table, with_obs
from .grids import DENSE_SQL, EMB_CELLS, FINE
from .points import ASSETS_SQL

PAGE = 250


def paged(df, key: str):
    return df.groupBy(F.floor(F.col(key) / F.lit(PAGE)).alias("page"))


@query(f"""
WITH {ASSETS_SQL}
SELECT lon, lat, round(q / {d(1e6)}, 3) AS mt_co2e, name, country, sector FROM kept
""")
def source_asset_pages(spark, sf_dir):
    k = F.col("p_partkey")
    gas = lambda name, qty: F.struct(F.lit(name).alias("Gas"), qty.cast("double").alias("EmissionsQuantity"))
    lon = F.when(F.col("p_brand") != "Brand#13", F.round(((k * 7919) % 36000).cast("double") / F.lit(100.0) - 180.0, 4))
    lat = F.round(((k * 104729) % 18000).cast("double") / F.lit(100.0) - 90.0, 4)
    place = F.when(lon.isNotNull(), F.struct(F.array(lon, lat).alias("Geometry")))
    main = F.when(F.col("p_type") != "SMALL", gas("co2e_100yr", F.col("p_retailprice") * 1000)).otherwise(gas("n2o", F.lit(1)))
    one = F.struct(
        F.col("p_name").alias("Name"), F.col("p_brand").alias("Country"), F.col("p_type").alias("Sector"),
        place.alias("Centroid"), F.array(gas("ch4", F.col("p_size")), main).alias("EmissionsSummary"),
    )
    path = scratch_path(spark, "asset-pages")
    paged(table(spark, sf_dir, "part"), "p_partkey").agg(F.collect_list(one).alias("assets")).write.json(path)
    read = p.complete(documents.read_asset_pages(spark, path, lines=True), "lon", "lat", "q")
    return read.select(
        "lon", "lat", rounded(F.col("q") / p.TONNES_PER_MEGATONNE, 3).alias("mt_co2e"), "name", "country", "sector"
    )


@query(
    with_obs("""SELECT platform, lat, lon, ts FROM (
  SELECT platform, CASE WHEN member <> 'error' THEN lat END AS lat, lon, ts FROM obs) WHERE lat IS NOT NULL""")
)
def source_row_table(spark, sf_dir):
    lat = F.when(F.col("member") != "error", F.col("lat")).cast("string")
    row = F.array(F.col("platform").cast("string"), lat, F.col("lon").cast("string"), F.col("ts").cast("string"))
    path = scratch_path(spark, "row-table")
    pages = paged(observations(spark, sf_dir), "event_id").agg(F.struct(F.collect_list(row).alias("rows")).alias("table"))
    pages.write.option("ignoreNullFields", False).json(path)
    fields = {"platform": "bigint", "lat": "double", "lon": "double", "ts": "timestamp_ntz"}
    read = documents.read_row_table(spark, path, fields, lines=True)
    return p.complete(read, "lat", "lon")


@query("SELECT s_suppkey, s_acctbal AS mt, s_name AS name, CAST(NULL AS DATE) AS date FROM supplier")
def source_positional(spark, sf_dir):
    """Positional snapshot rows; text in a numeric or date place reads as missing."""
    row = F.array(F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"), "s_name", F.lit("soon"))
    path = scratch_path(spark, "positional")
    paged(table(spark, sf_dir, "supplier"), "s_suppkey").agg(F.collect_list(row).alias("assets")).write.json(path)
    fields = {"s_suppkey": "bigint", "mt": "double", "name": "string", "date": "date"}
    return documents.read_positional(spark, path, "assets", fields, lines=True)


@query(
    with_obs("""SELECT event_id AS i, CAST(ts AS DATE) AS t, v, 'Sv' AS units FROM obs""")
)
def source_parallel(spark, sf_dir):
    path = scratch_path(spark, "parallel")
    columns = {"i": F.col("event_id"), "t": F.col("day"), "v": F.col("v")}
    packed = F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in columns.items()])))
    docs = paged(observations(spark, sf_dir), "event_id").agg(packed.alias("z"))
    docs.select(F.lit("Sv").alias("units"), *[F.col(f"z.{k}").alias(k) for k in columns]).write.json(path)
    arrays = {"i": "bigint", "t": "date", "v": "double"}
    return documents.read_parallel(spark, path, arrays, scalars={"units": "string"}, lines=True).drop("position")


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS component, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS value
FROM orders GROUP BY ALL
""")
def source_components(spark, sf_dir):
    """Aligned component series in one map; as many values as years and components."""
    yearly = table(spark, sf_dir, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("component")
    ).agg(rounded(F.sum(F.round(F.col("o_totalprice") * 100)) / 100, 2).alias("value"))
    each = yearly.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("z"))
    one = each.groupBy(F.col("z.year").alias("years")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("component"), F.col("z.value")))).alias("components")
    )
    path = scratch_path(spark, "components")
    one.write.json(path)
    return documents.read_components(spark, path, lines=True)


@query(f"WITH {EMB_CELLS} SELECT CAST(grid_id AS VARCHAR) AS id, ix, iy, value FROM cells JOIN embeddings ON vec_id = grid_id WHERE label <> 3 OR ix <> iy")
def source_grid(spark, sf_dir):
    """Grid documents, one per vector, with an empty diagonal under one label."""
    e = table(spark, sf_dir, "embeddings")
    holed = F.transform("embedding", lambda x, i: F.when((F.col("label") != 3) | (i % 9 != 0), x.cast("double")))
    docs = e.select(F.col("vec_id").cast("string").alias("id"), F.lit(8).alias("nx"), F.lit(8).alias("ny"), holed.alias("values"))
    path = scratch_path(spark, "grid")
    docs.write.json(path)
    return documents.read_grid(spark, path, lines=True)[1]


@query("""
SELECT s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'AMOC array' END AS type, CAST(s_suppkey % 180 AS DOUBLE) AS lon, CAST(s_suppkey % 90 AS DOUBLE) AS lat,
       CASE WHEN s_acctbal > 5000 THEN 'array' ELSE 'other' END AS class FROM supplier
""")
def source_features(spark, sf_dir):
    from ..functions.text import station_class

    k = F.col("s_suppkey")
    properties = F.struct(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 5000, F.lit("AMOC array")).alias("type"))
    place = F.struct(F.lit("Point").alias("type"), F.array((k % 180).cast("double"), (k % 90).cast("double")).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), place.alias("geometry"))
    path = scratch_path(spark, "features")
    paged(table(spark, sf_dir, "supplier"), "s_suppkey").agg(F.collect_list(one).alias("features")).write.json(path)
    read = documents.read_features(spark, path, lines=True)
    return read.select("name", "type", "lon", "lat", station_class("type").alias("class"))


@query("""
WITH counts AS (SELECT c_nationkey AS key, count(*) AS records FROM customer GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS name, records,
       CASE WHEN n_regionkey = 0 THEN 'note ' || n_name END AS note
FROM nation JOIN counts ON counts.key = n_nationkey
""")
def source_taxonomy(spark, sf_dir):
    """Nations in region groups with customer counts; those of one region are also indicators."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("records")
    )
    nations = table(spark, sf_dir, "nation").join(counts, "n_nationkey").withColumn("key", F.col("n_nationkey").cast("long"))
    item = F.struct("key", F.col("n_name").alias("name"), "records")
    groups = nations.groupBy(F.col("n_regionkey").cast("string").alias("label")).agg(F.collect_list(item).alias("items"))
    special = F.when(F.col("n_regionkey") == 0, F.struct(
        "key", F.lower("n_name").alias("common"), "records", F.concat(F.lit("note "), "n_name").alias("note")
    ))
    species = nations.agg(F.collect_list(special).alias("species")).scalar()
    doc = groups.agg(F.collect_list(F.struct("label", "items")).alias("categories")).withColumn("species", species)
    path = scratch_path(spark, "taxonomy")
    doc.write.json(path)
    return documents.read_taxonomy(spark, path, lines=True)[2]


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 250 AS INTEGER) AS position, lang AS domain, source AS provider, text AS notes FROM documents")
def source_catalog(spark, sf_dir):
    record = F.struct(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("domain"),
        F.col("source").alias("provider"), F.col("text").alias("notes"),
    )
    packed = F.array_sort(F.collect_list(record))
    docs = paged(table(spark, sf_dir, "documents"), "doc_id").agg(packed.alias("records"))
    path = scratch_path(spark, "catalog")
    docs.select(F.size("records").alias("record_count"), "records").write.json(path)
    return documents.read_catalog(spark, path, lines=True).select("id", "position", "domain", "provider", "notes")


@query("""
SELECT CAST(l_orderkey AS INTEGER) AS year, round(l_extendedprice, 1) AS observed, round(l_quantity, 1) AS "sum", round(l_tax, 1) AS steric,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_discount, 1) END AS glaciers FROM lineitem
""")
def source_budget_sheet(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    at = {0: F.col("l_orderkey").cast("double"), 2: F.col("l_extendedprice"), 5: F.col("l_quantity"), 8: F.col("l_tax"),
          11: F.when(F.col("l_linenumber") != 3, F.col("l_discount"))}
    cells = [F.coalesce(at[i].cast("string"), F.lit("")) if i in at else F.lit("x") for i in range(21)]
    header = table(spark, sf_dir, "region").select(F.concat_ws(",", F.lit("year"), F.col("r_name")).alias("value"))
    path = scratch_path(spark, "sheet")
    line.select(F.concat_ws(",", *cells).alias("value")).unionByName(header).write.text(path)
    return tables.read_budget_sheet(spark, path).select("year", "observed", "sum", "steric", "glaciers")


@query(f"""
SELECT round(1990 + CAST(o_orderkey AS DOUBLE) / 1000, 3) AS t, round(CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + {d(0.5)} ELSE o_custkey END, 1) AS v
FROM orders WHERE o_orderstatus <> 'P' 
""")
def source_missions(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.col("o_custkey").cast("double").cast("string")
    seen = F.col("o_orderstatus") != "P"
    first = F.when(seen, v).otherwise(F.lit(""))
    third = F.when((F.col("o_orderpriority") == "5-LOW") & seen, (F.col("o_custkey") + 0.5).cast("string")).otherwise(F.lit(" "))
    t = F.round(F.lit(1990) + k.cast("double") / 1000, 3).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(",", t, first, F.lit(""), third).alias("value"))
    notes = table(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit("#"), "r_name"), F.lit("year,a,b,c"), F.lit(""))).alias("value"))
    path = scratch_path(spark, "missions")
    rows.unionByName(notes).write.text(path)
    return tables.read_missions(spark, path).drop("position")


@query("SELECT CAST(o_orderkey AS INTEGER) AS year, round(o_totalprice, 2) AS value FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')")
def source_annual(spark, sf_dir):
    k, urgency = F.col("o_orderkey"), F.col("o_orderpriority")
    mean = (
        F.when(urgency == "1-URGENT", F.lit("***")).when(urgency == "2-HIGH", F.lit("*****")).when(urgency == "3-MEDIUM", F.lit(""))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    cells = [k.cast("string"), *[F.lit("0.1")] * 12, mean, *[F.lit("0.2")] * 5]
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(",", *cells).alias("value"))
    banner = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" Means")).alias("value"))
    path = scratch_path(spark, "annual")
    rows.unionByName(banner).write.text(path)
    return tables.read_annual(spark, path)


@query(f"""
SELECT 'good' AS kind, 'RGI-' || p_partkey AS rgi_id, round(CAST(p_size AS DOUBLE), 3) AS lon, round(p_retailprice / 10, 3) AS area FROM part WHERE p_size <> 8
UNION ALL SELECT 'quarantined', 'RGI-' || p_partkey, NULL, NULL FROM part WHERE p_size = 8
""")
def source_inventory(spark, sf_dir):
    """Attribute files in several folders; rows with a bad number go to quarantine whole."""
    k = F.col("p_partkey")
    out = table(spark, sf_dir, "part").select(
        F.concat(F.lit("RGI-"), k.cast("string")).alias("rgi_id"), F.col("p_size").cast("string").alias("cenlon"), F.lit("1.5").alias("cenlat"),
        F.when(F.col("p_size") != 8, (F.col("p_retailprice") / 10).cast("string")).otherwise(F.lit("n/a")).alias("area_km2"), F.when(F.col("p_size") > 25, F.lit("02")).otherwise(F.lit("01")).alias("region"),
    )
    path = scratch_path(spark, "inventory")
    out.write.option("header", True).partitionBy("region").csv(path)
    good, bad = tables.read_inventory(spark, [f"{path}/region=01", f"{path}/region=02"])
    none = F.lit(None).cast("double")
    kept = good.select(F.lit("good").alias("kind"), "rgi_id", "lon", "area")
    return kept.unionByName(bad.select(F.lit("quarantined").alias("kind"), "rgi_id", none.alias("lon"), none.alias("area")))


@query("""
WITH r AS (SELECT l_partkey AS id, CASE WHEN l_returnflag = 'A' THEN '2000-01-01_2020-01-01' ELSE '2000-01-01_2010-01-01' END AS period, max(l_tax) AS dhdt FROM lineitem GROUP BY ALL)
SELECT id, dhdt FROM r WHERE period = '2000-01-01_2020-01-01'
""")
def source_rates(spark, sf_dir):
    period = F.when(F.col("l_returnflag") == "A", F.lit(tables.RATE_PERIOD)).otherwise(F.lit("2000-01-01_2010-01-01"))
    rates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), period.alias("period")).agg(F.max("l_tax").alias("dhdt"))
    path = scratch_path(spark, "rates")
    rates.write.parquet(path)
    return tables.read_rates(spark, path, key="id")


@query("""
SELECT p_type AS colormap_id, CAST(p_size * 65536 + 10 * 256 + 7 AS BIGINT) AS rgb_key,
       CAST(p_size AS DOUBLE) / 2 AS lo, CASE WHEN p_size = 50 THEN CAST(p_size AS DOUBLE) / 2 WHEN p_size % 7 = 0 THEN CAST(p_size AS DOUBLE) / 2 ELSE CAST(p_size + 1 AS DOUBLE) / 2 END AS hi
FROM (SELECT DISTINCT p_type, p_size FROM part WHERE p_size <> 5)
""")
def source_colormaps(spark, sf_dir):
    """Colormap files by part type: ranges, single values, an open end, a transparent entry."""
    size = F.col("p_size")
    lo = (size.cast("double") / 2).cast("string")
    value = (
        F.when(size == 50, F.concat(F.lit("["), lo, F.lit(",+INF)"))).when(size % 14 == 0, F.concat(F.lit("["), lo, F.lit("]"))).when(size % 7 == 0, lo)
        .otherwise(F.concat(F.lit("["), lo, F.lit(","), ((size + 1).cast("double") / 2).cast("string"), F.lit(")")))
    )
    entries = table(spark, sf_dir, "part").select("p_type", "p_size").distinct().select(
        F.col("p_type").alias("map"), F.concat(size.cast("string"), F.lit(",10,7")).alias("_rgb"),
        F.when(size == 5, F.lit("true")).otherwise(F.lit("false")).alias("_transparent"), value.alias("_value"),
    )
    path = scratch_path(spark, "colormaps")
    entries.write.format("xml").option("rootTag", "ColorMap").option("rowTag", "ColorMapEntry").partitionBy("map").save(path)
    return raster.read_colormaps(spark, path, colormap_id="map").select("colormap_id", "rgb_key", "lo", "hi")


@query("""
SELECT o_custkey % 500 AS cell, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) * CAST(365.25 AS DOUBLE) / 100, 6) AS clim, count(*) AS n
FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) < 2000 GROUP BY 1
""")
def source_cube(spark, sf_dir):
    """A field cube partitioned by dataset and year, read for four years."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 500).alias("cell"), F.col("o_orderdate").alias("time"), F.round(F.col("o_totalprice") * 100).alias("cents")
    )
    path = scratch_path(spark, "cube")
    tables.write_cube(orders, path, "precip", cell=("cell",))
    clim = g.climatology(tables.read_cube(spark, path, "precip", (1996, 2000)), ["cell"], "cents")
    return clim.select("cell", rounded(F.col("clim") / 100, 6).alias("clim"), "n")


@query(
    with_obs(DENSE_SQL + "SELECT ix, iy, value, '2024-01-30' AS snapshot, 'mm/yr' AS units FROM dense")
)
def sink_snapshot(spark, sf_dir):
    dense = g.densify(g.bin_mean(observations(spark, sf_dir), FINE, "v"), FINE, decimals=6)
    path = scratch_path(spark, "snapshot")
    sinks.write_snapshot(dense.select("ix", "iy", "value"), path, "2024-01-30", units="mm/yr")
    data, meta = sinks.read_snapshot(spark, path)
    pick = lambda c: meta.select(c).scalar().alias(c)
    return data.select("*", pick("snapshot"), pick("units"))


@query(with_obs(DENSE_SQL + "SELECT 'obs' AS id, ix, iy, value FROM dense WHERE value IS NOT NULL"))
def sink_grid_document(spark, sf_dir):
    """A dense grid as one JSON document, its geometry checked, read back to cells."""
    dense = g.densify(g.bin_mean(observations(spark, sf_dir), FINE, "v"), FINE)
    path = scratch_path(spark, "grid-document")
    sinks.write_document(sinks.grid_document(dense, FINE, decimals=6, id="obs", units="mm/yr"), path)
    return documents.read_grid(spark, path)[1]


@query(with_obs(DENSE_SQL + "SELECT 'obs' AS id, ix, iy, value FROM dense WHERE value IS NOT NULL"))
def sink_grid_rows(spark, sf_dir):
    """A dense grid as one JSON document per grid row, read back to cells."""
    dense = g.densify(g.bin_mean(observations(spark, sf_dir), FINE, "v"), FINE)
    path = scratch_path(spark, "grid-rows")
    sinks.write_document(sinks.grid_rows(dense, FINE, decimals=6, id="obs", units="mm/yr"), path)
    return documents.read_grid(spark, path, lines=True)[1]


@query(
    with_obs(DENSE_SQL + f""", grids AS (SELECT unnest(['whole', 'short', 'bent', 'twice']) AS id),
listed AS (
  SELECT id, iy, CASE WHEN id = 'twice' AND iy = 0 THEN 2 ELSE 1 END AS times, CASE WHEN id = 'bent' AND iy = 4 THEN {d(FINE.dlon + 0.25)} ELSE {d(FINE.dlon)} END AS dlon
  FROM dense, grids WHERE NOT (id = 'short' AND iy % 50 = 7)
), g AS (SELECT id, CAST(sum(times) AS BIGINT) AS n, max(abs(dlon - {d(FINE.dlon)})) AS off FROM listed GROUP BY id),
f AS (SELECT [0, count(*) FILTER (WHERE off >= 0.0005), 0, count(*) FILTER (WHERE n <> {FINE.cells})] AS seen FROM g)
SELECT 'grid' AS dataset, unnest(['bounds', 'dlon', 'dlat', 'cells']) AS "check", CAST(unnest(seen) AS DOUBLE) AS observed,
       CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high, unnest(seen) = 0 AS passed
FROM f""")
)
def dq_grid(spark, sf_dir):
    """Four grids by rows: one whole, one that lacks rows, one with a row of another step, one with a row twice."""
    dense = g.densify(g.bin_mean(observations(spark, sf_dir), FINE, "v"), FINE)
    iy, ident = F.col("iy"), F.col("id")
    rows = sinks.grid_rows(dense, FINE, decimals=6).withColumn("id", F.explode(F.array(*map(F.lit, ("whole", "short", "bent", "twice")))))
    rows = rows.filter(~((ident == "short") & (iy % 50 == 7))).withColumn("dlon", F.when((ident == "bent") & (iy == 4), F.col("dlon") + 0.25).otherwise(F.col("dlon")))
    again = F.when((ident == "twice") & (iy == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return q.report(q.whole_grids(rows.withColumn("time", F.explode(again)).drop("time")), "grid", q.grid_sums())


@query("""
WITH d AS (
  SELECT max(l_linenumber) AS nx, count(*) AS n,
         CASE WHEN l_orderkey % 11 = 5 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS north,
         CASE WHEN l_orderkey % 7 = 3 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS dlon
  FROM lineitem GROUP BY l_orderkey
), f AS (
  SELECT [count(*) FILTER (WHERE nx <= 0 OR north <= 0), count(*) FILTER (WHERE abs(dlon - nx * CAST(0.5 AS DOUBLE) / nx) >= 0.0005),
          count(*) FILTER (WHERE abs(1 - north) >= 0.0005), count(*) FILTER (WHERE n <> nx)] AS seen
  FROM d
)
SELECT 'grids' AS dataset, unnest(['bounds', 'dlon', 'dlat', 'cells']) AS "check", CAST(unnest(seen) AS DOUBLE) AS observed,
       CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high, unnest(seen) = 0 AS passed
FROM f
""")
def dq_grid_faults(spark, sf_dir):
    """Grid documents of one row each, an order's lines as cells; some with wrong steps, bounds or counts."""
    key = F.col("l_orderkey")
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("nx"), F.collect_list("l_quantity").alias("values")
    )
    docs = docs.select(
        "nx", F.lit(1).alias("ny"), "values", F.lit(0.0).alias("west"), (F.col("nx") * 0.5).alias("east"), F.lit(0.0).alias("south"),
        F.when(key % 11 == 5, 0.0).otherwise(1.0).alias("north"), F.when(key % 7 == 3, 0.6).otherwise(0.5).alias("dlon"), F.lit(1.0).alias("dlat"),
    )
    return q.report(docs, "grids", q.grid_geometry())
