"""Colours to values and values to colours through a colormap table.

A colormap is a table ``(colormap_id, pos, rgb_key, lo, hi)``: ``rgb_key`` is the
packed colour and ``pos`` the order in the source file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import pack_rgb
from ..plans.joins import BROADCAST_ROWS, lookup_join, placed, within

# Bins make at most twice as many intervals, listed under at most 14 buckets per bin.
FORWARD_ROWS = BROADCAST_ROWS // 14


def unpack(rgb_key: Column) -> list[Column]:
    """Packed colour to red, green and blue."""
    shifts = (("r", 65536), ("g", 256), ("b", 1))
    return [(F.floor(rgb_key / F.lit(s)) % 256).cast("int").alias(n) for n, s in shifts]


def value_table(colormap: DataFrame) -> DataFrame:
    """One value per colour, the bin middle. A colour used twice takes its highest bin."""
    middle = (F.col("lo") + F.col("hi")) / 2
    return colormap.groupBy("colormap_id", "rgb_key").agg(
        F.max_by(middle, F.struct("lo", "pos")).alias("value")
    )


def invert(pixels: DataFrame, colormap: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels ``(colormap_id, r, g, b, a, ...)`` to values; transparent pixels and
    colours outside the table are missing and dropped, the latter only by an inner join."""
    opaque = pixels.filter(F.col("a") != 0).withColumn("rgb_key", pack_rgb("r", "g", "b"))
    on = ["colormap_id", "rgb_key"]
    if within(colormap):
        return opaque.join(F.broadcast(value_table(colormap)), on, how)
    return lookup_join(opaque, value_table(colormap), on, how)


def _search_end(n, gap):
    """Where halving an index range [0, n-1] ends for a value in the gap after bin ``gap``.

    A probe above the gap keeps the part below it, any other keeps the part above it;
    each step at least halves the range, so 32 steps end every search.
    """

    def step(state, _):
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        above = middle > gap
        narrowed = F.struct(
            F.when(above, state["lo"]).otherwise(middle + 1).alias("lo"),
            F.when(above, middle - 1).otherwise(state["hi"]).alias("hi"),
        )
        return F.when(state["lo"] < state["hi"], narrowed).otherwise(state)

    whole = F.struct(F.lit(0).alias("lo"), (n - 1).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), whole, step, lambda s: s["lo"])


def intervals(colormap: DataFrame) -> DataFrame:
    """Half-open value intervals covering the colormap's range, each with its colour.

    Bins keep their own colour; a gap between bins takes the colour of the bin at
    which a binary search over the sorted bins stops. One colormap has at most a
    few hundred bins, so the window per colormap is small.
    """
    by_lo = Window.partitionBy("colormap_id").orderBy("lo", "pos")
    whole = Window.partitionBy("colormap_id")
    bins = colormap.select(
        "colormap_id", "rgb_key", "lo", "hi",
        (F.row_number().over(by_lo) - 1).alias("k"),
        F.lead("lo").over(by_lo).alias("next_lo"),
        F.count(F.lit(1)).over(whole).cast("int").alias("bins"),
        F.first("lo").over(by_lo).alias("floor"),
        F.last("hi").over(by_lo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("ceiling"),
    )
    # Should bins overlap, the later one holds from its start on, so intervals never do.
    until = F.least("hi", F.coalesce("next_lo", "hi"))
    own = bins.filter(until > F.col("lo")).select(
        "colormap_id", F.col("k").alias("colour_of"), F.col("lo").alias("from"), until.alias("to")
    )
    gaps = bins.filter(F.col("next_lo") > F.col("hi")).select(
        "colormap_id", _search_end(F.col("bins"), F.col("k")).alias("colour_of"),
        F.col("hi").alias("from"), F.col("next_lo").alias("to"),
    )
    colours = bins.select(
        "colormap_id", F.col("k").alias("colour_of"), "rgb_key", "bins", "floor", "ceiling"
    )
    return own.unionByName(gaps).join(colours, ["colormap_id", "colour_of"]).drop("colour_of")


def forward(values: DataFrame, colormap: DataFrame, value: str = "value", one_map: bool = False) -> DataFrame:
    """Rows ``(colormap_id, value, ...)`` plus ``rgb_key``; with ``one_map`` the table holds
    a single colormap and rows need no ``colormap_id``. Without a colormap the colour is null.

    Values at or below the first bin take its colour, values at or above the end of
    the last bin take that one's. In between, the range of each colormap is cut into
    equal buckets; each interval is listed under every bucket it touches and the
    lookup is an equi-join on the bucket with the interval test as a residual.
    """
    # Every table below has at most a small multiple of the colormap's rows.
    small = within(colormap, FORWARD_ROWS)
    span = intervals(colormap)
    width = (F.col("ceiling") - F.col("floor")) / (F.col("bins") * 4)

    def bucket(x):
        last = (F.col("bins") * 4 - 1).cast("long")
        raw = F.floor((x - F.col("floor")) / F.when(width > 0, width)).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(last, raw))

    # A bucket edge may round either way, so an interval is listed one bucket wider.
    touched = F.sequence(
        F.greatest(F.lit(0).cast("long"), bucket(F.col("from")) - 1), bucket(F.col("to")) + 1
    )
    listed = span.filter(width > 0).select("colormap_id", "from", "to", "rgb_key", F.explode(touched).alias("bucket"))

    by_lo = F.struct("lo", "pos")
    ends = colormap.groupBy("colormap_id").agg(
        F.count(F.lit(1)).cast("int").alias("bins"),
        F.min("lo").alias("floor"),
        F.max_by("hi", by_lo).alias("ceiling"),
        F.min_by("rgb_key", by_lo).alias("first_rgb"),
        F.max_by("rgb_key", by_lo).alias("last_rgb"),
    )
    if one_map:
        fields = ["bins", "floor", "ceiling", "first_rgb", "last_rgb"]
        row = ends.select(F.struct(*fields)).scalar()
        with_ends = values.withColumn("_ends", row).select(*values.columns, "_ends.*")
    else:
        # One row per colormap: broadcast whatever the number of bins, unless maps are many too.
        bound = FORWARD_ROWS if small else None
        with_ends = lookup_join(values, ends, ["colormap_id"], "left", bound)
    beyond = F.when(F.col(value) <= F.col("floor"), F.col("first_rgb")).when(
        F.col(value) >= F.col("ceiling"), F.col("last_rgb")
    )
    bucketed = with_ends.withColumn("end_rgb", beyond).withColumn(
        "bucket", F.when(F.col("end_rgb").isNull(), bucket(F.col(value)))
    )
    if not small and not one_map:
        # One row per bucket with its few intervals: a plain lookup, which splits hot buckets off.
        spans = listed.groupBy("colormap_id", "bucket").agg(F.collect_list(F.struct("from", "to", "rgb_key")).alias("_spans"))
        found = lookup_join(bucketed, spans, ["colormap_id", "bucket"], "left")
        hits = F.filter("_spans", lambda s: (F.col(value) >= s["from"]) & (F.col(value) < s["to"]))
        return found.select(*values.columns, F.coalesce("end_rgb", F.get(hits, F.lit(0))["rgb_key"]).alias("rgb_key"))
    v, s = bucketed.alias("v"), placed(listed, small).alias("s")
    match = (
        (F.col("v.bucket") == F.col("s.bucket"))
        & (F.col(f"v.{value}") >= F.col("s.from"))
        & (F.col(f"v.{value}") < F.col("s.to"))
    )
    if not one_map:
        match = (F.col("v.colormap_id") == F.col("s.colormap_id")) & match
    return v.join(s, match, "left").select(
        *[F.col(f"v.{c}") for c in values.columns], F.coalesce("v.end_rgb", "s.rgb_key").alias("rgb_key")
    )
