"""The layer registry and the rules that decide which operations a layer allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The layers, in display order. delta_range is the +/- scale of the
# difference view (None: not differenceable); aggregable marks mean-only layers.
LAYER_FIELDS = (
    "id string, timed boolean, monthly boolean, sub_daily boolean, start date, fixed_time date, "
    "delta_range double, aggregable boolean, has_colormap boolean, grid boolean, max_level int, "
    "ramp string, vmin double, vmax double, units string"
)
LAYERS = [
    # id, timed, monthly, sub_daily, start, fixed_time, delta_range, aggregable, has_colormap, grid, max_level, ramp, vmin, vmax, units
    ("viirs-truecolor", True, False, False, "2015-11-24", None, None, False, False, False, 8, None, None, None, None),
    ("sst", True, False, False, "2002-06-01", None, 4.0, False, True, False, 6, None, None, None, None),
    ("sst-anom", True, False, False, "2002-09-01", None, 3.0, False, True, False, 5, None, None, None, None),
    ("precip", True, False, False, "2000-06-01", None, None, False, True, False, 5, None, None, None, None),
    ("precip-30min", True, False, True, "2000-06-01", None, None, False, True, False, 5, None, None, None, None),
    ("seaice", True, False, False, "2012-07-02", None, 50.0, False, True, False, 5, None, None, None, None),
    ("snow", True, False, False, "2000-02-24", None, 50.0, False, True, False, 7, None, None, None, None),
    ("aod", True, False, False, "2017-04-19", None, None, True, True, False, 5, None, None, None, None),
    ("lst", True, False, False, "2022-10-23", None, 10.0, False, True, False, 6, None, None, None, None),
    ("chlor", True, False, False, "2024-02-25", None, None, True, True, False, 6, None, None, None, None),
    ("salinity", True, True, False, "2015-04-01", None, 1.5, False, True, False, 5, None, None, None, None),
    ("gpcp", False, False, False, None, None, None, False, False, True, 6, "precip", 0.0, 3000.0, "mm/yr"),
    ("oisst", False, False, False, None, None, None, False, False, True, 6, "sst", -2.0, 32.0, "°C"),
    ("eobs", False, False, False, None, None, None, False, False, True, 7, "precip", 0.0, 2500.0, "mm/yr"),
    ("meteoswiss", False, False, False, None, None, None, False, False, True, 9, "precip", 0.0, 2500.0, "mm/yr"),
    ("nightlights", False, False, False, None, "2016-01-01", None, False, False, False, 7, None, None, None, None),
]

# Fixed value: the fewest members a pixel of an ensemble needs.
MIN_MEMBERS = 2

# Datasets shown as points, and why the date does not change them.
POINT_LAYERS = {
    "gbif": "all-time",
    "climatetrace": "annual inventory",
    "argo": "latest positions",
    "stations": "fixed sites",
    "glaciers": "single inventory",
}

# Fixed value: finest tile level offered while a window is averaged.
WINDOWED_MAX_LEVEL = 4


def layer_table(spark: SparkSession) -> DataFrame:
    fields = LAYER_FIELDS.replace("start date", "start string").replace("fixed_time date", "fixed_time string")
    return (
        spark.createDataFrame(LAYERS, fields)
        .withColumn("start", F.col("start").cast("date"))
        .withColumn("fixed_time", F.col("fixed_time").cast("date"))
    )


def can_delta() -> Column:
    return F.col("delta_range").isNotNull()


def can_window() -> Column:
    return (can_delta() | F.col("aggregable")) & F.col("has_colormap")


def with_posture(layers: DataFrame, window_days: int = 1, comparing: bool = False, mode: str = "split") -> DataFrame:
    """What each layer may do, and what it shows under the given controls.

    Under a window a timed layer that cannot be averaged is suppressed: one day's
    picture under an averaged label would mislead.
    """
    windowed = F.lit(window_days > 1) & can_window() & F.col("timed")
    suppressed = F.lit(window_days > 1) & F.col("timed") & ~can_window()
    delta = F.lit(comparing and mode == "delta") & F.col("timed") & can_delta()
    display = (
        F.when(suppressed, F.lit("suppressed"))
        .when(F.col("grid"), F.lit("grid"))
        .when(delta, F.lit("delta"))
        .when(windowed, F.lit("mean"))
        .otherwise(F.lit("raw"))
    )
    return (
        layers.withColumn("can_delta", can_delta())
        .withColumn("can_window", can_window())
        .withColumn(
            "posture",
            F.when(can_delta() & can_window(), F.lit("both"))
            .when(can_window(), F.lit("mean only"))
            .otherwise(F.lit("neither")),
        )
        .withColumn("display", display)
        .withColumn("not_differenced", F.lit(comparing and mode == "delta") & F.col("timed") & ~can_delta())
        .withColumn(
            "level_cap", F.when(F.lit(window_days > 1), F.lit(WINDOWED_MAX_LEVEL)).otherwise(F.col("max_level"))
        )
    )


def with_date_rule(layers: DataFrame) -> DataFrame:
    """Does the date selector change the layer, and if not, why."""
    reason = (
        F.when(F.col("timed"), F.lit(None).cast("string"))
        .when(F.col("grid"), F.lit("climatology"))
        .otherwise(F.lit("fixed composite"))
    )
    return layers.withColumn("dateless_reason", reason)


def point_layer_reason(layer_id: Column) -> Column:
    expr = None
    for name, why in POINT_LAYERS.items():
        hit = layer_id == name
        expr = F.when(hit, F.lit(why)) if expr is None else expr.when(hit, F.lit(why))
    return expr


def within_record(obs: DataFrame, layers: DataFrame, day: str = "day", layer: str = "layer") -> DataFrame:
    """Optional predicate: drop observations dated before the layer's first date."""
    starts = layers.select(F.col("id").alias(layer), F.col("start"))
    joined = obs.join(F.broadcast(starts), layer, "left")
    return joined.filter(F.col("start").isNull() | (F.col(day) >= F.col("start"))).drop("start")
