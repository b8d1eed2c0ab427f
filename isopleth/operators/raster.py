"""Tile pixels to painted views: window means, differences and ensembles.

Pixels are rows ``(layer, date, z, x, y, px, py, r, g, b, a)``, best stored
partitioned by layer and date; a layer's colormap carries the layer's name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour, dates
from ..plans import layers as ly
from ..plans.joins import settled
from . import colormap as cm
from .ensemble import ensemble

PIXEL = ["z", "x", "y", "px", "py"]


def sample_table(
    rules: DataFrame, end: dt.date, days: float, years: int, latest: dt.date, max_samples: int | None = None
) -> DataFrame:
    """Dates to read per layer and side ``(layer, side, date)``; a few rows per layer.

    Monthly layers snap to published months, and months met twice count once. Layers that
    the date selector doesn't change have their fixed date, on the side of now.
    """
    sides = {"now": end}
    if years:
        sides["past"] = dates.compare_date_value(end, years)
    listed = [
        F.struct(F.lit(side).alias("side"), dates.window_sample_dates(F.lit(at), days, max_samples).alias("dates"))
        for side, at in sides.items()
    ]
    each = rules.select("id", "timed", "monthly", "fixed_time", F.explode(F.array(*listed)).alias("s"))
    each = each.filter(F.col("timed") | (F.col("s.side") == "now"))
    day = each.select("id", "timed", "monthly", "fixed_time", "s.side", F.explode("s.dates").alias("date"))
    snapped = (
        F.when(~F.col("timed"), F.col("fixed_time"))
        .when(F.col("monthly"), dates.month_snap("date", F.lit(latest)))
        .otherwise(F.col("date"))
    )
    return day.select(F.col("id").alias("layer"), "side", snapped.alias("date")).distinct()


def view(
    pixels: DataFrame,
    colormaps: DataFrame,
    layers: DataFrame,
    end: dt.date,
    days: float = 1,
    years: int = 0,
    mode: str = "split",
    latest: dt.date | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """Every tiled layer as it is shown under the given controls.

    ``(layer, display, side, z, x, y, px, py, value, n, r, g, b, a)``. Differenceable
    layers in difference mode give the mean of the window minus that of the same window
    ``years`` earlier, where both have data. Averageable layers give their window mean, on
    one side or side by side. All others give their visible pixels as they are, with a
    value where their colour has one: single days, true colour, fixed composites. Layers
    that may not be averaged are left out while a window is active. Runs jobs: the registry
    is read and the colormaps are written once.
    """
    comparing = years > 0
    latest = latest or end
    ends = [end, dates.compare_date_value(end, years)] if comparing else [end]
    rules = ly.with_posture(layers, days, comparing, mode).filter(
        ~F.col("display").isin("suppressed", "grid") & (F.col("timed") | F.col("fixed_time").isNotNull())
    )
    # Every layer and date that can be asked for, as plain values: partitions are pruned
    # before the join. The registry has a fixed handful of layers.
    known = rules.select("id", "timed", "fixed_time").collect()
    asked = {
        d for at in ends for monthly in (False, True)
        for d in dates.sample_date_values(at, days, max_samples, monthly, latest)
    } | {r["fixed_time"] for r in known if not r["timed"]}
    here = F.col("layer").isin(sorted(r["id"] for r in known)) & F.col("date").isin(sorted(asked))
    shown = rules.select(F.col("id").alias("layer"), "display", "delta_range")
    both_sides = comparing and mode == "split"
    is_delta, raw = F.col("display") == "delta", F.col("display") == "raw"
    # At most two sides of samples for each layer.
    samples = sample_table(rules, end, days, years, latest, max_samples).join(F.broadcast(shown), "layer")
    wanted = F.broadcast(samples.filter((F.col("side") == "now") | is_delta | F.lit(both_sides)))
    seen = pixels.filter(here & (F.col("a") != 0)).join(wanted, ["layer", "date"]).withColumn("colormap_id", F.col("layer"))
    colormaps = settled(colormaps, "colormaps")
    as_they_are = _raw(seen.filter(raw), colormaps)

    values = cm.invert(seen.filter(~raw).drop("display", "delta_range"), colormaps)
    now, past = F.col("side") == "now", F.col("side") == "past"
    fields = values.groupBy("layer", *PIXEL).agg(
        F.avg(F.when(now, F.col("value"))).alias("now"),
        F.avg(F.when(past, F.col("value"))).alias("past"),
        F.count_if(now).alias("n_now"),
        F.count_if(past).alias("n_past"),
    )
    side = lambda name: F.struct(
        F.lit(name).alias("side"), F.col(name).alias("value"), F.col(f"n_{name}").alias("n")
    )
    change = F.struct(
        F.lit("change").alias("side"), (F.col("now") - F.col("past")).alias("value"), F.least("n_now", "n_past").alias("n")
    )
    out = F.when(is_delta, F.array(change)).otherwise(F.array(*[side(s) for s in (("now", "past") if both_sides else ("now",))]))
    rows = (
        fields.join(F.broadcast(shown), "layer")
        .withColumn("s", F.explode(out))
        .select("layer", "display", "delta_range", *PIXEL, "s.*")
        .filter(F.col("value").isNotNull())
    )
    return _painted(rows, colormaps).unionByName(as_they_are)


def _raw(seen: DataFrame, colormaps: DataFrame) -> DataFrame:
    """Pixels in the colours they have; the value is missing where a colour has none."""
    looked = cm.invert(seen, colormaps, how="left")
    channels = [F.col(c).cast("int").alias(c) for c in ("r", "g", "b", "a")]
    return looked.select("layer", "display", "side", *PIXEL, "value", F.lit(1).cast("long").alias("n"), *channels)


def _painted(rows: DataFrame, colormaps: DataFrame) -> DataFrame:
    """Differences on the two-sided scale, means through the layer's own colours."""
    looked = cm.forward(rows.withColumn("colormap_id", F.col("layer")), colormaps)
    is_delta = F.col("display") == "delta"
    rgb = F.struct(*cm.unpack(F.col("rgb_key")))
    delta = colour.delta_colour("value", F.col("delta_range"))
    pick = lambda k, own: F.when(is_delta, delta[k]).otherwise(own).alias(k)
    return looked.select(
        "layer", "display", "side", *PIXEL, "value", "n",
        pick("r", rgb["r"]), pick("g", rgb["g"]), pick("b", rgb["b"]), pick("a", F.lit(colour.MEAN_ALPHA)),
    )


def ensemble_view(
    pixels: DataFrame, colormap: DataFrame, members: list[str], date: dt.date, mode: str = "mean"
) -> DataFrame:
    """Mean or spread of the member layers on one date, painted; members share one colormap."""
    one = colormap.select(F.lit("members").alias("colormap_id"), "pos", "rgb_key", "lo", "hi")  # one map for all
    day = pixels.filter((F.col("date") == F.lit(date)) & F.col("layer").isin(members))
    values = cm.invert(day.withColumn("colormap_id", F.lit("members")), one)
    fields = ensemble(values, PIXEL, members, "value", "layer")
    if mode == "spread":
        painted = fields.withColumn("c", colour.spread_colour("spread"))
        return painted.select(*PIXEL, F.col("spread").alias("value"), "n_members", "c.*")
    looked = cm.forward(fields.select(*PIXEL, F.col("mean").alias("value"), "n_members"), one, one_map=True)
    return looked.select(*PIXEL, "value", "n_members", *cm.unpack(F.col("rgb_key")), F.lit(colour.MEAN_ALPHA).alias("a"))
