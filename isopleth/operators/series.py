"""Time-series statistics.

Functions that need row order within a series go through ``plans.ordered``; the
others are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import located, wrap_lon
from ..functions.missing import col, finite
from ..plans.joins import lookup_join
from ..plans.ordered import neighbours, ordered, row_numbers, running_sum


def block_mean(
    df: DataFrame, series: list[str], time: str, tiebreak: str | None, values: list[str], step: int = 20
) -> DataFrame:
    """Mean of every ``step`` consecutive samples; missing samples are left out of it.

    A block is dated by its middle sample; the incomplete block at the end is dropped.
    ``tiebreak`` is unique and orders samples of equal time; None where times are unique.
    """
    order = [time] if tiebreak is None else [time, tiebreak]
    numbered = row_numbers(ordered(df.select(*series, *order, *values), series, order))
    at = F.col("rn") - 1
    blocks = numbered.withColumn("block", F.floor(at / F.lit(step)).cast("long")).groupBy(*series, "block")
    label = F.max(F.when(at % step == step // 2, col(time))).alias(time)
    means = [F.avg(F.when(finite(v), col(v))).alias(v) for v in values]
    return blocks.agg(label, *means, F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == step).drop("_n")


def _order(t: str, tiebreak: str | None) -> Column:
    """Sample order: time, and where times repeat the position in the source."""
    return col(t) if tiebreak is None else F.struct(col(t), col(tiebreak))


def _in_years(year: Column, span: tuple[int, int]) -> Column:
    return (year >= span[0]) & (year < span[1])


def period_stats(
    df: DataFrame,
    series: list[str],
    time: str,
    value: str,
    early: tuple[int, int],
    recent: tuple[int, int],
    tiebreak: str | None = None,
) -> DataFrame:
    """Means over two half-open year ranges, their difference, and the latest value with its date."""
    year, v = F.year(time), col(value)
    real = df.filter(finite(value))
    out = real.groupBy(*series).agg(
        F.avg(F.when(_in_years(year, early), v)).alias("early"),
        F.avg(F.when(_in_years(year, recent), v)).alias("recent"),
        F.count_if(_in_years(year, early)).alias("n_early"),
        F.count_if(_in_years(year, recent)).alias("n_recent"),
        F.max_by(v, _order(time, tiebreak)).alias("latest"),
        F.max(time).alias("latest_at"),
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
        F.avg(v).alias("mean"),
    )
    return out.withColumn("change", F.col("recent") - F.col("early"))


def trend(df: DataFrame, series: list[str], t: str, value: str) -> DataFrame:
    """Least-squares slope of value against time."""
    real = df.filter(finite(value) & finite(t))
    return real.groupBy(*series).agg(F.regr_slope(col(value), col(t)).alias("slope"), F.count(F.lit(1)).alias("n"))


def total_change(df: DataFrame, series: list[str], t: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """Last minus first non-missing value. Give ``tiebreak`` where times may repeat."""
    real = df.filter(finite(value))
    at = _order(t, tiebreak)
    out = real.groupBy(*series).agg(
        F.min_by(col(value), at).alias("first"),
        F.max_by(col(value), at).alias("last"),
        F.min(t).alias("first_t"),
        F.max(t).alias("last_t"),
    )
    return out.withColumn("change", F.col("last") - F.col("first"))


def largest_change(changes: DataFrame, component: str, rank: str) -> DataFrame:
    """The component that changed most; of equal changes the lowest ``rank``."""
    return changes.orderBy(F.col("change").desc_nulls_last(), col(rank)).limit(1).select(component, "change")


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Right-hand values on the left-hand times; missing where there is no match."""
    return left.join(right, on, "left")


def rebase(
    df: DataFrame,
    series: list[str],
    t: str,
    value: str,
    from_t: float,
    base: DataFrame,
    base_value: str,
    tiebreak: str | None = None,
) -> DataFrame:
    """Shift each series so that its first sample at or after ``from_t`` meets ``base``.

    A series that ends earlier is shifted by its first sample; a series without a
    base value is shifted to zero. ``base`` has one row per series. Give ``tiebreak``
    where times may repeat.
    """
    after, at = col(t) >= F.lit(from_t), _order(t, tiebreak)
    anchors = df.filter(finite(value)).groupBy(*series).agg(
        F.min_by(col(value), F.when(after, at)).alias("_after"),
        F.min_by(col(value), at).alias("_first"),
    )
    offsets = anchors.join(base.select(*series, col(base_value).alias("_base")), series, "left").select(
        *series, (F.coalesce("_base", F.lit(0.0)) - F.coalesce("_after", "_first")).alias("_shift")
    )
    return lookup_join(df, offsets, series, "left").withColumn(value, col(value) + F.col("_shift")).drop("_shift")


def gap_segments(df: DataFrame, series: list[str], time: str, tiebreak: str | None, value: str) -> DataFrame:
    """Runs of non-missing samples: ``(series, segment, start, end, n)``."""
    missing = F.when(finite(value), F.lit(0)).otherwise(F.lit(1))
    order = [time] if tiebreak is None else [time, tiebreak]
    o = ordered(df.select(*series, *order, value), series, order)
    runs = running_sum(o, missing, "segment").filter(finite(value))
    return runs.groupBy(*series, F.col("segment").cast("long").alias("segment")).agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")
    )


def nearest_sample(
    probes: DataFrame, samples: DataFrame, series: list[str], t: str, probe_id: str, value: str, outside: str = "none"
) -> DataFrame:
    """The sample nearest to each probe time; of two equally near the later one.

    Probe times outside the sampled range have no sample, or with
    ``outside="clamp"`` the first or last one. Sample times are numbers, unique
    within a series.
    """
    sample = F.struct(col(t).alias("t"), col(value).alias("v"))
    left = probes.select(*series, t, col(probe_id), F.lit(None).cast(samples.select(sample.alias("s")).schema[0].dataType).alias("s"))
    right = samples.select(*series, t, F.lit(None).cast(dict(probes.dtypes)[probe_id]).alias(probe_id), sample.alias("s"))
    both = ordered(left.unionByName(right), series, [t, probe_id])
    near = neighbours(both, F.col("s"), "b", "a").filter(col(probe_id).isNotNull())
    # A sample at the probe time sorts before the probe; it is also the next one.
    near = near.withColumn("a", F.when(F.col("b.t") == col(t), F.col("b")).otherwise(F.col("a")))
    back, ahead = col(t) - F.col("b.t"), F.col("a.t") - col(t)
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    pick = F.when(inside, F.when(ahead <= back, F.col("a")).otherwise(F.col("b")))
    if outside == "clamp":
        pick = F.coalesce(pick, F.col("a"), F.col("b"))
    return near.withColumn("_s", pick).select(
        *series, probe_id, t, F.col("_s.t").alias("sample_t"), F.col("_s.v").alias(value)
    )


def monthly(df: DataFrame, series: list[str], time: str, value: str) -> DataFrame:
    """Mean per series and month. Everything built on it has as many rows as months."""
    real = df.filter(finite(value))
    month = F.trunc(time, "MM").alias("month")
    return real.groupBy(*series, month).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def anomaly(df: DataFrame, cell: list[str], time: str, value: str, baseline: tuple[int, int]) -> DataFrame:
    """Monthly means minus the cell's mean for that calendar month over the baseline years.

    Observations are summed to one row per cell and month first; the baseline is a
    window over those rows, of which a calendar month has one per year.
    """
    real = df.filter(finite(value))
    sums = real.groupBy(*cell, F.year(time).alias("year"), F.month(time).alias("month")).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("n")
    )
    base = _in_years(F.col("year"), baseline)
    same_month = Window.partitionBy(*cell, "month")
    clim = F.sum(F.when(base, F.col("_s"))).over(same_month) / F.sum(F.when(base, F.col("n"))).over(same_month)
    return sums.select(
        *cell, "year", "month", "n", (F.col("_s") / F.col("n")).alias("value"), clim.alias("clim")
    ).withColumn("anomaly", F.col("value") - F.col("clim"))


def budget_residual(df: DataFrame, t: list[str], component: str, value: str, observed: str, parts: list[str]) -> DataFrame:
    """Observed minus the total of its parts, where every one of them is present."""
    columns = [F.max(F.when(col(component) == c, col(value))).alias(c) for c in (observed, *parts)]
    wide = df.filter(col(component).isin([observed, *parts])).groupBy(*t).agg(*columns)
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return wide.withColumn("residual", F.col(observed) - total).withColumn("total", total).filter(
        F.col("residual").isNotNull()
    )


def closure(residuals: DataFrame, t: str, residual: str = "residual") -> DataFrame:
    r = col(residual)
    return residuals.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.abs(r), t).alias("last_gap"),
        F.max(F.abs(r)).alias("max_gap"),
        F.sqrt(F.avg(r * r)).alias("rms"),
    )


def early_warning(df: DataFrame, series: list[str], time: str, value: str, window: int) -> DataFrame:
    """Rolling variance and lag-1 autocorrelation of the detrended monthly series.

    Windows of ``window`` calendar months; months whose window lacks one are dropped, and
    only neighbouring months make a pair. A window without variance has no autocorrelation.
    """
    months = monthly(df, series, time, value)
    k = F.year("month") * 12 + F.month("month") - 1
    indexed = months.withColumn("k", k)
    whole = Window.partitionBy(*series)
    slope = F.regr_slope(F.col("value"), F.col("k")).over(whole)
    intercept = F.regr_intercept(F.col("value"), F.col("k")).over(whole)
    in_order = whole.orderBy("k")
    frame = in_order.rangeBetween(-(window - 1), 0)
    rest = indexed.withColumn("resid", F.col("value") - (slope * F.col("k") + intercept))
    follows = F.lag("k").over(in_order) == F.col("k") - 1
    pairs = rest.withColumn("resid_before", F.when(follows, F.lag("resid").over(in_order)))
    pair_frame = in_order.rangeBetween(-(window - 2), 0)
    both = F.col("resid_before").isNotNull()
    here = F.when(both, F.col("resid"))
    spread = F.stddev_pop(here).over(pair_frame) * F.stddev_pop("resid_before").over(pair_frame)
    lag1 = F.covar_pop(here, F.col("resid_before")).over(pair_frame) / F.when(spread > 0, spread)
    return (
        pairs.withColumn("variance", F.var_pop("resid").over(frame))
        .withColumn("lag1", lag1)
        .withColumn("rows", F.count(F.lit(1)).over(frame))
        .filter(F.col("rows") == window)
        .select(*series, "month", "resid", "variance", "lag1")
    )


def state_vector(df: DataFrame, channel: str, time: str, value: str, channels: list[str]) -> DataFrame:
    """One row per month, one standardised column per channel."""
    months = monthly(df, [channel], time, value).filter(col(channel).isin(channels))
    own = Window.partitionBy(channel)
    spread = F.stddev_pop("value").over(own)
    z = (F.col("value") - F.avg("value").over(own)) / F.when(spread > 0, spread)
    return months.withColumn("z", z).groupBy("month").pivot(channel, channels).agg(F.first("z", ignorenulls=True))


def fingerprint(df: DataFrame, time: str, lon: str, lat: str, value: str, box) -> DataFrame:
    """Area-weighted mean inside a box minus the area-weighted mean everywhere, per month, of
    the rows with a place and a value. Longitudes wrap."""
    west, south, east, north = box
    x = wrap_lon(lon)
    across = (x >= west) & (x < east) if west <= east else (x >= west) | (x < east)
    inside = across & (col(lat) >= south) & (col(lat) < north)
    w = F.cos(F.radians(lat))
    real = located(df, lon, lat).filter(finite(value))
    wv = w * col(value)
    out = real.groupBy(F.trunc(time, "MM").alias("month")).agg(
        (F.sum(F.when(inside, wv)) / F.sum(F.when(inside, w))).alias("box"), (F.sum(wv) / F.sum(w)).alias("globe")
    )
    return out.withColumn("index", F.col("box") - F.col("globe"))
