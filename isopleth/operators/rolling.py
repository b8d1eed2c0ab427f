"""Rolling-window fields: sampled means, exact means, differences, accumulations, probes."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import compare_date, compare_date_value, sample_date_values
from ..functions.missing import col, finite
from ..plans.joins import lookup_join, salted_join, settled, within


def on_dates(df: DataFrame, dates: list[dt.date], day: str = "day", time: str | None = None) -> DataFrame:
    """Keep rows on the given dates. ``time`` names the raw timestamp behind ``day``, so
    that its range reaches the file scan."""
    dates = sorted(set(dates))
    if time is not None:
        first = dt.datetime.combine(dates[0], dt.time())
        after = dt.datetime.combine(dates[-1] + dt.timedelta(days=1), dt.time())
        ntz = "timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"
        df = df.filter((col(time) >= F.lit(str(first)).cast(ntz)) & (col(time) < F.lit(str(after)).cast(ntz)))
    return df.filter(col(day).isin(dates))


def _weight(day: str, dates: list[dt.date]) -> Column:
    """How often each date was sampled; snapped monthly dates may repeat."""
    weight = F.lit(0)
    for times, group in _by_count(dates).items():
        weight = F.when(col(day).isin(group), F.lit(times)).otherwise(weight)
    return weight


def _by_count(dates: list[dt.date]) -> dict[int, list[dt.date]]:
    groups: dict[int, list[dt.date]] = {}
    for date, times in Counter(dates).items():
        groups.setdefault(times, []).append(date)
    return groups


def _mean(value: str, day: str, dates: list[dt.date]) -> tuple[Column, Column]:
    """Mean over the rows on ``dates`` and the number of samples that had data."""
    if len(set(dates)) == len(dates):
        inside = col(day).isin(dates)
        return F.avg(F.when(inside, col(value))), F.count(F.when(inside, col(value)))
    weight = _weight(day, dates)
    counted = F.sum(F.when(col(value).isNotNull(), weight))
    total = F.sum(F.when(weight > 0, col(value) * weight))
    return total / F.when(counted > 0, counted), F.coalesce(counted, F.lit(0))


def window_mean(
    obs: DataFrame,
    keys: list[str],
    value: str,
    end: dt.date,
    days: float,
    day: str = "day",
    time: str | None = None,
    max_samples: int | None = None,
    monthly: bool = False,
    latest: dt.date | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """Per-key mean over the sampled dates of a window; a key seen on none is absent."""
    dates = sample_date_values(end, days, max_samples, monthly, latest, dedupe)
    seen = on_dates(obs, dates, day, time).filter(finite(value))
    repeated = len(set(dates)) < len(dates)
    mean, n = _mean(value, day, dates) if repeated else (F.avg(value), F.count(F.lit(1)))
    return seen.groupBy(*keys).agg(mean.alias("value"), n.cast("long").alias("n"))


def window_delta(
    obs: DataFrame,
    keys: list[str],
    value: str,
    end: dt.date,
    years: int,
    days: float = 1,
    day: str = "day",
    time: str | None = None,
    max_samples: int | None = None,
    monthly: bool = False,
    latest: dt.date | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """Mean of the window minus the mean of the same window ``years`` earlier.

    One pass: a row counts for either window or both, and one aggregation per key
    computes the two means. Keys missing from either side are dropped.
    """
    past_end = compare_date_value(end, years)
    now = sample_date_values(end, days, max_samples, monthly, latest, dedupe)
    past = sample_date_values(past_end, days, max_samples, monthly, latest, dedupe)
    seen = on_dates(obs, now + past, day, time).filter(finite(value))
    (now_mean, now_n), (past_mean, past_n) = _mean(value, day, now), _mean(value, day, past)
    both = seen.groupBy(*keys).agg(
        now_mean.alias("now"), past_mean.alias("past"),
        now_n.cast("long").alias("n_now"), past_n.cast("long").alias("n_past"),
    )
    return both.filter((F.col("n_now") > 0) & (F.col("n_past") > 0)).withColumn("delta", F.col("now") - F.col("past"))


def window_accumulation(
    obs: DataFrame,
    keys: list[str],
    value: str,
    end: dt.date,
    years: int,
    days: int,
    day: str = "day",
    time: str | None = None,
) -> DataFrame:
    """Totals over every day of a window and of the same window ``years`` earlier."""
    past_end = compare_date_value(end, years)
    span = dt.timedelta(days=days - 1)
    now_rows = col(day).between(F.lit(end - span), F.lit(end))
    past_rows = col(day).between(F.lit(past_end - span), F.lit(past_end))
    dates = [end - span, end, past_end - span, past_end]
    seen = obs
    if time is not None:
        ntz = "timestamp_ntz" if dict(obs.dtypes)[time] == "timestamp_ntz" else "timestamp"
        after = max(dates) + dt.timedelta(days=1)
        seen = seen.filter((col(time) >= F.lit(str(min(dates))).cast(ntz)) & (col(time) < F.lit(str(after)).cast(ntz)))
    totals = (
        seen.filter((now_rows | past_rows) & finite(value))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(now_rows, col(value))).alias("now"),
            F.sum(F.when(past_rows, col(value))).alias("past"),
        )
    )
    return totals.filter(F.col("now").isNotNull() & F.col("past").isNotNull()).withColumn(
        "change", F.col("now") - F.col("past")
    )


def rolling_mean(obs: DataFrame, keys: list[str], value: str, days: int, day: str = "day") -> DataFrame:
    """Exact rolling mean per key and day: every observation of the last ``days`` days.

    Observations are summed to one row per (key, day) first, so the window handles at
    most as many rows per key as there are days on record.
    """
    daily = (
        obs.filter(finite(value))
        .groupBy(*keys, day)
        .agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    )
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return daily.select(
        *keys, day, (F.sum("_s").over(frame) / F.sum("_n").over(frame)).alias("value"),
        F.sum("_n").over(frame).alias("n"),
    )


def probe(points: DataFrame, obs: DataFrame, keys: list[str], field) -> DataFrame:
    """A field read at many points at once.

    ``field`` turns observations into one row per pixel key; only observations on
    the requested pixels reach it. Points over empty pixels keep a null value.
    """
    requested = settled(points.select(*keys).distinct(), "requested")
    small = within(requested)
    wanted = obs.join(F.broadcast(requested) if small else requested, keys, "left_semi")
    # The field has no more rows than there are requested pixels.
    pixels = field(wanted)
    if small:
        return points.join(F.broadcast(pixels), keys, "left")
    return salted_join(points, settled(pixels, "pixels"), keys, "left")


def _exact(total: Column | str) -> Column:
    """A day's total to twelve decimals, so that running sums and their differences are exact."""
    return col(total).cast("decimal(28,12)")


def probe_dated(
    points: DataFrame, obs: DataFrame, keys: list[str], value: str, end: str, days: int, years: int = 0, day: str = "day"
) -> DataFrame:
    """The mean of the ``days`` days up to each point's own date ``end``, on the point's pixel.

    ``value`` and ``n`` are null and 0 where the pixel has no observation in the window. With
    ``years``, ``past`` and ``n_past`` are those of the same window so many years earlier and
    ``delta`` is the difference, null unless both have data. Points without a pixel or a date
    keep nulls.

    Observations of the requested pixels become one total a day, totals become running sums
    beside the asked dates, and a window is the difference between two of those: its length
    and the number of dates cost nothing. Points that share pixel and date are asked once,
    so a pixel has at most a few rows for each day there is.
    """
    dates = {"value": F.col(end)} | ({"past": compare_date(F.col(end), years)} if years else {})
    known = [col(c).isNotNull() for c in (*keys, end)]
    asked = settled(points.filter(reduce(lambda a, b: a & b, known)).select(*keys, end).distinct(), "asked")
    wanted = asked.select(*keys).distinct()
    near = obs.join(F.broadcast(wanted) if within(wanted) else wanted, keys, "left_semi")
    daily = near.filter(finite(value)).groupBy(*keys, day).agg(_exact(F.sum(value)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    marks = [
        F.struct(F.lit(name).alias("name"), F.lit(sign).alias("sign"), F.date_sub(at, 0 if sign > 0 else days).alias("at"))
        for name, at in dates.items() for sign in (1, -1)
    ]
    asks = asked.select(*keys, end, F.explode(F.array(*marks)).alias("_m")).select(*keys, F.col("_m.at").alias("_at"), end, "_m.name", "_m.sign")
    facts = daily.select(*keys, F.col(day).alias("_at"), "_s", "_n")
    # Facts of a day come before the marks that ask for it.
    upto = Window.partitionBy(*keys).orderBy("_at", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    run = facts.unionByName(asks, allowMissingColumns=True).select(
        *keys, end, "name", "sign", F.sum("_s").over(upto).cast("decimal(36,12)").alias("_s"), F.sum("_n").over(upto).alias("_n")
    ).filter(F.col("sign").isNotNull())
    # One row each for the last day of a window and for the day before it.
    at = lambda c, name, sign: F.coalesce(F.max(F.when((F.col("name") == name) & (F.col("sign") == sign), F.col(c))), F.lit(0))
    window = lambda c, name: at(c, name, 1) - at(c, name, -1)
    sums = run.groupBy(*keys, end).agg(
        *[f for name in dates for f in (window("_s", name).alias(f"_s_{name}"), window("_n", name).cast("long").alias(f"_n_{name}"))]
    )
    mean = lambda name: (F.col(f"_s_{name}").cast("double") / F.when(F.col(f"_n_{name}") > 0, F.col(f"_n_{name}")))
    out = [mean("value").alias("value"), F.col("_n_value").alias("n")]
    if years:
        out += [mean("past").alias("past"), F.col("_n_past").alias("n_past"), (mean("value") - mean("past")).alias("delta")]
    return lookup_join(points, sums.select(*keys, end, *out), [*keys, end], "left")
