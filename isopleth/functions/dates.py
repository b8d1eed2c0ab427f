"""Calendar rules. The most recent available date is always passed in."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col

# Comparison offsets on offer, first date of the stepper, and the
# publication lag of the daily imagery in days.
COMPARE_YEARS = (1, 2, 5, 10, 20)
FIRST_DATE = "2000-01-01"


def add_days(d: Column | str, n) -> Column:
    return F.date_add(col(d), n)


def compare_date(d: Column | str, years: int | Column) -> Column:
    """The same day ``years`` earlier; 29 February always becomes the 28th."""
    d = col(d)
    day = F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.lit(28)).otherwise(F.dayofmonth(d))
    return F.make_date(F.year(d) - years, F.month(d), day)


def compare_date_value(d: dt.date, years: int) -> dt.date:
    leap_day = d.month == 2 and d.day == 29
    return dt.date(d.year - years, d.month, 28 if leap_day else d.day)


def month_snap(d: Column | str, latest: Column) -> Column:
    """First of the month, held back to the last complete month before ``latest``; null if missing."""
    last_complete = F.add_months(F.trunc(latest, "MM"), -1)
    return F.when(col(d).isNotNull(), F.least(F.trunc(col(d), "MM"), last_complete))


def month_snap_value(d: dt.date, latest: dt.date) -> dt.date:
    last_complete = (latest.replace(day=1) - dt.timedelta(days=1)).replace(day=1)
    return min(d.replace(day=1), last_complete)


def step_date(d: Column | str, unit: str, n: int, latest: Column) -> Column:
    """Move by days, months or years with end-of-month clamping, kept in range."""
    d = col(d)
    moved = {
        "day": lambda: F.date_add(d, n),
        "month": lambda: F.add_months(d, n),
        "year": lambda: F.add_months(d, 12 * n),
    }[unit]()
    return F.when(d.isNotNull(), F.least(latest, F.greatest(F.lit(FIRST_DATE).cast("date"), moved)))


def window_offsets(days: float, max_samples: int | None = None) -> list[int]:
    """Days back from the window end at which the window is sampled.

    Every day, unless the caller asks for so many samples spread over the window.
    """
    width = max(1, math.floor(days + 0.5))
    count = width if max_samples is None else min(max_samples, width)
    if count <= 1:
        return [0]
    step = (width - 1) / (count - 1)
    return sorted({math.floor(i * step + 0.5) for i in range(count)})


def window_sample_dates(end: Column | str, days: float, max_samples: int | None = None) -> Column:
    """Array of sample dates, newest first, for a per-row window end."""
    end = col(end)
    return F.array(*[F.date_sub(end, n) for n in window_offsets(days, max_samples)])


def sample_date_values(
    end: dt.date,
    days: float,
    max_samples: int | None = None,
    monthly: bool = False,
    latest: dt.date | None = None,
    dedupe: bool = True,
) -> list[dt.date]:
    """The same dates as plain values, for a window end known when the job is built.

    Monthly layers snap to published months; snapped repeats are dropped unless
    ``dedupe`` is off, in which case a month counts once per sample.
    """
    dates = [end - dt.timedelta(days=n) for n in window_offsets(days, max_samples)]
    if monthly:
        dates = [month_snap_value(d, latest or end) for d in dates]
    return list(dict.fromkeys(dates)) if dedupe else dates


def decimal_year(d: Column | str) -> Column:
    d = col(d)
    first = F.make_date(F.year(d), F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(F.year(d) + 1, F.lit(1), F.lit(1)), first)
    return F.year(d) + (F.dayofyear(d) - 1) / length


def days_in_month(d: Column | str) -> Column:
    return F.dayofmonth(F.last_day(col(d)))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    ts = col(ts)
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (day + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def utc(ts: Column | str) -> Column:
    """The instant a timestamp without zone names when read as UTC."""
    return F.timestamp_micros(micros(ts))


def utc_date(ts: Column | str) -> Column:
    """Calendar date of an instant in UTC, whatever the session zone."""
    days = F.floor(F.unix_micros(col(ts)) / F.lit(86_400_000_000))
    return F.date_from_unix_date(days.cast("int"))


def window_label(days: Column | str) -> Column:
    d = col(days)
    return F.when(d <= 1, F.lit("single day")).otherwise(
        F.concat(F.lit("past "), F.floor(d + 0.5).cast("string"), F.lit(" days"))
    )
