"""Missing-data rules. Every spelling of "missing" becomes SQL NULL on ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing number in the tabular sources.
SENTINELS = ("", "***", "*****")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """True for a real number, false for NaN (which sorts above infinity) and the
    infinities, null for NULL."""
    return F.abs(col(c)) < F.lit(float("inf"))


def number(c: Column | str) -> Column:
    """Text to double; sentinels, bad text and NaN become NULL."""
    text = F.trim(col(c))
    parsed = F.when(~text.isin(*SENTINELS), text).try_cast("double")
    return F.when(finite(parsed), parsed)


def rounded(c: Column | str, decimals: int) -> Column:
    """Round, with negative zero turned into zero so equal results compare equal."""
    return F.round(col(c), decimals) + F.lit(0.0)
