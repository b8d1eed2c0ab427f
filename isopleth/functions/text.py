"""Text helpers for catalog search and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col

# Fixed value: a taxon with fewer records than this is marked sparse.
SPARSE_RECORDS = 150_000


def haystack(*columns: Column | str) -> Column:
    """Lower-cased fields joined by single blanks; a missing field reads as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns]))


def contains_ci(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle.lower()))


def sparse(records: Column | str, threshold: int = SPARSE_RECORDS) -> Column:
    return col(records) < threshold


def station_class(kind: Column | str) -> Column:
    kind = F.coalesce(col(kind), F.lit("station"))
    return F.when(F.contains(kind, F.lit("AMOC")), F.lit("array")).otherwise(F.lit("other"))
