"""Dataset catalog search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col
from ..functions.text import contains_ci, haystack
from ..plans.ordered import ordered, row_numbers

# Fixed value: the searched fields.
SEARCH_FIELDS = ("name", "provider", "variables", "notes", "subdomain")


def matches(
    text: str = "", domain: str | None = None, amoc: bool = False, globe: bool = False, fields=SEARCH_FIELDS
) -> Column:
    """One predicate from the optional filters. An unset flag or domain never matches, as
    a filter and a conditional count take null for no; the plain comparison reaches the scan."""
    hit = F.lit(True)
    if domain:
        hit = hit & (col("domain") == domain)
    if amoc:
        hit = hit & col("amoc")
    if globe:
        hit = hit & col("globe")
    if text:
        hit = hit & contains_ci(haystack(*fields), text)
    return hit


def search(catalog: DataFrame, **filters) -> DataFrame:
    """Every record that matches."""
    return catalog.filter(matches(**filters))


def listed(hits: DataFrame, position: str, rows: int) -> DataFrame:
    """The first hits in catalog order, as many as a report shows."""
    return hits.orderBy(position).limit(rows)


def ranked(hits: DataFrame, position: str) -> DataFrame:
    """Every hit with its place in catalog order, from 1."""
    return row_numbers(ordered(hits, [], [position]), "rank")


def hit_count(catalog: DataFrame, **filters) -> DataFrame:
    """How many of how many."""
    return catalog.agg(F.count_if(matches(**filters)).alias("hits"), F.count(F.lit(1)).alias("records"))


def domains(catalog: DataFrame, domain: str = "domain") -> DataFrame:
    return catalog.select(domain).distinct().orderBy(domain)
