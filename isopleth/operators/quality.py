"""Data-quality expectations: one row per check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col
from ..plans.ordered import ordered, previous

URL = "^https?://"
GRID_TOLERANCE = 5e-4


@dataclass(frozen=True)
class Check:
    """An aggregate over the table and the range it must lie in (open ends: None)."""

    name: str
    observed: Column
    low: float | None = None
    high: float | None = None
    strict: bool = False


def report(df: DataFrame, dataset: str, checks: list[Check]) -> DataFrame:
    """Evaluate all checks in one pass over the table."""
    one = df.agg(*[c.observed.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = []
    for i, c in enumerate(checks):
        seen = F.col(f"c{i}")
        ok = seen.isNotNull()
        if c.low is not None:
            ok = ok & (seen > c.low if c.strict else seen >= c.low)
        if c.high is not None:
            ok = ok & (seen < c.high if c.strict else seen <= c.high)
        rows.append(
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.lit(c.name).alias("check"),
                seen.alias("observed"),
                F.lit(c.low).cast("double").alias("low"),
                F.lit(c.high).cast("double").alias("high"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def _none(name: str, bad: Column) -> Check:
    return Check(name, F.count_if(F.coalesce(bad, F.lit(True))), 0, 0)


def required(column: str) -> Check:
    text = F.trim(col(column).cast("string"))
    return _none(f"required:{column}", text.isNull() | (text == ""))


def url(column: str) -> Check:
    return _none(f"url:{column}", ~col(column).rlike(URL))


def unique(key: str) -> Check:
    return Check(f"unique:{key}", F.count(key) - F.count_distinct(key), 0, 0)


def row_count(low: float | None = None, high: float | None = None) -> Check:
    return Check("row_count", F.count(F.lit(1)), low, high)


def flagged(name: str, flag: Column, low: float | None = None, high: float | None = None) -> Check:
    return Check(f"flagged:{name}", F.count_if(flag), low, high)


def coordinates(lon: str = "lon", lat: str = "lat") -> Check:
    return _none("coordinates", (F.abs(col(lon)) > 180) | (F.abs(col(lat)) > 90))


def aligned(first: str, *others: str) -> Check:
    """Equal numbers of values; on arrays, equal lengths row by row."""
    bad = None
    for other in others:
        differs = F.size(first) != F.size(other)
        bad = differs if bad is None else bad | differs
    return _none(f"aligned:{first}", bad)


def counts_agree(a: str, b: str) -> Check:
    return Check(f"counts:{a}={b}", F.count(a) - F.count(b), 0, 0)


def between(column: str, low: float | None, high: float | None) -> list[Check]:
    """Every value strictly inside the bounds."""
    checks = []
    if low is not None:
        checks.append(Check(f"min:{column}", F.min(column), low, None, strict=True))
    if high is not None:
        checks.append(Check(f"max:{column}", F.max(column), None, high, strict=True))
    return checks


def mean_between(column: str, low: float, high: float) -> Check:
    return Check(f"mean:{column}", F.avg(column), low, high, strict=True)


def spans(column: Column, name: str, starts_by: float, reaches: float) -> list[Check]:
    return [
        Check(f"starts:{name}", F.min(column), None, starts_by),
        Check(f"reaches:{name}", F.max(column), reaches, None),
    ]


def last_gap(t: str, a: str, b: str, limit: float) -> Check:
    return Check(f"closure:{a}-{b}", F.max_by(F.abs(col(a) - col(b)), col(t)), None, limit, strict=True)


def last_positive(t: str, column: str) -> Check:
    return Check(f"last:{column}", F.max_by(col(column), col(t)), 0, None, strict=True)


def rise(t: str, column: str, low: float, high: float) -> Check:
    change = F.max_by(col(column), col(t)) - F.min_by(col(column), col(t))
    return Check(f"rise:{column}", change, low, high, strict=True)


def share(name: str, hit: Column, among: Column, low: float | None, high: float | None = None) -> Check:
    n = F.count_if(among)
    return Check(f"share:{name}", F.count_if(hit & among) / F.when(n > 0, n), low, high, strict=True)


def grid_geometry() -> list[Check]:
    """For grid metadata rows: ordered bounds, and steps that fit bounds and counts."""
    dlon = (F.col("east") - F.col("west")) / F.col("nx")
    dlat = (F.col("north") - F.col("south")) / F.col("ny")
    return [
        _none("bounds", (F.col("east") <= F.col("west")) | (F.col("north") <= F.col("south"))),
        _none("dlon", F.abs(F.col("dlon") - dlon) >= GRID_TOLERANCE),
        _none("dlat", F.abs(F.col("dlat") - dlat) >= GRID_TOLERANCE),
        _none("cells", F.size("values") != F.col("nx") * F.col("ny")),
    ]


def whole_grids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Documents of one grid row each, summed to one row per grid, for ``grid_sums``."""
    off = lambda step, low, high, n: F.max(F.abs(F.col(step) - (F.col(high) - F.col(low)) / F.col(n))).alias(f"{step}_off")
    return rows.groupBy(key).agg(
        F.max("west").alias("west"), F.min("east").alias("east"), F.max("south").alias("south"), F.min("north").alias("north"),
        off("dlon", "west", "east", "nx"), off("dlat", "south", "north", "ny"),
        F.max(F.col("nx") * F.col("ny")).alias("cells"), F.sum(F.size("values")).alias("listed"), F.count_distinct("iy").alias("rows"), F.max("ny").alias("ny"),
    )


def grid_sums() -> list[Check]:
    """For rows of ``whole_grids``: ordered bounds, steps that fit them in every grid row, and
    every row and cell there once."""
    return [
        _none("bounds", (F.col("east") <= F.col("west")) | (F.col("north") <= F.col("south"))),
        _none("dlon", F.col("dlon_off") >= GRID_TOLERANCE),
        _none("dlat", F.col("dlat_off") >= GRID_TOLERANCE),
        _none("cells", (F.col("listed") != F.col("cells")) | (F.col("rows") != F.col("ny"))),
    ]


def ordered_at(name: str, when: Column, greater: str, lesser: str) -> Check:
    """At the chosen time the one series exceeds the other."""
    met = F.count_if(when & (col(greater) > col(lesser)))
    return Check(f"order:{name}", met, 1, None)


def descending(df: DataFrame, dataset: str, position: str, value: str) -> DataFrame:
    """Counts rows larger than the one before them, over the whole order."""
    steps = previous(ordered(df.select(position, value), [], [position]), col(value), "before")
    return report(steps, dataset, [Check(f"descending:{value}", F.count_if(col(value) > F.col("before")), 0, 0)])
