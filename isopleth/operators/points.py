"""Point inventories: latest positions, rankings, rates, densities, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import cell_of, geo_tile_x, geo_tile_y, interleaved, located
from ..functions.missing import col, finite, nan_to_null, rounded
from ..plans.joins import lookup_join, within
from ..plans.ordered import ordered, row_numbers

TONNES_PER_MEGATONNE = 1e6
PAGE_ROWS = 250


def latest_per_key(df: DataFrame, keys: list[str], time: str, tiebreak: str, keep: list[str]) -> DataFrame:
    """The newest row of each key; of rows with equal times the lowest ``tiebreak`` wins.

    An aggregate, so each task sends at most one row per key into the shuffle. It holds
    whole rows, which Spark keeps sorted by key: ``newest_rows`` doesn't.
    """
    row = F.struct(col(time), *[col(c) for c in keep])
    newest = F.max_by(row, F.struct(col(time), -col(tiebreak)))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def newest_rows(df: DataFrame, keys: list[str], time: str, tiebreak: str, keep: list[str]) -> DataFrame:
    """The rows of ``latest_per_key`` from hash aggregates, which neither sort nor spill rows.

    While there are few enough keys to broadcast, the newest time of each, found on two columns,
    picks the rows out of the table, one or a few per key, and only those are compared by
    ``tiebreak``. More keys take the one sorted aggregate. Runs a job that counts the keys.
    """
    if not within(df.select(*keys).distinct()):
        return latest_per_key(df, keys, time, tiebreak, keep)
    last = df.groupBy(*keys).agg(F.max(time).alias("_newest"))
    named = last.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_newest")
    same = [col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [col(time).eqNullSafe(F.col("_newest"))]
    rows = df.join(F.broadcast(named), reduce(lambda a, b: a & b, same))
    # A missing tie comes last; all columns are replaced by the same comparisons, so they stay together.
    whole = isinstance(df.schema[tiebreak].dataType, T.IntegralType)
    tie = F.coalesce(col(tiebreak).cast("long"), F.lit(2**63 - 1)) if whole else F.struct(col(tiebreak).isNull(), col(tiebreak))
    return rows.groupBy(*keys).agg(*[F.min_by(col(c), tie).alias(c) for c in dict.fromkeys((time, *keep))])


def since(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows from midnight ``days`` days before ``as_of`` on; ``as_of`` is always given."""
    return df.filter(col(time) >= F.date_sub(as_of, days).cast("timestamp_ntz"))


def latest_positions(df: DataFrame, platform: str, time: str, tiebreak: str, lon: str, lat: str) -> DataFrame:
    located = df.filter(col(lon).isNotNull() & col(lat).isNotNull())
    last = newest_rows(located, [platform], time, tiebreak, [lon, lat])
    return last.select(
        platform, rounded(lon, 3).alias(lon), rounded(lat, 3).alias(lat), col(time).cast("date").alias("date")
    )


def first_quantity(summary: Column | str, gas: str = "co2e_100yr") -> Column:
    """Quantity of the first array entry for a gas; null when there is none."""
    hits = F.filter(col(summary), lambda e: e["Gas"] == gas)
    return F.try_element_at(hits, F.lit(1))["EmissionsQuantity"]


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where every column holds a value."""
    for c in columns:
        df = df.filter(col(c).isNotNull())
    return df


def top(df: DataFrame, quantity: str, tiebreak: str, n: int = 1000) -> DataFrame:
    """The ``n`` largest. Incomplete rows must be filtered out before."""
    return df.orderBy(col(quantity).desc(), col(tiebreak)).limit(n)


def page(df: DataFrame, quantity: str, tiebreak: str, offset: int, limit: int = PAGE_ROWS) -> DataFrame:
    """One page of the ranking, for the first pages of a report."""
    return df.orderBy(col(quantity).desc(), col(tiebreak)).offset(offset).limit(limit)


def paged(df: DataFrame, quantity: str, tiebreak: str, size: int = PAGE_ROWS) -> DataFrame:
    """The whole ranking with rank and page number, for pages of any depth."""
    negated = df.withColumn("_down", -col(quantity))
    ranked = row_numbers(ordered(negated, [], ["_down", tiebreak]), "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / F.lit(size)).cast("long")).drop("_down")


def with_rates(inventory: DataFrame, rates: DataFrame, key: str, rate: str, decimals: int = 3) -> DataFrame:
    """Inventory rows with their rate; null where unmatched or not a number.

    Keys are unique on the rates side.
    """
    return lookup_join(inventory, rates.select(key, rate), [key], "left").withColumn(
        rate, rounded(nan_to_null(rate), decimals)
    )


def inventory_totals(inventory: DataFrame, area: str, rate: str) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(area).alias("total_area"),
        F.count(rate).alias("matched"),
        F.count_if(col(rate) < 0).alias("thinning"),
    )


def keep_parsed(df: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose listed text columns are all numbers, parsed; and the rest as they came."""
    parsed = {c: F.trim(col(c)).try_cast("double") for c in numeric}
    good = None
    for c in parsed.values():
        good = finite(c) if good is None else good & finite(c)
    good = F.coalesce(good, F.lit(False))
    return df.filter(good).withColumns(parsed), df.filter(~good)


def density(points: DataFrame, z: int, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Occurrences per tile of the power-of-two geographic pyramid; those without a place are left out."""
    known = located(points, lon, lat).withColumn("z", F.lit(z))
    placed = known.withColumn("x", geo_tile_x(lon, z, known=True)).withColumn("y", geo_tile_y(lat, z, known=True))
    return placed.groupBy(*keys, "z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def pyramid(finest: DataFrame, z: int, keys: list[str], n: str = "n") -> DataFrame:
    """Counts at every level from the finest counts. Points are not read again.

    A cell is one number with the bits of x and y interleaved, so its ancestors are its
    shifts. The finest cells are shuffled once, by their ancestor half way up: the levels
    down to it are summed where the cells are then, without another shuffle. The levels above
    come from that one, which has far fewer cells.
    """
    half, groups = (z + 1) // 2, [*keys, "z", "_cell"]
    cells = finest.select(*keys, interleaved("x", "y").alias("_cell"), n)
    lower = _levels(cells.withColumn("_under", F.shiftright("_cell", 2 * (z - half))).repartition(*keys, "_under"), z, half, z)
    lower = lower.groupBy(*keys, "_under", "z", "_cell").agg(F.sum(n).alias(n)).drop("_under")
    upper = _levels(lower.filter(F.col("z") == half).drop("z"), half, 0, half - 1) if half else lower.limit(0)
    whole = lower.unionByName(upper.groupBy(*groups).agg(F.sum(n).alias(n)))
    x, y = cell_of("_cell")
    return whole.select(*keys, "z", x.alias("x"), y.alias("y"), n)


def _levels(cells: DataFrame, at: int, first: int, last: int) -> DataFrame:
    """Cells of level ``at`` listed under their ancestors of the levels ``first`` to ``last``."""
    listed = cells.withColumn("z", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return listed.withColumn("_cell", F.call_function("shiftright", F.col("_cell"), 2 * (F.lit(at) - F.col("z"))))


def group_totals(items: DataFrame, group: str, records: str, total: DataFrame) -> DataFrame:
    """Sum per group with its share of a one-row ``total``, and what the groups leave over."""
    whole = total.scalar()
    placed = items.agg(F.sum(records)).scalar()
    return (
        items.groupBy(group)
        .agg(F.sum(records).alias("records"))
        .withColumn("total", whole)
        .withColumn("share", F.col("records") / F.when(F.col("total") != 0, F.col("total")))
        .withColumn("unplaced", F.col("total") - F.coalesce(placed, F.lit(0)))
    )


def taxonomy_lookup(selected: DataFrame, taxa: DataFrame, key: str = "key") -> DataFrame:
    """Name, record count and note for each selected key; unknown keys keep nulls."""
    return lookup_join(selected, taxa, [key], "left")
