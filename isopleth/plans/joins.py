"""Joins against lookup tables whose size is known or checked before they are broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# A broadcast copy lives on every executor, so both its rows and its bytes are bounded.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

# A key with more rows than this, and with more than a thousandth of all of them, is hot.
HOT_ROWS = 1_000_000
HOT_SHARE = 0.001

# What the sketch of a table's keys tracks and reports, and over how many parts a hot key is spread.
SKETCH_ITEMS, SKETCH_KEYS = 16_384, 1_000
SALTS = 64


def settled(lookup: DataFrame, label: str = "lookup") -> DataFrame:
    """The lookup written once to the shared scratch folder.

    Checking its size and joining to it then do not compute it again. And a shuffle
    join reads it by a shuffle of its own: adaptive execution splits large partitions
    only when both sides come straight from a shuffle, which the result of an
    aggregation on the join keys does not.
    """
    path = scratch_path(lookup.sparkSession, label)
    lookup.write.parquet(path)
    return lookup.sparkSession.read.parquet(path)


def _weight(field: T.StructField) -> Column:
    """Bytes a value takes in a broadcast row, about: 8 for its place, and what lies behind it."""
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 8
    return F.lit(8)


def within(lookup: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether the lookup has at most ``rows`` rows and ``size`` bytes; reads no more rows than that."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    row = reduce(lambda a, b: a + b, [_weight(f) for f in lookup.schema], F.lit(16))
    n, weight = lookup.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(row.cast("long"))).first()
    return n <= rows and (weight or 0) <= size


def placed(lookup: DataFrame, small: bool) -> DataFrame:
    """A lookup derived from a table known to be small, or not, made ready for a join."""
    return F.broadcast(lookup) if small else settled(lookup)


def key_hash(on: list[str]) -> Column:
    """One number per join key, for the sketch and the salt only."""
    return F.xxhash64(*on)


def hot_keys(fact: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold more rows than one task should get.

    A heavy-hitter sketch of the key columns, which is as large as ``SKETCH_ITEMS`` whatever
    the table's size. Its counts are estimates; a wrong one makes a join slower, not wrong.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    sketch = F.call_function("approx_top_k", key_hash(on), F.lit(SKETCH_KEYS), F.lit(SKETCH_ITEMS))
    n, top = fact.filter(keyed).agg(F.count(F.lit(1)), sketch).first()
    return [item["item"] for item in top or [] if item["count"] > max(HOT_ROWS, HOT_SHARE * n)]


def salted_join(fact: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    """Shuffle join to a large lookup with unique keys that spreads hot keys.

    Rows of a hot key go to one of ``SALTS`` parts by the task that reads them, and the few
    lookup rows of hot keys are listed under every part; all others have part 0. Rows with
    a missing key match nothing and are spread as well. The fact is scanned once, besides
    its key columns for the sketch, and written nowhere.
    """
    salt, hot = "_salt", hot_keys(fact, on)
    spread = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    if hot:
        spread = spread | key_hash(on).isin(hot)
        parts = F.when(key_hash(on).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        listed = lookup.withColumn(salt, F.explode(parts))
    else:
        listed = lookup.withColumn(salt, F.lit(0))
    dealt = fact.withColumn(salt, F.when(spread, F.spark_partition_id() % SALTS).otherwise(0))
    return dealt.join(listed, [*on, salt], how).drop(salt)


def lookup_join(
    fact: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", bound: int | None = None
) -> DataFrame:
    """Left or inner equi-join of a large table to a lookup with unique keys.

    ``bound`` is a proven limit on the rows of a lookup of plain numbers; without one, or with
    a large one, the lookup is written out and measured. Small lookups are broadcast and the
    large side is not shuffled; others go to ``salted_join``.
    """
    if bound is not None and bound <= BROADCAST_ROWS:
        return fact.join(F.broadcast(lookup), on, how)
    lookup = settled(lookup)
    if within(lookup):
        return fact.join(F.broadcast(lookup), on, how)
    return salted_join(fact, lookup, on, how)
