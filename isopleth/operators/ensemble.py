"""Several products on the same pixels: mean and spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.missing import col, finite
from ..plans.layers import MIN_MEMBERS
from . import grid as grids


def stack_members(members: dict[str, DataFrame]) -> DataFrame:
    """Append products that share columns, tagging each row with its member name."""
    tagged = [df.withColumn("member", F.lit(name)) for name, df in members.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def ensemble(
    stacked: DataFrame,
    keys: list[str],
    members: list[str],
    value: str = "value",
    member: str = "member",
    min_members: int = MIN_MEMBERS,
) -> DataFrame:
    """Mean and population spread across members: ``(keys, mean, spread, n_members)``.

    A member's rows at a pixel are first reduced to its own mean. Member names are
    known, so that is one aggregate column per member and the whole job one shuffle.
    """
    means = {f"_m{i}": F.avg(F.when(col(member) == name, col(value))) for i, name in enumerate(members)}
    present = [F.when(F.col(m).isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for m in means]
    fields = (
        stacked.filter(finite(value) & col(member).isin(list(members)))
        .groupBy(*keys)
        .agg(*[mean.alias(m) for m, mean in means.items()])
        .withColumn("n_members", reduce(lambda a, b: a + b, present))
        .filter(F.col("n_members") >= min_members)
    )
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) for m in means])
    fields = fields.withColumn("mean", total / F.col("n_members"))
    off = [F.col(m) - F.col("mean") for m in means]
    squares = reduce(lambda a, b: a + b, [F.coalesce(x * x, F.lit(0.0)) for x in off])
    return fields.withColumn("spread", F.sqrt(squares / F.col("n_members"))).drop(*means)


def ensemble_on_common_grid(
    members: dict[str, tuple[DataFrame, Grid]], common: Grid, value: str = "value", min_members: int = MIN_MEMBERS
) -> DataFrame:
    """Bring each member's cells to the common (coarsest) grid, then combine."""
    regridded = {
        name: grids.coarsen(cells, own, common, value).select("ix", "iy", "value")
        for name, (cells, own) in members.items()
    }
    return ensemble(stack_members(regridded), ["ix", "iy"], list(members), min_members=min_members)


def compare_products(
    fine: DataFrame, fine_grid: Grid, coarse: DataFrame, coarse_grid: Grid, value: str = "value"
) -> DataFrame:
    """Two products of nested resolution, cell by cell: the fine one is averaged up."""
    lifted = grids.coarsen(fine, fine_grid, coarse_grid, value).select("ix", "iy", "value")
    both = stack_members({"fine": lifted, "coarse": coarse.select("ix", "iy", col(value).alias("value"))})
    paired = both.groupBy("ix", "iy").agg(
        F.avg(F.when(F.col("member") == "fine", F.col("value"))).alias("fine"),
        F.avg(F.when(F.col("member") == "coarse", F.col("value"))).alias("coarse"),
    )
    return paired.filter(F.col("fine").isNotNull() & F.col("coarse").isNotNull()).withColumn(
        "diff", F.col("fine") - F.col("coarse")
    )


def bias_rmse(paired: DataFrame, diff: str = "diff") -> DataFrame:
    return paired.agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(diff).alias("bias"),
        F.sqrt(F.avg(col(diff) * col(diff))).alias("rmse"),
    )
