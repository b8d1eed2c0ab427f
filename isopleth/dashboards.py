"""The numbers on the dashboards, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import series as s

# The half-open year ranges compared, and the budget's components in order.
EARLY_YEARS = (2004, 2009)
RECENT_YEARS = (2019, 2025)
COMPONENTS = ("steric", "glaciers", "greenland", "antarctica", "tws")


def transport_numbers(series: DataFrame, value: str = "moc") -> DataFrame:
    """Latest value, early and recent means and their difference, range."""
    return s.period_stats(series, [], "t", value, EARLY_YEARS, RECENT_YEARS)


def sea_level_numbers(budget: DataFrame, altimetry: DataFrame) -> DataFrame:
    """Total rise, satellite-era rate, and the component that rose most.

    ``budget`` has a column per component.
    """
    ends = [
        (F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year"))) - F.min_by(c, F.when(F.col(c).isNotNull(), F.col("year")))).alias(c)
        for c in ("observed", *COMPONENTS)
    ]
    rises = budget.agg(*ends)
    largest = F.greatest(*[F.col(c) for c in COMPONENTS])
    driver = F.coalesce(*[F.when(F.col(c) == largest, F.lit(c)) for c in COMPONENTS])
    rate = s.trend(altimetry, [], "t", "v").select("slope").scalar()
    return rises.select(
        F.col("observed").alias("total_rise"), driver.alias("driver"), largest.alias("driver_rise"), rate.alias("rate")
    )


def temperature_numbers(series: DataFrame) -> DataFrame:
    """Latest values of both series, skipping missing years, and the change since the start."""
    whole = s.total_change(series, [], "year", "land_ocean")
    land = s.total_change(series, [], "year", "land_only").select("last").scalar()
    return whole.select(
        F.col("last").alias("land_ocean"), land.alias("land_only"), F.col("change").alias("since_start"), F.col("last_t").alias("year")
    )
