"""Column building blocks with the engine's null and NaN rules."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def section(date_col: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(date_col)


def series(symbol_col: str = "symbol", date_col: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(symbol_col).orderBy(date_col)


def known(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def finite(c: Column) -> Column:
    return known(c) & ~c.isin(float("inf"), float("-inf"))


def sum0(c: Column) -> Column:
    """A sum that is 0 where nothing was added."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within bounds; null stays null, and a null bound doesn't bind."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def rolling_mean(x: Column, rows: WindowSpec, least: int) -> Column:
    """Mean over a row frame, null with fewer than ``least`` non-null values."""
    return F.when(F.count(x).over(rows) >= least, F.avg(x).over(rows))


def average_rank(x: Column, group: list[str], tie: str) -> Column:
    """Rank among the non-null values of a group, ties sharing their mean rank; ``tie`` names x's column."""
    ranked = F.rank().over(Window.partitionBy(*group, x.isNotNull()).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, tie))
    return F.when(x.isNotNull(), ranked + (ties - 1) / F.lit(2.0).cast("double"))


def nearest_quantile(x: Column, q: float, group: list[str]) -> Column:
    """The element of index floor((n - 1) q + 0.5) among a group's n non-null values in order.

    Windows only, so a group is sorted and may spill; nothing is gathered into an array.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(x.asc_nulls_last()))
    n = F.count(x).over(Window.partitionBy(*group))
    index = F.floor((n - 1) * F.lit(q).cast("double") + F.lit(0.5).cast("double")) + 1
    return F.max(F.when(place == index, x)).over(Window.partitionBy(*group))


def first_date(c: Column, *formats: str) -> Column:
    """The first format that parses."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def number(c: Column) -> Column:
    """A double from text with thousands commas; null where it isn't one."""
    return F.regexp_replace(c.cast("string"), ",", "").try_cast("double")
