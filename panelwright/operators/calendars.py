"""Trading calendars as one-column frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trading_calendar(panel: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """The panel's distinct dates."""
    return panel.select(F.col(date_col).alias("trade_date")).where("trade_date is not null").distinct()


def weekday_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Monday to Friday from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trade_date")) if start <= end else spark.createDataFrame([], "trade_date date")
    return days.where(F.weekday("trade_date") < 5)


def month_ends(panel: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """The last date that occurs in each calendar month; a month cut short counts."""
    return panel.where(F.col(date_col).isNotNull()).groupBy(F.trunc(date_col, "MM").alias("_m")).agg(F.max(date_col).alias("trade_date")).select("trade_date")


def rebalance_dates(panel: DataFrame, frequency: str = "month_end", date_col: str = "trade_date") -> DataFrame:
    if frequency == "daily":
        return trading_calendar(panel, date_col)
    if frequency == "month_end":
        return month_ends(panel, date_col)
    raise ValueError(f"unknown frequency {frequency}")


def month_end_asof(closes: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(symbol, as_of_date): each symbol's last date in each month, within bounds."""
    rows = closes.where("trade_date is not null")
    if start:
        rows = rows.where(F.col("trade_date") >= F.lit(start))
    if end:
        rows = rows.where(F.col("trade_date") <= F.lit(end))
    return rows.groupBy("symbol", F.trunc("trade_date", "MM").alias("_m")).agg(F.max("trade_date").alias("as_of_date")).select("symbol", "as_of_date")
