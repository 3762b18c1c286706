"""Quarterly fundamentals from landed balance-sheet lines (symbol, as_of_date, label, value), closes and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fundamentals import market_equity_asof, reporting_lag
from ..schemas import FUNDAMENTALS

#: Labels of book equity, compacted, in order of preference.
EQUITY = ("stockholdersequity", "totalstockholderequity", "commonstockequity", "totalequitygrossminorityinterest")


def equity_rank(label: Column) -> Column:
    """0 for the preferred label, rising; after the known ones any equity of stock- or shareholders; null for others."""
    compact = F.regexp_replace(F.lower(label), r"\s", "")
    rank = F.when(F.lit(False), 0)
    for k, name in enumerate(EQUITY):
        rank = rank.when(compact == name, k)
    return rank.when(compact.contains("equity") & compact.rlike("stockholder|shareholder|commonstock"), len(EQUITY))


def book_equity(lines: DataFrame) -> DataFrame:
    """(symbol, as_of_date, book_value): each symbol's best equity line, by all its dates."""
    ranked = lines.withColumn("_k", equity_rank(F.col("label"))).where("_k is not null")
    best = F.min("_k").over(Window.partitionBy("symbol"))
    kept = ranked.withColumn("_best", best).where("_k = _best and value is not null")
    return kept.groupBy("symbol", "as_of_date").agg(F.min_by("value", "label").alias("book_value"))


def resolved_shares(outstanding: Column, implied: Column, last_counted: Column, cap: Column, price: Column) -> Column:
    """The first that is known of a share count, an implied one, the last of a history, cap over price."""
    above = lambda c: F.when(c > 0, c)
    return F.coalesce(above(outstanding), above(implied), above(last_counted), F.when(price > 0, F.try_divide(above(cap), price)))


def quarterly_fundamentals(lines: DataFrame, closes: DataFrame, shares: DataFrame, lag_months: int = 3) -> DataFrame:
    """Book equity with the market equity of the last close at or before each period's end."""
    book = book_equity(lines)
    equity = market_equity_asof(book.select("as_of_date", "symbol"), closes, shares).select("symbol", "as_of_date", "market_cap")
    out = book.join(equity, ["symbol", "as_of_date"], "left").withColumn("book_to_market", F.when(F.col("market_cap") > 0, F.try_divide("book_value", "market_cap")))
    return reporting_lag(out, lag_months).select(*FUNDAMENTALS.fieldNames())
