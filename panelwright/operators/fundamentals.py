"""Point-in-time fundamentals, market equity and universe membership."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FUNDAMENTALS
from .asof import asof_join

COLUMNS = FUNDAMENTALS.fieldNames()


def reporting_lag(df: DataFrame, lag_months: int) -> DataFrame:
    """available_date = as_of_date plus months, clamped to the month's end."""
    if lag_months < 0:
        raise ValueError("lag_months must not be negative")
    return df.withColumn("available_date", F.add_months("as_of_date", lag_months))


def latest_known(fundamentals: DataFrame, on: dt.date) -> DataFrame:
    """Per symbol the row available last on or before a date."""
    order = Window.partitionBy("symbol").orderBy(F.desc("available_date"), F.desc("as_of_date"), F.desc_nulls_last("market_cap"))
    return fundamentals.where(F.col("available_date") <= F.lit(on)).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fundamentals_asof(returns: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Each return row with the fundamentals that were available on its date."""
    payload = [c for c in COLUMNS if c != "symbol" and c in fundamentals.columns]
    return asof_join(returns, fundamentals, "trade_date", "available_date", ["symbol"], payload, tie=["as_of_date"])


def market_equity_asof(as_of: DataFrame, closes: DataFrame, shares: DataFrame) -> DataFrame:
    """Close times shares, each the last known at (symbol, as_of_date); null unless both are above 0."""
    prices = closes.where("close > 0").select("symbol", F.col("trade_date").alias("price_date"), "close")
    counts = shares.select("symbol", F.col("as_of_date").alias("shares_date"), "shares")
    keys = as_of.select("as_of_date", "symbol").distinct()
    out = asof_join(keys, prices, "as_of_date", "price_date", ["symbol"], ["close", "price_date"])
    out = asof_join(out, counts, "as_of_date", "shares_date", ["symbol"], ["shares", "shares_date"])
    cap = F.when((F.col("close") > 0) & (F.col("shares") > 0), F.col("close") * F.col("shares"))
    return out.select("as_of_date", "symbol", "close", "shares", cap.alias("market_cap"), "price_date", "shares_date")


def equity_as_fundamentals(equity: DataFrame, available: Column | None = None) -> DataFrame:
    """Market equity in the fundamentals' columns, available at once unless told otherwise."""
    none = F.lit(None).cast("double")
    return equity.select("as_of_date", (F.col("as_of_date") if available is None else available).alias("available_date"), "symbol", "market_cap", none.alias("book_value"), none.alias("book_to_market"))


def _with_ratio(df: DataFrame) -> DataFrame:
    ratio = F.when(F.col("book_value").isNotNull() & (F.col("market_cap") > 0), F.try_divide("book_value", "market_cap"))
    return df.withColumn("book_to_market", F.coalesce(ratio, "book_to_market")).select(*COLUMNS)


def _once(df: DataFrame, order: list[Column]) -> DataFrame:
    first = Window.partitionBy("symbol", "as_of_date").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def overlay_equity(base: DataFrame, equity: DataFrame) -> DataFrame:
    """Market caps laid over fundamentals by (symbol, as_of_date); keys of equity only are appended."""
    new = equity.groupBy("symbol", "as_of_date").agg(F.max("market_cap").alias("_me"))
    both = base.withColumn("_old", F.lit(True)).join(new, ["symbol", "as_of_date"], "full")
    old = F.col("_old").isNotNull()
    out = both.withColumns({"market_cap": F.coalesce("_me", "market_cap"), "available_date": F.when(old, F.col("available_date")).otherwise(F.col("as_of_date"))})
    return _once(_with_ratio(out), [F.col("available_date").desc_nulls_last(), F.col("book_value").desc_nulls_last()])


def overlay_book(base: DataFrame, book: DataFrame) -> DataFrame:
    """Book values laid over fundamentals, their availability with them; keys of the book only are appended."""
    picked = book.groupBy("symbol", "as_of_date").agg(F.max_by(F.struct(*[c for c in COLUMNS if c not in ("symbol", "as_of_date")]), F.struct("available_date", "book_value")).alias("_b"))
    both = base.withColumn("_old", F.lit(True)).join(picked, ["symbol", "as_of_date"], "full")
    old, has = F.col("_old").isNotNull(), F.col("_b.book_value").isNotNull()
    out = both.withColumns(
        {
            "book_value": F.coalesce("_b.book_value", "book_value"),
            "available_date": F.when(~old | has, F.col("_b.available_date")).otherwise(F.col("available_date")),
            "market_cap": F.when(old, F.col("market_cap")).otherwise(F.col("_b.market_cap")),
            "book_to_market": F.when(old, F.col("book_to_market")).otherwise(F.col("_b.book_to_market")),
        }
    )
    return _once(_with_ratio(out), [F.col("available_date").desc_nulls_last(), F.col("market_cap").desc_nulls_last()])


def members_on(universe: DataFrame, on: dt.date) -> DataFrame:
    """The snapshot in force on a date."""
    last = universe.where(F.col("as_of_date") <= F.lit(on)).agg(F.max("as_of_date").alias("as_of_date"))
    return universe.join(F.broadcast(last), "as_of_date", "left_semi")  # one row


def membership_on_dates(universe: DataFrame, dates: DataFrame) -> DataFrame:
    """(trade_date, symbol, as_of_date): the members of the snapshot in force on each date."""
    days = universe.select(F.col("as_of_date").alias("snapshot")).distinct()
    placed = asof_join(dates.select("trade_date").distinct(), days, "trade_date", "snapshot", payload=["snapshot"])
    members = universe.select(F.col("as_of_date").alias("snapshot"), "symbol").distinct()
    return placed.join(members, "snapshot").select("trade_date", "symbol", F.col("snapshot").alias("as_of_date"))
