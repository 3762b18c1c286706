"""Vendor fundamentals from landed JSON texts (symbol, body), by declared schemas in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fundamentals import reporting_lag
from ..schemas import FUNDAMENTALS

_COLUMNS = FUNDAMENTALS.fieldNames()
SECTIONS = "Highlights struct<MarketCapitalization:string,BookValue:string,MostRecentQuarter:string>, Valuation struct<PriceBookMRQ:string>, SharesStats struct<SharesOutstanding:string>"
PERIODS = "map<string, struct<date:string,filing_date:string,totalStockholderEquity:string,commonStockTotalEquity:string,totalEquity:string>>"
STATEMENTS = "array<struct<date:string,fillingDate:string,acceptedDate:string,totalStockholdersEquity:string,totalStockholderEquity:string,totalEquity:string>>"


def _num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def _day(c: str | Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(F.col(c) if isinstance(c, str) else c, 1, 10), F.lit("yyyy-MM-dd")))


def exchange_symbol(c: Column, suffix: str) -> Column:
    """A bare symbol with a vendor's suffix."""
    return F.concat(F.regexp_replace(F.upper(F.trim(c)), r"\.[A-Z]+$", ""), F.lit(suffix))


def section_snapshot(landed: DataFrame, lag_months: int = 0) -> DataFrame:
    """One row per symbol from a sections document: the ratio from price-to-book, else from book per share."""
    x = landed.select("symbol", F.from_json("body", SECTIONS).alias("x")).select("symbol", "x.*")
    cap, per_share, shares, pb = _num("Highlights.MarketCapitalization"), _num("Highlights.BookValue"), _num("SharesStats.SharesOutstanding"), _num("Valuation.PriceBookMRQ")
    book = per_share * shares
    ratio = F.coalesce(F.when(pb > 0, 1 / pb), F.when(cap > 0, book / cap))
    rows = x.select(_day("Highlights.MostRecentQuarter").alias("as_of_date"), "symbol", cap.alias("market_cap"), book.alias("book_value"), ratio.alias("book_to_market")).where("as_of_date is not null")
    return reporting_lag(rows, lag_months).select(*_COLUMNS)


def _quarters(rows: DataFrame, latest_cap: DataFrame | None, periods: int, lag_months: int) -> DataFrame:
    """The newest periods of each symbol; a market cap, where given, belongs to the newest only."""
    one = rows.where("as_of_date is not null and book_value is not null").groupBy("symbol", "as_of_date").agg(F.max("filed").alias("filed"), F.max("book_value").alias("book_value"))
    newest = Window.partitionBy("symbol").orderBy(F.desc("as_of_date"))
    one = one.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= periods)
    if latest_cap is not None:
        one = one.join(latest_cap.groupBy("symbol").agg(F.max("market_cap").alias("_cap")), "symbol", "left")
    else:
        one = one.withColumn("_cap", F.lit(None).cast("double"))
    cap = F.when(F.col("_n") == 1, F.col("_cap"))
    out = one.select("as_of_date", F.coalesce("filed", F.add_months("as_of_date", lag_months)).alias("available_date"), "symbol", cap.alias("market_cap"), "book_value", F.when(cap > 0, F.col("book_value") / cap).alias("book_to_market"))
    return out.select(*_COLUMNS)


def period_map_quarters(landed: DataFrame, latest_cap: DataFrame | None = None, periods: int = 40, lag_months: int = 3) -> DataFrame:
    """From a map of periods to balance-sheet figures."""
    x = landed.select("symbol", F.explode(F.from_json("body", PERIODS)).alias("period", "s"))
    book = F.coalesce(_num("s.totalStockholderEquity"), _num("s.commonStockTotalEquity"), _num("s.totalEquity"))
    return _quarters(x.select("symbol", F.coalesce(_day("s.date"), _day("period")).alias("as_of_date"), _day("s.filing_date").alias("filed"), book.alias("book_value")), latest_cap, periods, lag_months)


def statement_quarters(landed: DataFrame, latest_cap: DataFrame | None = None, periods: int = 40, lag_months: int = 3) -> DataFrame:
    """From an array of balance-sheet statements."""
    x = landed.select("symbol", F.explode(F.from_json("body", STATEMENTS)).alias("s"))
    book = F.coalesce(_num("s.totalStockholdersEquity"), _num("s.totalStockholderEquity"), _num("s.totalEquity"))
    filed = F.coalesce(_day("s.fillingDate"), _day("s.acceptedDate"))
    return _quarters(x.select("symbol", _day("s.date").alias("as_of_date"), filed.alias("filed"), book.alias("book_value")), latest_cap, periods, lag_months)
