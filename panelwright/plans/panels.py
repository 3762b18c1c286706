"""Test panels from the driver's star-schema tables: supplier-month, supplier-day and user-day.

Prices are quotients of exact integer sums, so ties and ranks don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(rows: DataFrame) -> DataFrame:
    cents, qty = F.sum("cents"), F.sum("qty")
    return rows.groupBy("trade_date", "symbol").agg(
        (cents.cast("double") / (qty.cast("double") * 100)).alias("close"), qty.cast("double").alias("tottrdqty"), (cents.cast("double") / 100).alias("tottrdval")
    )


def _lines(spark: SparkSession, sf_dir: str, date, *more) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        date.alias("trade_date"),
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        *more,
    )


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel: close, quantity and value of each supplier and month."""
    return _priced(_lines(spark, sf_dir, F.trunc("l_shipdate", "MM")))


def supplier_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse panel with gaps."""
    return _priced(_lines(spark, sf_dir, F.to_date("l_shipdate")))


def supplier_day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_day split by series, with EQ and BE rows of one (date, symbol)."""
    series = F.when(F.col("l_returnflag") == "A", "EQ").when(F.col("l_returnflag") == "N", "BE").otherwise("XX").alias("series")
    cents, qty = F.sum("cents"), F.sum("qty")
    return (
        _lines(spark, sf_dir, F.to_date("l_shipdate"), series)
        .groupBy("trade_date", "symbol", "series")
        .agg((cents.cast("double") / (qty.cast("double") * 100)).alias("close"), qty.cast("double").alias("tottrdqty"), (cents.cast("double") / 100).alias("tottrdval"))
    )


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section with a short history."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("trade_date"), F.col("user_id").cast("string").alias("symbol"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.lit(1).cast("bigint").alias("qty"))
    return _priced(rows)


def with_returns(panel: DataFrame) -> DataFrame:
    """ret and log_ret of close."""
    from ..operators.returns import price_returns

    return price_returns(panel.withColumn("adj_close", F.col("close"))).drop("adj_close")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier and quarter's end: book value, market cap, ratio; known three months later."""
    from ..operators.fundamentals import reporting_lag

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("retail"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("as_of_date"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )
    sums = lines.join(parts, "l_partkey").groupBy("symbol", "as_of_date").agg(F.sum(F.col("qty") * F.col("retail")).alias("book"), F.sum("cents").alias("cents"))
    book, cap = F.col("book").cast("double") / 100, F.col("cents").cast("double") / 100
    return reporting_lag(sums.select("as_of_date", "symbol", cap.alias("market_cap"), book.alias("book_value"), (book / cap).alias("book_to_market")), 3)


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yield per ISO week, every second one in percent."""
    from ..operators.returns import risk_free_frame

    weeks = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "week").alias("date"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"))
    sums = weeks.groupBy("date").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    plain = F.col("d").cast("double") / (F.col("n").cast("double") * 100)
    odd = F.datediff("date", F.lit("1990-01-01").cast("date")) % 14 == 7
    return risk_free_frame(sums.select("date", F.when(odd, plain * 100).otherwise(plain).alias("annualized_yield")), "rbi_91d_tbill")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers active in each quarter, as of its first day."""
    return table(spark, sf_dir, "lineitem").select(F.to_date(F.trunc("l_shipdate", "quarter")).alias("as_of_date"), F.concat(F.lit("S"), "l_suppkey").alias("symbol")).distinct()


def priced_with_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_month with returns and the fundamentals known at each month."""
    from ..operators.fundamentals import fundamentals_asof

    return fundamentals_asof(with_returns(supplier_month(spark, sf_dir)), fundamentals(spark, sf_dir))


# SQL forms of the same panels, for the oracles.
_LINES = "select {date} as trade_date, 'S' || l_suppkey as symbol, round(l_extendedprice * 100)::bigint as cents, l_quantity::bigint as qty from lineitem"
_SUMS = "sum(cents)::double / (sum(qty)::double * 100) as close, sum(qty)::double as tottrdqty, sum(cents)::double / 100 as tottrdval"
SM = f"sm as (select trade_date, symbol, {_SUMS} from ({_LINES.format(date='date_trunc(chr(109)||chr(111)||chr(110)||chr(116)||chr(104), l_shipdate)::date')}) group by all)".replace("chr(109)||chr(111)||chr(110)||chr(116)||chr(104)", "'month'")
SD = f"sd as (select trade_date, symbol, {_SUMS} from ({_LINES.format(date='l_shipdate::date')}) group by all)"
SDS = f"""sds as (select trade_date, symbol, series, {_SUMS} from (select l_shipdate::date as trade_date, 'S' || l_suppkey as symbol,
    case l_returnflag when 'A' then 'EQ' when 'N' then 'BE' else 'XX' end as series, round(l_extendedprice * 100)::bigint as cents, l_quantity::bigint as qty from lineitem) group by all)"""
EU = f"eu as (select trade_date, symbol, {_SUMS} from (select ts::date as trade_date, user_id::varchar as symbol, round(value * 100)::bigint as cents, 1::bigint as qty from events) group by all)"
FUND = """fund as (select as_of_date, (as_of_date + interval 3 month)::date as available_date, symbol, cents::double / 100 as market_cap, book::double / 100 as book_value, (book::double / 100) / (cents::double / 100) as book_to_market
    from (select last_day((date_trunc('quarter', l_shipdate) + interval 2 month)::date) as as_of_date, 'S' || l_suppkey as symbol, sum(l_quantity::bigint * round(p_retailprice * 100)::bigint) as book,
          sum(round(l_extendedprice * 100)::bigint) as cents from lineitem join part on l_partkey = p_partkey group by all))"""
RF = """rf as (select date, case when y > 1 then y / 100 else y end as annualized_yield, (case when y > 1 then y / 100 else y end) / 365 as daily_rf, 'rbi_91d_tbill' as source
    from (select date, case when datediff('day', date '1990-01-01', date) % 14 = 7 then d::double / (n::double * 100) * 100 else d::double / (n::double * 100) end as y
          from (select date_trunc('week', l_shipdate)::date as date, sum(round(l_discount * 100)::bigint) as d, count(*) as n from lineitem group by all)))"""
UNI = "uni as (select distinct date_trunc('quarter', l_shipdate)::date as as_of_date, 'S' || l_suppkey as symbol from lineitem)"


def returns_sql(panel: str, name: str) -> str:
    """A panel with ret and log_ret."""
    return f"{name} as (select *, close / lag(close) over (partition by symbol order by trade_date) - 1 as ret, ln(close / lag(close) over (partition by symbol order by trade_date)) as log_ret from {panel})"


PF = """pf as (select r.*, f.as_of_date, f.available_date, f.market_cap, f.book_value, f.book_to_market
    from r asof left join fund f on r.symbol = f.symbol and r.trade_date >= f.available_date)"""
