"""Small reference inputs: risk-free yields, fundamentals, universe snapshots, share counts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_date, number
from ..functions.symbols import SymbolMap
from ..operators.fundamentals import reporting_lag
from ..operators.returns import risk_free_frame
from ..schemas import FUNDAMENTALS, SHARES, UNIVERSE

# Names that inputs use for a column, in order of preference.
RATE_DATE = ("date", "trade_date", "auction_date")
RATE_YIELD = ("annualized_yield", "yield", "ytm", "rate", "tbill_91d", "mibor")
MEMBER_ALIASES = {"symbol": ("symbol",), "company_name": ("company_name", "company name"), "industry": ("industry",), "isin": ("isin", "isin code", "isin_code")}
DATES = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy", "dd/MM/yyyy")


def _text(spark: SparkSession, path: str, null: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return (reader.option("nullValue", null) if null else reader).csv(path)


def pick(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    """The first of some names that a frame has, in any case."""
    have = {c.strip().lower(): c for c in df.columns}
    return next((F.col(f"`{have[n]}`") for n in names if n in have), None)


def read_risk_free(spark: SparkSession, path: str, source: str = "rbi_91d_tbill", day_count: int = 365) -> DataFrame:
    """date, annualized_yield, daily_rf, source from a CSV or Parquet file; ``-`` is a null yield, whose row stays."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _text(spark, path, "-")
    day, rate = pick(raw, RATE_DATE), pick(raw, RATE_YIELD)
    if day is None or rate is None:
        raise ValueError(f"no date or yield column in {raw.columns}")
    rows = raw.select(first_date(day.cast("string"), *DATES).alias("date"), number(rate).alias("annualized_yield")).where("date is not null")
    return risk_free_frame(rows, source, day_count)


def rate_template() -> str:
    """A CSV of three rows to fill in."""
    return "date,annualized_yield\n2020-01-01,5.10\n2020-01-08,5.08\n2020-01-15,5.12\n"


def reverse_dated(spark: SparkSession, path: str) -> DataFrame:
    """A yield file whose dates are dd-MMM-yyyy, newest first, as ISO dates, oldest first."""
    raw = _text(spark, path)
    day = pick(raw, RATE_DATE)
    return raw.withColumn("date", first_date(day, "dd-MMM-yyyy")).orderBy("date")


def read_fundamentals(spark: SparkSession, path: str, lag_months: int = 3) -> DataFrame:
    """The fundamentals table; missing measures are null, and the ratio is computed only if the file has none at all."""
    raw = _text(spark, path)
    day, symbol = pick(raw, ("as_of_date",)), pick(raw, ("symbol",))
    if day is None or symbol is None:
        raise ValueError("as_of_date and symbol are needed")
    measure = lambda name: number(c) if (c := pick(raw, (name,))) is not None else F.lit(None).cast("double")
    rows = raw.select(first_date(day, *DATES).alias("as_of_date"), SymbolMap().column(symbol).alias("symbol"), *[measure(c).alias(c) for c in ("market_cap", "book_value", "book_to_market")])
    known = rows.agg(F.count("book_to_market").alias("_known"))
    ratio = F.when(F.col("_known") == 0, F.when(F.col("market_cap") > 0, F.try_divide("book_value", "market_cap"))).otherwise(F.col("book_to_market"))
    out = rows.crossJoin(F.broadcast(known)).withColumn("book_to_market", ratio).drop("_known")  # one row
    return reporting_lag(out, lag_months).select(*FUNDAMENTALS.fieldNames())


def date_of_snapshot(name: str) -> dt.date | None:
    found = re.search(r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", name)
    return dt.date(*map(int, found.groups())) if found else None


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Dated constituent files (CSV) as one table, the date from the file's name, one row per (as_of_date, symbol)."""
    raw = _text(spark, path)
    day = F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}[-_]?\d{2}[-_]?\d{2})", 1), "[-_]", ""), F.lit("yyyyMMdd")))
    own = pick(raw, ("as_of_date",))
    named = [(c if (c := pick(raw, aliases)) is not None else F.lit(None).cast("string")).alias(name) for name, aliases in MEMBER_ALIASES.items()]
    rows = raw.select((F.coalesce(first_date(own, *DATES), day) if own is not None else day).alias("as_of_date"), *named)
    rows = rows.where("symbol is not null").withColumn("symbol", SymbolMap().column(F.col("symbol")))
    first = Window.partitionBy("as_of_date", "symbol").orderBy(F.col("company_name").asc_nulls_last(), F.col("isin").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*UNIVERSE.fieldNames())


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """Share counts above 0, one per key; a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SHARES)
    rows = spark.read.parquet(path).where("shares > 0")
    return rows.groupBy("as_of_date", "symbol").agg(F.max("shares").alias("shares")).select(*SHARES.fieldNames())
