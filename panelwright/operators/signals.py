"""Characteristics: illiquidity, momentum, size, value. All time windows share one partitioning by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, known, rolling_mean, series

ILLIQ_WINDOW, LOOKBACK, SKIP = 30, 252, 21


def daily_illiq(ret: Column, volume: Column, zero_volume: float = float("nan")) -> Column:
    """|return| per traded value, ``zero_volume`` where nothing was traded."""
    return F.when(finite(volume) & (volume > 0), F.try_divide(F.abs(ret), volume)).otherwise(F.lit(zero_volume))


def attach_illiq(df: DataFrame, ret: str = "ret", volume: str = "tottrdval") -> DataFrame:
    """illiq, null without a return or traded value."""
    good = known(F.col(ret)) & known(F.col(volume)) & (F.col(volume) > 0)
    return df.withColumn("illiq", F.when(good, F.try_divide(F.abs(ret), volume)))


def attach_rolling_illiq(df: DataFrame, window: int = ILLIQ_WINDOW, least: int | None = None) -> DataFrame:
    """illiq_roll: the mean of the last ``window`` rows' illiq, of half as many at least."""
    if window <= 0:
        raise ValueError("window must be positive")
    df = df if "illiq" in df.columns else attach_illiq(df)
    return df.withColumn("illiq_roll", rolling_mean(F.col("illiq"), series().rowsBetween(1 - window, 0), max(1, window // 2) if least is None else least))


def attach_illiq_signal(df: DataFrame, window: int = ILLIQ_WINDOW) -> DataFrame:
    """illiq, illiq_roll, and illiq_signal: the previous row's illiq_roll."""
    return attach_rolling_illiq(df, window).withColumn("illiq_signal", F.lag("illiq_roll").over(series()))


def attach_momentum(df: DataFrame, lookback: int = LOOKBACK, skip: int = SKIP, least: int | None = None, ret: str = "ret", out: str = "mom_12_1") -> DataFrame:
    """Compound return over the ``lookback`` rows before the last ``skip``; null returns count as 0."""
    if lookback <= skip:
        raise ValueError("lookback must exceed skip")
    need = max(5, (lookback - skip) // 2) if least is None else least
    growth = F.lit(1.0) + F.coalesce(ret, F.lit(0.0))
    step = F.when(growth > 0, F.log(growth)).otherwise(F.lit(float("-inf")))
    rows = series().rowsBetween(-(lookback - 1), -skip)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(rows) >= need, F.exp(F.sum(step).over(rows)) - 1))


def attach_size(df: DataFrame, cap: str = "market_cap", log: bool = True) -> DataFrame:
    out = df.withColumn("me", F.col(cap).cast("double"))
    return out.withColumn("log_me", F.when(F.col("me") > 0, F.log("me"))) if log else out


def attach_value(df: DataFrame, ratio: str = "book_to_market") -> DataFrame:
    return df.withColumn("btm", F.col(ratio).cast("double"))


def lag_signal(df: DataFrame, signal: str, periods: int = 1) -> DataFrame:
    return df.withColumn(f"{signal}_lag{periods}", F.lag(signal, periods).over(series()))


def has_values(df: DataFrame, *columns: str) -> dict[str, bool]:
    """Whether columns exist and hold a value: one action for all of them."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return dict.fromkeys(columns, False)
    row = df.agg(*[F.count(c).alias(c) for c in there]).first()
    return {c: c in there and row[c] > 0 for c in columns}


def last_known_frame(symbol: str = "symbol", date: str = "trade_date"):
    """The frame from a symbol's first row to the current one."""
    return Window.partitionBy(symbol).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
