"""From raw prices to the returns table with fundamentals, and to the lake."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.symbols import SymbolMap
from ..operators.calendars import trading_calendar
from ..operators.clean import clean_prices
from ..operators.fundamentals import fundamentals_asof
from ..operators.returns import attach_adjustments, returns_panel
from ..sources.prices import read_price_files
from ..sources.reference import read_fundamentals, read_risk_free


@dataclass(frozen=True)
class PipelineConfig:
    """Explicit inputs (a path or none each), and where results go (none: nowhere)."""

    prices: str | None = None
    raw: str | None = None
    adjustments: str | None = None
    risk_free: str | None = None
    risk_free_source: str = "rbi_91d_tbill"
    fundamentals: str | None = None
    lag_months: int = 3
    out: str | None = None
    register: bool = False


@dataclass(frozen=True)
class PipelineResult:
    clean: DataFrame
    returns: DataFrame
    risk_free: DataFrame | None = None
    fundamentals: DataFrame | None = None


def run_returns_pipeline(spark: SparkSession, config: PipelineConfig, prices: DataFrame | None = None, symbol_map: SymbolMap | None = None) -> PipelineResult:
    """Adjust, clean onto the calendar of the raw panel, returns, excess returns, fundamentals as known.

    One lazy plan; with ``out`` its tables are written, and the returns are computed from the
    written prices.
    """
    if prices is None:
        prices = read_price_files(spark, config.raw, symbol_map=symbol_map) if config.raw else store.read_partitioned(spark, config.prices)
    if prices is None:
        raise ValueError("there are no prices")
    if "adj_factor" not in prices.columns:
        prices = attach_adjustments(prices, spark.read.parquet(config.adjustments) if config.adjustments else None)
    clean = clean_prices(prices, symbol_map, apply_calendar=True, calendar=trading_calendar(prices))
    if config.out:
        store.write_partitioned(clean, f"{config.out}/bhavcopy")
        clean = store.read_partitioned(spark, f"{config.out}/bhavcopy")
    rf = read_risk_free(spark, config.risk_free, config.risk_free_source) if config.risk_free else None
    rets = returns_panel(clean, rf)
    known = read_fundamentals(spark, config.fundamentals, config.lag_months) if config.fundamentals else None
    if known is not None:
        rets = fundamentals_asof(rets, known)
    if config.out:
        store.write_partitioned(rets, f"{config.out}/returns")
        rets = store.read_partitioned(spark, f"{config.out}/returns")
        for name, df in (("risk_free", rf), ("fundamentals", known)):
            if df is not None:
                store.write_flat(df, f"{config.out}/{name}")
        if config.register:
            store.register_standard_views(spark, config.out)
    return PipelineResult(clean, rets, rf, known)


def late_fundamentals(returns: DataFrame, fundamentals: DataFrame) -> bool:
    """Whether no fundamentals row was available within the returns' dates (one action)."""
    first = fundamentals.agg(F.min("available_date").alias("a"))
    last = returns.agg(F.max("trade_date").alias("b"))
    row = first.crossJoin(last).first()  # one row each
    return row["a"] is not None and row["b"] is not None and row["a"] > row["b"]
