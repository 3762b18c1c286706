"""Price adjustment, simple, log and excess returns, and risk-free rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, series
from ..schemas import ADJUSTABLE, RETURN_COLUMNS, RETURN_EXTRAS
from .asof import asof_join

#: Rates that must not stand for the local risk-free rate.
BANNED_SOURCES = ("fed_funds", "sofr", "us_tbill")


def adjustment_factor(close: Column, adjusted: Column) -> Column:
    """adjusted / close; NaN where close is 0 or either isn't finite."""
    good = finite(close) & finite(adjusted) & (close != 0)
    return F.when(good, F.try_divide(adjusted, close)).otherwise(F.lit(float("nan")))


def apply_factor(df: DataFrame, columns: list[str] | None = None, factor: str = "adj_factor") -> DataFrame:
    """adj_<c> = c x factor for each price column there is."""
    if factor not in df.columns:
        raise KeyError(factor)
    return df.withColumns({f"adj_{c}": F.col(c) * F.col(factor) for c in columns or ADJUSTABLE if c in df.columns})


def attach_adjustments(prices: DataFrame, adjustments: DataFrame | None) -> DataFrame:
    """Factors by (date, symbol), 1 where there is none, applied to all price columns; no row is lost."""
    base = prices.drop("adj_factor", "yf_adj_close")
    if adjustments is None:
        return apply_factor(base.withColumns({"adj_factor": F.lit(1.0), "yf_adj_close": F.lit(None).cast("double")}))
    one = adjustments.groupBy("trade_date", "symbol").agg(F.max("adj_factor").alias("adj_factor"), F.max("yf_adj_close").alias("yf_adj_close"))
    return apply_factor(base.join(one, ["trade_date", "symbol"], "left").withColumn("adj_factor", F.coalesce("adj_factor", F.lit(1.0))))


def ensure_adj_close(df: DataFrame) -> DataFrame:
    """adj_close, from close and the factor (1 by default) where it is missing."""
    if "adj_close" in df.columns:
        return df
    if "adj_factor" not in df.columns:
        df = df.withColumn("adj_factor", F.lit(1.0))
    return df.withColumn("adj_close", F.col("close") * F.coalesce("adj_factor", F.lit(1.0)))


def price_returns(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """ret and log_ret from one row to the next of a symbol; null on liquidated rows and next to gaps."""
    before = F.lag(price).over(series())
    live = ~F.coalesce(F.col("is_liquidated"), F.lit(False)) if "is_liquidated" in df.columns else F.lit(True)
    ratio = F.try_divide(F.col(price), before)
    return df.withColumn("_q", F.when(live, ratio)).withColumns({"ret": F.col("_q") - 1, "log_ret": F.when(F.col("_q") > 0, F.log("_q"))}).drop("_q")


def daily_rate(annual: Column, day_count: int = 365) -> Column:
    """A yield per day; above 1 it is taken for percent."""
    return F.when(annual > 1.0, annual / 100).otherwise(annual) / day_count


def daily_rate_of(annual: float, day_count: int = 365) -> float:
    return (annual / 100 if annual > 1.0 else annual) / day_count


def risk_free_frame(yields: DataFrame, source: str, day_count: int = 365) -> DataFrame:
    """date, annualized_yield, daily_rf, source from (date, annualized_yield)."""
    annual = F.when(F.col("annualized_yield") > 1.0, F.col("annualized_yield") / 100).otherwise(F.col("annualized_yield"))
    return yields.select("date", annual.alias("annualized_yield"), (annual / day_count).alias("daily_rf"), F.lit(source).alias("source"))


def forward_fill(rf: DataFrame, calendar: DataFrame) -> DataFrame:
    """The last published row at or before each calendar date; a null yield is carried like any other."""
    rows = rf.select(F.col("date").alias("_d"), "annualized_yield", "daily_rf", "source")
    out = asof_join(calendar.select(F.col("trade_date").alias("date")), rows, "date", "_d", payload=["annualized_yield", "daily_rf", "source"])
    return out.select("date", "annualized_yield", "daily_rf", "source")


def reject_banned(rf: DataFrame) -> None:
    """Raises where a source is one of another currency's rates (one small action)."""
    found = [r[0] for r in rf.where(F.lower("source").isin(*BANNED_SOURCES)).select("source").distinct().limit(len(BANNED_SOURCES)).collect()]
    if found:
        raise ValueError(f"not a local risk-free rate: {sorted(found)}")


def excess_returns(returns: DataFrame, rf: DataFrame, *, check: bool = True) -> DataFrame:
    """daily_rf, rf_source and excess_ret = ret - daily_rf by date."""
    if check:
        reject_banned(rf)
    rates = rf.groupBy(F.col("date").alias("trade_date")).agg(F.max_by(F.struct("daily_rf", "source"), F.struct("daily_rf", "source")).alias("_r"))
    rates = rates.select("trade_date", F.col("_r.daily_rf").alias("daily_rf"), F.col("_r.source").alias("rf_source"))
    return returns.drop("daily_rf", "rf_source", "excess_ret").join(rates, "trade_date", "left").withColumn("excess_ret", F.col("ret") - F.col("daily_rf"))


def attach_rf_excess(returns: DataFrame, rf: DataFrame) -> DataFrame:
    """Excess returns over the rate filled forward to the panel's dates."""
    calendar = returns.select("trade_date").distinct()
    return excess_returns(returns, forward_fill(rf, calendar))


def returns_panel(clean: DataFrame, rf: DataFrame | None = None, *, require_adj: bool = False) -> DataFrame:
    """The returns table from the cleaned prices."""
    if require_adj and "adj_close" not in clean.columns and "adj_factor" not in clean.columns:
        raise ValueError("the panel has neither adj_close nor adj_factor")
    out = price_returns(ensure_adj_close(clean))
    if rf is not None:
        out = attach_rf_excess(out, rf)
    else:
        out = out.withColumns({"excess_ret": F.lit(None).cast("double"), "daily_rf": F.lit(None).cast("double")})
    for flag in ("is_liquidated", "is_suspended"):
        if flag not in out.columns:
            out = out.withColumn(flag, F.lit(False))
    return out.select(*RETURN_COLUMNS, *[c for c in RETURN_EXTRAS if c in out.columns])
