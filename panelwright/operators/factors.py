"""Long-short factor returns and the panels they are built from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sum0
from .cross_section import median_split, prepare_signal, tercile_labels
from .signals import attach_illiq_signal, attach_momentum, attach_size, attach_value, has_values


def _sleeve(mask: Column, weight: Column, ret: Column) -> Column:
    """Half the weighted mean return of a sleeve; 0 where it has no weight."""
    total = F.sum(F.when(mask, weight))
    return F.when(total > 0, F.lit(0.5) * sum0(F.when(mask, weight * ret)) / total).otherwise(F.lit(0.0))


def _weight(df: DataFrame, weighting: str, weight_col: str | None) -> Column:
    if weighting == "value" and weight_col and weight_col in df.columns:
        return F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.lit(1.0)


def long_short(df: DataFrame, long: Column, short: Column, name: str, weighting: str = "value", weight_col: str | None = "market_cap", ret: str = "ret", date: str = "trade_date") -> DataFrame:
    """Per date +0.5 of the long sleeve and -0.5 of the short one, over the names with a return.

    One aggregation, summed per task before its exchange; dates with neither sleeve have no row.
    """
    rows = df.where(F.col(ret).isNotNull()).select(date, F.col(ret).alias("_r"), _weight(df, weighting, weight_col).alias("_w"), F.coalesce(long, F.lit(False)).alias("_l"), F.coalesce(short, F.lit(False)).alias("_s"))
    w, r = F.col("_w"), F.col("_r")
    value = _sleeve(F.col("_l"), w, r) - _sleeve(F.col("_s"), w, r)
    return rows.where("_l or _s").groupBy(date).agg(value.alias(name))


def smb(df: DataFrame, size: str = "market_cap", method: str = "sleeve", ratio: str = "book_to_market") -> DataFrame:
    """Small minus big by the median size; ``ff2x3`` averages over the value terciles instead."""
    split = median_split(df, size, "_size")
    if method == "ff2x3":
        return _two_by_three(split, ratio, "SMB", lambda leg: (leg("S", "L") + leg("S", "N") + leg("S", "H") - leg("B", "L") - leg("B", "N") - leg("B", "H")) / 3)
    return long_short(split, F.col("_size") == "S", F.col("_size") == "B", "SMB")


def hml(df: DataFrame, ratio: str = "book_to_market", size: str | None = "market_cap", method: str = "sleeve") -> DataFrame:
    """High minus low book-to-market terciles; with a size column only names that have a size bucket count."""
    rows = median_split(df, size, "_size") if size and size in df.columns else df.withColumn("_size", F.lit("S"))
    if method == "ff2x3":
        return _two_by_three(rows, ratio, "HML", lambda leg: (leg("S", "H") + leg("B", "H") - leg("S", "L") - leg("B", "L")) / 2)
    rows = tercile_labels(rows, ratio, out="_value")
    sized = F.col("_size").isNotNull()
    return long_short(rows, (F.col("_value") == "H") & sized, (F.col("_value") == "L") & sized, "HML")


def _two_by_three(split: DataFrame, ratio: str, name: str, combine) -> DataFrame:
    rows = tercile_labels(split, ratio, out="_value").where("ret is not null").withColumn("_w", _weight(split, "value", "market_cap"))

    def leg(size: str, value: str) -> Column:
        inside = (F.col("_size") == size) & (F.col("_value") == value)
        return F.try_divide(F.sum(F.when(inside, F.col("_w") * F.col("ret"))), F.sum(F.when(inside, F.col("_w"))))

    return rows.groupBy("trade_date").agg(combine(leg).alias(name))


def wml(df: DataFrame, signal: str = "mom_12_1", weighting: str = "value") -> DataFrame:
    """Winners minus losers by momentum terciles."""
    rows = tercile_labels(df, signal, out="_mom")
    return long_short(rows, F.col("_mom") == "H", F.col("_mom") == "L", "WML", weighting)


def illiq_factor(df: DataFrame, signal: str = "illiq_signal", weighting: str = "value") -> DataFrame:
    """Illiquid minus liquid names by terciles of the lagged signal."""
    rows = tercile_labels(df, signal, out="_liq")
    return long_short(rows, F.col("_liq") == "H", F.col("_liq") == "L", "ILLIQ", weighting)


def characteristic_panel(returns: DataFrame, window: int = 30, lookback: int = 252, skip: int = 21, winsor: bool = True, *, size: bool = True, value: bool = True) -> DataFrame:
    """Illiquidity, size, value, momentum, then winsorized and standardised momentum and illiquidity."""
    out = attach_illiq_signal(returns, window)
    out = attach_momentum(out, lookback, skip)
    if size and "market_cap" in out.columns:
        out = attach_size(out)
    if value and "book_to_market" in out.columns:
        out = attach_value(out)
    for signal in ("mom_12_1", "illiq_signal"):
        out = prepare_signal(out, signal, winsor=winsor)
    return out


def factor_returns(panel: DataFrame, *, size: bool, value: bool) -> DataFrame:
    """SMB and HML where the panel has their signals, WML and ILLIQ, by date (full outer)."""
    weighting = "value" if size else "equal"
    parts = ([smb(panel)] if size else []) + ([hml(panel)] if value else []) + [wml(panel, weighting=weighting), illiq_factor(panel, weighting=weighting)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "trade_date", "full")
    return out


@dataclass(frozen=True)
class Factors:
    characteristics: DataFrame
    factor_returns: DataFrame


def build_factors(returns: DataFrame, window: int = 30, lookback: int = 252, skip: int = 21, winsor: bool = True) -> Factors:
    """Both panels; one action tells which signals have values."""
    there = has_values(returns, "market_cap", "book_to_market")
    panel = characteristic_panel(returns, window, lookback, skip, winsor, size=there["market_cap"], value=there["book_to_market"])
    return Factors(panel, factor_returns(panel, size=there["market_cap"], value=there["book_to_market"]))


def signal_panel(df: DataFrame, kind: str, **how) -> DataFrame:
    """A characteristic attached and prepared: size, value or momentum."""
    attach, column = {"size": (attach_size, "log_me"), "value": (attach_value, "btm"), "momentum": (attach_momentum, "mom_12_1")}[kind]
    return prepare_signal(attach(df, **how), column)


def equal_weight_market(returns: DataFrame, name: str = "MKT") -> DataFrame:
    """The mean non-null return per date."""
    return returns.where("ret is not null").groupBy("trade_date").agg(F.avg("ret").alias(name))
