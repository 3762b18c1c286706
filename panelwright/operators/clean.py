"""Cleaning of the price panel: types, series, duplicates, quality flags, the calendar grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import SymbolMap
from ..schemas import PRICE_MEASURES

SERIES_KEPT = ("EQ", "BE")
FLAGS = ("is_suspended", "is_missing_ohlc", "is_liquidated")


def cast_types(df: DataFrame) -> DataFrame:
    """Dates, texts and doubles where the columns exist; null where a value doesn't fit."""
    kinds = {"trade_date": "date", "symbol": "string", "series": "string"} | dict.fromkeys([*PRICE_MEASURES, "adj_factor", "adj_close", "yf_adj_close"], "double")
    out = {c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns}
    out |= {c: F.upper(F.trim(out[c])) for c in ("symbol", "series") if c in out}
    return df.withColumns(out)


def filter_series(df: DataFrame) -> DataFrame:
    """Rows of equity series; all rows where there is no series."""
    return df.where(F.col("series").isin(*SERIES_KEPT)) if "series" in df.columns else df


def dedupe(df: DataFrame) -> DataFrame:
    """One row per (date, symbol): EQ before BE, then the one with more of close and value, then by all measures."""
    rank = F.when(F.col("series") == "EQ", 0).when(F.col("series") == "BE", 1).otherwise(2) if "series" in df.columns else F.lit(0)
    held = [c for c in ("close", "tottrdval") if c in df.columns]
    density = sum((F.col(c).isNotNull().cast("int") for c in held), F.lit(0))
    ties = [F.col(c).desc_nulls_last() for c in ("tottrdval", "tottrdqty", "close", "open", "high", "low") if c in df.columns]
    order = Window.partitionBy("trade_date", "symbol").orderBy(rank, density.desc(), *ties)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def flag_quality(df: DataFrame) -> DataFrame:
    """is_missing_ohlc, is_suspended and is_liquidated (false until the grid decides)."""
    ohlc = [c for c in ("open", "high", "low", "close") if c in df.columns]
    missing = F.lit(False)
    for c in ohlc:
        missing = missing | F.col(c).isNull()
    if "close" in ohlc:
        missing = missing | F.coalesce(F.col("close") <= 0, F.lit(True))
    idle = F.lit(False)
    for c in ("tottrdqty", "tottrdval"):
        if c in df.columns:
            idle = idle | (F.coalesce(F.col(c), F.lit(0.0)) <= 0)
    return df.withColumns({"is_missing_ohlc": missing, "is_suspended": idle | missing, "is_liquidated": F.lit(False)})


def liquidation_grid(df: DataFrame, calendar: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The panel on calendar x symbols, so that a name that stops trading stays in sight.

    After its last close a name is liquidated; without a close before that it is suspended (rows
    before the first trade too). Dates off the calendar go, and names off the list. The panel's own
    rows stay as they are; per symbol one row gathers its dates and its last close, and only the
    calendar's other dates are added, so all of it is dealt by symbol.
    """
    df = cast_types(df)
    if "is_suspended" not in df.columns:
        df = flag_quality(df)
    rows = df
    if calendar is not None:
        rows = rows.join(calendar.select("trade_date").distinct(), "trade_date", "left_semi")
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    rows = rows.where("trade_date is not null and symbol is not null")
    dates = (calendar if calendar is not None else df).where("trade_date is not null").agg(F.sort_array(F.collect_set("trade_date")).alias("_dates"))  # a date is 4 bytes
    closed = F.max(F.when(F.col("close").isNotNull(), F.col("trade_date")))
    listed = df.select("symbol").where("symbol is not null").distinct() if symbols is None else symbols.select("symbol").where("symbol is not null").distinct()
    free = calendar is None and symbols is None
    names = (df.where("symbol is not null") if free else rows).groupBy("symbol").agg(closed.alias("_last"), F.collect_set("trade_date").alias("_seen"))
    if not free:  # names that have no row on the calendar
        names = listed.join(names, "symbol", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<date>")))
    empty = names.crossJoin(F.broadcast(dates)).select("symbol", "_last", F.explode(F.array_except("_dates", "_seen")).alias("trade_date"))  # one row on the right
    own = rows.repartition("symbol").withColumn("_last", closed.over(Window.partitionBy("symbol")))
    rows = own.unionByName(empty, allowMissingColumns=True).select("trade_date", "symbol", *[c for c in df.columns if c not in ("trade_date", "symbol")], "_last")
    gone = F.coalesce(F.col("trade_date") > F.col("_last"), F.lit(False))
    shut = F.coalesce(F.col("is_suspended"), F.lit(False)) | (F.col("close").isNull() & ~gone) | gone
    return rows.withColumns({"is_liquidated": gone, "is_suspended": shut, "is_missing_ohlc": F.coalesce(F.col("is_missing_ohlc"), F.col("close").isNull())}).drop("_last")


def clean_prices(df: DataFrame, symbol_map: SymbolMap | None = None, *, apply_calendar: bool = False, calendar: DataFrame | None = None) -> DataFrame:
    """Types, symbols, series, duplicates, flags; then the grid where asked for."""
    out = df.transform(cast_types).transform((symbol_map or SymbolMap()).normalize).transform(filter_series).transform(dedupe).transform(flag_quality)
    return liquidation_grid(out, calendar) if apply_calendar else out
