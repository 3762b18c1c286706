"""Column sets of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _F, _B = T.DateType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PRICE_MEASURES = ["open", "high", "low", "close", "last", "prev_close", "tottrdqty", "tottrdval"]
PRICES = _schema(("trade_date", _D), ("symbol", _S), ("series", _S), *((c, _F) for c in PRICE_MEASURES), ("timestamp", _S))
FUNDAMENTALS = _schema(("as_of_date", _D), ("available_date", _D), ("symbol", _S), ("market_cap", _F), ("book_value", _F), ("book_to_market", _F))
UNIVERSE = _schema(("as_of_date", _D), ("symbol", _S), ("company_name", _S), ("industry", _S), ("isin", _S))
RISK_FREE = _schema(("date", _D), ("annualized_yield", _F), ("daily_rf", _F), ("source", _S))
SHARES = _schema(("as_of_date", _D), ("symbol", _S), ("shares", _F))
MARKET_EQUITY = _schema(("as_of_date", _D), ("symbol", _S), ("close", _F), ("shares", _F), ("market_cap", _F), ("price_date", _D), ("shares_date", _D))
ADJUSTMENTS = _schema(("trade_date", _D), ("symbol", _S), ("adj_factor", _F), ("yf_adj_close", _F))
WEIGHTS = _schema(("trade_date", _D), ("symbol", _S), ("quantile", T.IntegerType()), ("weight", _F), ("is_long", _B), ("is_short", _B))
PREMIA = _schema(("name", _S), ("mean", _F), ("nw_se", _F), ("t_stat", _F), ("p_value", _F), ("n_periods", _F))
DIAGNOSTICS = _schema(("section", _S), ("name", _S), ("value", _F), ("t_stat", _F), ("nw_se", _F))
ADJUSTABLE = ["open", "high", "low", "close", "last", "prev_close"]
RETURN_COLUMNS = ["trade_date", "symbol", "adj_close", "ret", "log_ret", "excess_ret", "daily_rf", "is_liquidated", "is_suspended"]
RETURN_EXTRAS = ["series", "tottrdqty", "tottrdval", "adj_factor", "close", "is_missing_ohlc", "rf_source"]
