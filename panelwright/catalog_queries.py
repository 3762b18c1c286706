"""Registry of the engine's queries over the driver's tables, each with its SQL twin.

Doubles that pass through sums of floats, logarithms or products are rounded to 8 places on both
sides (10 before they are ranked); everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .functions.sqlforms import VALUE_WEIGHT, buckets, long_short, nearest, terciles
from .operators import calendars, clean, cross_section, factors, fundamentals, metrics, overview, portfolio, regress, returns, signals
from .plans import panels as P
from .plans import returns_pipeline, tearsheet
from .sources import html_tables, prices, reference, vendor_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def stats8() -> list:
    """The summary's doubles; the total return r as r / (1 + |r|), as it may have more than 15 digits before the point."""
    return [*r8(*metrics.STATS[1:-1]), F.round(F.col("total_return") / (1 + F.abs("total_return")), 8).alias("bounded_return")]


def r8(*columns: str) -> list:
    return [F.round(c, 8).alias(c) for c in columns]


def _sm(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_returns(P.supplier_month(spark, sf))


def _sd(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_returns(P.supplier_day(spark, sf))


def _mom(df: DataFrame) -> DataFrame:
    return signals.attach_momentum(df, 12, 1).withColumn("mom_12_1", F.round("mom_12_1", 10))


R, RD = f"{P.SM}, {P.returns_sql('sm', 'r')}", f"{P.SD}, {P.returns_sql('sd', 'r')}"
_FRAME = "over (partition by symbol order by trade_date rows between 11 preceding and 1 preceding)"
MOM = f"{R}, mom as (select *, case when count(*) {_FRAME} >= 5 then round(exp(sum(ln(1 + coalesce(ret, 0))) {_FRAME}) - 1, 10) end as mom_12_1 from r)"
_ILL = "case when ret is not null and tottrdval > 0 then abs(ret) / tottrdval end"


def illiq_sql(window: int, source: str = "r") -> str:
    least = max(1, window // 2)
    frame = f"over (partition by symbol order by trade_date rows between {window - 1} preceding and current row)"
    return f"""ill as (select *, {_ILL} as illiq from {source}),
        roll as (select *, case when count(illiq) {frame} >= {least} then avg(illiq) {frame} end as illiq_roll from ill),
        sig as (select *, lag(illiq_roll) over (partition by symbol order by trade_date) as illiq_signal from roll)"""


# returns ------------------------------------------------------------------------------------------


@query(f"with {R} select trade_date, symbol, ret from r")
def simple_returns(spark, sf):
    return _sm(spark, sf).select("trade_date", "symbol", "ret")


@query(f"with {R} select trade_date, symbol, round(log_ret, 8) as log_ret from r")
def log_returns(spark, sf):
    return _sm(spark, sf).select("trade_date", "symbol", *r8("log_ret"))


_GRID = f"""{P.SD}, grid as (select trade_date, symbol from (select distinct trade_date from sd) cross join (select distinct symbol from sd)),
    full_ as (select g.trade_date, g.symbol, s.close, s.tottrdqty, s.tottrdval, max(case when s.close is not null then g.trade_date end) over (partition by g.symbol) as last_date
              from grid g left join sd s on g.trade_date = s.trade_date and g.symbol = s.symbol),
    liq as (select trade_date, symbol, close, tottrdval, coalesce(trade_date > last_date, false) as is_liquidated,
              close is null as is_missing_ohlc, close is null or coalesce(tottrdqty, 0) <= 0 or coalesce(tottrdval, 0) <= 0 as is_suspended from full_)"""


@query(f"with {_GRID} select trade_date, symbol, case when not is_liquidated then close / lag(close) over (partition by symbol order by trade_date) - 1 end as ret from liq")
def gap_returns_null(spark, sf):
    grid = clean.liquidation_grid(clean.flag_quality(P.supplier_day(spark, sf)))
    return returns.price_returns(returns.ensure_adj_close(grid)).select("trade_date", "symbol", "ret")


@query(
    f"""with {P.SM} select trade_date, symbol, close, close * (1 + (month(trade_date) % 2)) as adj_close,
        case when close <> 0 then close * (1 + (month(trade_date) % 2)) / close end as factor_back from sm"""
)
def adjust_prices(spark, sf):
    panel = P.supplier_month(spark, sf).withColumn("adj_factor", (1 + F.month("trade_date") % 2).cast("double"))
    out = returns.apply_factor(panel)
    return out.select("trade_date", "symbol", "close", "adj_close", returns.adjustment_factor(F.col("close"), F.col("adj_close")).alias("factor_back"))


# cleaning -----------------------------------------------------------------------------------------


@query(
    f"""with {P.SDS} select trade_date, symbol, series, close, tottrdval from sds
        qualify row_number() over (partition by trade_date, symbol order by case series when 'EQ' then 0 when 'BE' then 1 else 2 end) = 1"""
)
def dedupe_prefer_eq(spark, sf):
    return clean.dedupe(P.supplier_day_series(spark, sf)).select("trade_date", "symbol", "series", "close", "tottrdval")


@query(f"with {P.SDS} select trade_date, symbol, series, close from sds where series in ('EQ', 'BE')")
def series_filter(spark, sf):
    return clean.filter_series(P.supplier_day_series(spark, sf)).select("trade_date", "symbol", "series", "close")




@query(
    f"""with {P.SD}, thin as (select *, case when day(trade_date) % 7 = 0 then null else close end as c, case when day(trade_date) % 5 = 0 then 0.0::double else tottrdqty end as q from sd)
        select trade_date, symbol, coalesce(c <= 0, true) as is_missing_ohlc, q <= 0 or tottrdval <= 0 or coalesce(c <= 0, true) as is_suspended, false as is_liquidated from thin"""
)
def quality_flags(spark, sf):
    day = F.dayofmonth("trade_date")
    thin = P.supplier_day(spark, sf).withColumns({"close": F.when(day % 7 != 0, F.col("close")), "tottrdqty": F.when(day % 5 == 0, 0.0).otherwise(F.col("tottrdqty"))})
    return clean.flag_quality(thin).select("trade_date", "symbol", *clean.FLAGS)


@query(f"with {_GRID} select trade_date, symbol, close, is_liquidated, is_suspended, is_missing_ohlc from liq")
def calendar_grid_liquidation(spark, sf):
    grid = clean.liquidation_grid(clean.flag_quality(P.supplier_day(spark, sf)))
    return grid.select("trade_date", "symbol", "close", "is_liquidated", "is_suspended", "is_missing_ohlc")


@query(
    f"""with {P.SDS}, one as (select * from sds where series in ('EQ', 'BE') qualify row_number() over (partition by trade_date, symbol order by case series when 'EQ' then 0 else 1 end) = 1)
        select trade_date, symbol, series, close, tottrdqty, tottrdval, false as is_suspended, false as is_missing_ohlc, false as is_liquidated from one"""
)
def clean_prices(spark, sf):
    return clean.clean_prices(P.supplier_day_series(spark, sf)).select("trade_date", "symbol", "series", "close", "tottrdqty", "tottrdval", *clean.FLAGS)


@query(f"with {P.SD} select distinct trade_date from sd")
def trading_calendar(spark, sf):
    return calendars.trading_calendar(P.supplier_day(spark, sf))


@query(
    """select d::date as trade_date from (select unnest(generate_series(date '1995-01-01', date '1998-12-31', interval 1 day)) as d) where isodow(d) < 6"""
)
def weekday_calendar(spark, sf):
    import datetime as dt

    return calendars.weekday_calendar(spark, dt.date(1995, 1, 1), dt.date(1998, 12, 31))


@query(f"with {P.SD} select max(trade_date) as trade_date from sd group by date_trunc('month', trade_date)")
def month_end_dates(spark, sf):
    return calendars.month_ends(P.supplier_day(spark, sf))


@query(f"with {P.SD} select symbol, max(trade_date) as as_of_date from sd group by symbol, date_trunc('month', trade_date)")
def month_end_asof(spark, sf):
    return calendars.month_end_asof(P.supplier_day(spark, sf))


@query(
    """select s_suppkey, case when bare = 'HDFC' then 'HDFCBANK' else bare end as symbol from (
        select s_suppkey, regexp_replace(upper(trim(case s_suppkey % 4 when 0 then ' hdfc.ns ' when 1 then 'S' || s_suppkey || '.BO' when 2 then 's' || s_suppkey || '.nse' else 'S' || s_suppkey end)), '\\.(NS|BO|NSE|BSE)$', '') as bare from supplier)"""
)
def symbol_normalize(spark, sf):
    from .functions.symbols import SymbolMap

    key, k = F.concat(F.lit("S"), "s_suppkey"), F.col("s_suppkey") % 4
    raw = F.when(k == 0, " hdfc.ns ").when(k == 1, F.concat(key, F.lit(".BO"))).when(k == 2, F.concat(F.lower(key), F.lit(".nse"))).otherwise(key)
    return SymbolMap().normalize(P.table(spark, sf, "supplier").select("s_suppkey", raw.alias("symbol")))


# rates --------------------------------------------------------------------------------------------


@query(f"with {P.RF} select date, round(annualized_yield, 10) as annualized_yield, round(daily_rf, 12) as daily_rf, source from rf")
def rf_daily(spark, sf):
    rf = P.risk_free(spark, sf)
    return rf.select("date", F.round("annualized_yield", 10).alias("annualized_yield"), F.round("daily_rf", 12).alias("daily_rf"), "source")


_FILLED = f"{P.RF}, filled as (select c.trade_date as date, rf.annualized_yield, rf.daily_rf, rf.source from (select distinct trade_date from sd) c asof left join rf on c.trade_date >= rf.date)"


@query(f"with {P.SD}, {_FILLED} select date, round(annualized_yield, 10) as annualized_yield, round(daily_rf, 12) as daily_rf, source from filled")
def rf_forward_fill(spark, sf):
    out = returns.forward_fill(P.risk_free(spark, sf), calendars.trading_calendar(P.supplier_day(spark, sf)))
    return out.select("date", F.round("annualized_yield", 10).alias("annualized_yield"), F.round("daily_rf", 12).alias("daily_rf"), "source")


@query(f"with {RD}, {_FILLED} select r.trade_date, r.symbol, round(ret - daily_rf, 8) as excess_ret, source as rf_source from r left join filled on r.trade_date = filled.date")
def excess_returns(spark, sf):
    return returns.attach_rf_excess(_sd(spark, sf), P.risk_free(spark, sf)).select("trade_date", "symbol", *r8("excess_ret"), "rf_source")


@query(
    f"""with {_GRID}, {P.RF}, filled as (select c.trade_date as date, rf.daily_rf from (select distinct trade_date from sd) c asof left join rf on c.trade_date >= rf.date),
        q as (select *, case when not is_liquidated then close / lag(close) over (partition by symbol order by trade_date) end as q from liq)
        select q.trade_date, symbol, close as adj_close, q - 1 as ret, round(ln(q), 8) as log_ret, round(q - 1 - daily_rf, 8) as excess_ret, is_liquidated, is_suspended from q left join filled on q.trade_date = filled.date"""
)
def returns_panel(spark, sf):
    grid = clean.liquidation_grid(clean.flag_quality(P.supplier_day(spark, sf)))
    out = returns.returns_panel(grid, P.risk_free(spark, sf))
    return out.select("trade_date", "symbol", "adj_close", "ret", *r8("log_ret", "excess_ret"), "is_liquidated", "is_suspended")


# fundamentals and universe ------------------------------------------------------------------------


@query(f"with {P.FUND} select symbol, as_of_date, available_date, market_cap, book_value, book_to_market from fund")
def reporting_lag(spark, sf):
    return P.fundamentals(spark, sf).select("symbol", "as_of_date", "available_date", "market_cap", "book_value", "book_to_market")


@query(
    f"""with {P.FUND} select symbol, as_of_date, available_date, market_cap from fund where available_date <= date '1996-06-30'
        qualify row_number() over (partition by symbol order by available_date desc, as_of_date desc) = 1"""
)
def pit_fundamentals_latest(spark, sf):
    import datetime as dt

    return fundamentals.latest_known(P.fundamentals(spark, sf), dt.date(1996, 6, 30)).select("symbol", "as_of_date", "available_date", "market_cap")


_PF = f"{R}, {P.FUND}, {P.PF}"


@query(f"with {_PF} select trade_date, symbol, close, as_of_date, available_date, market_cap, book_to_market from pf")
def fundamentals_asof(spark, sf):
    return P.priced_with_fundamentals(spark, sf).select("trade_date", "symbol", "close", "as_of_date", "available_date", "market_cap", "book_to_market")


_SHARES = "shares as (select as_of_date as shares_date, symbol, market_cap / 10 as shares from fund)"
_ASK = "ask as (select distinct symbol, last_day(trade_date) as as_of_date from sd)"


@query(
    f"""with {P.SD}, {P.FUND}, {_SHARES}, {_ASK}, one as (select ask.*, sd.close, sd.trade_date as price_date from ask asof left join sd on ask.symbol = sd.symbol and ask.as_of_date >= sd.trade_date)
        select one.as_of_date, one.symbol, one.close, s.shares, one.close * s.shares as market_cap, one.price_date, s.shares_date
        from one asof left join shares s on one.symbol = s.symbol and one.as_of_date >= s.shares_date"""
)
def market_equity_asof(spark, sf):
    closes = P.supplier_day(spark, sf)
    ask = closes.select("symbol", F.last_day("trade_date").alias("as_of_date")).distinct()
    shares = P.fundamentals(spark, sf).select("as_of_date", "symbol", (F.col("market_cap") / 10).alias("shares"))
    return fundamentals.market_equity_asof(ask, closes, shares)


_NEW_ME = "select symbol, as_of_date, market_cap * 2 as market_cap from fund where month(as_of_date) = 3 union all select symbol, (as_of_date + interval 1 day)::date, market_cap from fund where month(as_of_date) = 6"


@query(
    f"""with {P.FUND}, me as ({_NEW_ME}), merged as (
            select symbol, as_of_date, case when f.symbol is null and f.available_date is null then as_of_date else f.available_date end as available_date, coalesce(me.market_cap, f.market_cap) as market_cap, f.book_value, f.book_to_market
            from fund f full join me using (symbol, as_of_date))
        select symbol, as_of_date, available_date, market_cap, book_value, coalesce(case when book_value is not null and market_cap > 0 then book_value / market_cap end, book_to_market) as book_to_market from merged"""
)
def merge_me_overlay(spark, sf):
    base = P.fundamentals(spark, sf)
    twice = base.where(F.month("as_of_date") == 3).select("symbol", "as_of_date", (F.col("market_cap") * 2).alias("market_cap"))
    later = base.where(F.month("as_of_date") == 6).select("symbol", F.date_add("as_of_date", 1).alias("as_of_date"), "market_cap")
    return fundamentals.overlay_equity(base, twice.union(later))


_NEW_BOOK = """select symbol, as_of_date, (available_date + interval 1 month)::date as available_date, null::double as market_cap, book_value * 3 as book_value, null::double as book_to_market from fund where month(as_of_date) = 3
    union all select symbol, (as_of_date + interval 1 day)::date, available_date, null, book_value, null from fund where month(as_of_date) = 6"""


@query(
    f"""with {P.FUND}, b as ({_NEW_BOOK}), merged as (
            select symbol, as_of_date, case when b.book_value is not null then b.available_date else f.available_date end as available_date, f.market_cap, coalesce(b.book_value, f.book_value) as book_value, f.book_to_market
            from fund f full join b using (symbol, as_of_date))
        select symbol, as_of_date, available_date, market_cap, book_value, coalesce(case when book_value is not null and market_cap > 0 then book_value / market_cap end, book_to_market) as book_to_market from merged"""
)
def merge_book_overlay(spark, sf):
    base, none = P.fundamentals(spark, sf), F.lit(None).cast("double")
    march = base.where(F.month("as_of_date") == 3).select(
        "symbol", "as_of_date", F.add_months("available_date", 1).alias("available_date"), none.alias("market_cap"), (F.col("book_value") * 3).alias("book_value"), none.alias("book_to_market")
    )
    june = base.where(F.month("as_of_date") == 6).select("symbol", F.date_add("as_of_date", 1).alias("as_of_date"), "available_date", none.alias("market_cap"), "book_value", none.alias("book_to_market"))
    return fundamentals.overlay_book(base, march.unionByName(june))


@query(f"with {P.UNI} select as_of_date, symbol from uni where as_of_date = (select max(as_of_date) from uni where as_of_date <= date '1996-08-15')")
def pit_universe(spark, sf):
    import datetime as dt

    return fundamentals.members_on(P.universe(spark, sf), dt.date(1996, 8, 15))


@query(f"with {P.SM}, {P.UNI} select d.trade_date, u.symbol, u.as_of_date from (select distinct trade_date from sm) d join uni u on u.as_of_date = (select max(as_of_date) from uni where as_of_date <= d.trade_date)")
def membership_on_dates(spark, sf):
    return fundamentals.membership_on_dates(P.universe(spark, sf), calendars.trading_calendar(P.supplier_month(spark, sf)))


# characteristics ----------------------------------------------------------------------------------


@query(f"with {RD} select trade_date, symbol, {_ILL} as illiq from r")
def amihud_daily(spark, sf):
    return signals.attach_illiq(_sd(spark, sf)).select("trade_date", "symbol", "illiq")


@query(f"with {RD}, {illiq_sql(30)} select trade_date, symbol, round(illiq_roll * 1e6, 8) as illiq_roll from sig")
def amihud_rolling(spark, sf):
    return signals.attach_rolling_illiq(_sd(spark, sf)).select("trade_date", "symbol", F.round(F.col("illiq_roll") * 1e6, 8).alias("illiq_roll"))


@query(f"with {RD}, {illiq_sql(30)} select trade_date, symbol, round(illiq_signal * 1e6, 8) as illiq_signal from sig")
def amihud_signal(spark, sf):
    return signals.attach_illiq_signal(_sd(spark, sf)).select("trade_date", "symbol", F.round(F.col("illiq_signal") * 1e6, 8).alias("illiq_signal"))


@query(f"with {MOM} select trade_date, symbol, mom_12_1 from mom")
def momentum_12_1(spark, sf):
    return _mom(_sm(spark, sf)).select("trade_date", "symbol", "mom_12_1")


@query(f"with {_PF} select trade_date, symbol, market_cap as me, round(ln(market_cap), 8) as log_me from pf")
def size_char(spark, sf):
    return signals.attach_size(P.priced_with_fundamentals(spark, sf)).select("trade_date", "symbol", "me", *r8("log_me"))


@query(f"with {_PF} select trade_date, symbol, book_to_market as btm from pf")
def value_char(spark, sf):
    return signals.attach_value(P.priced_with_fundamentals(spark, sf)).select("trade_date", "symbol", "btm")


@query(f"with {R} select trade_date, symbol, lag(ret, 2) over (partition by symbol order by trade_date) as ret_lag2 from r", name="lag_signal")
def lag_signal_query(spark, sf):
    return signals.lag_signal(_sm(spark, sf), "ret", 2).select("trade_date", "symbol", "ret_lag2")


# cross-sections -----------------------------------------------------------------------------------

_CUT = f"cut as (select r.*, case when ret is not null then least(greatest(ret, lo), hi) end as ret_w from r join (select trade_date as td, {nearest('ret', 0.01, '')} as lo, {nearest('ret', 0.99, '')} as hi from r group by trade_date) on trade_date = td)"


@query(f"with {R}, {_CUT} select trade_date, symbol, ret_w from cut")
def winsorize_pct(spark, sf):
    return cross_section.winsorize(_sm(spark, sf), "ret").select("trade_date", "symbol", "ret_w")


@query(
    f"""with {R}, m as (select *, median(ret) over (partition by trade_date) as m from r), d as (select *, median(abs(ret - m)) over (partition by trade_date) as d from m)
        select trade_date, symbol, round(case when ret is null or not (d > 0) then ret else least(greatest(ret, m - d * 3), m + d * 3) end, 8) as ret_w from d"""
)
def winsorize_mad(spark, sf):
    return cross_section.winsorize(_sm(spark, sf), "ret", "mad").select("trade_date", "symbol", *r8("ret_w"))


def _z(x: str) -> str:
    return f"case when stddev_samp({x}) over (partition by trade_date) > 0 then ({x} - avg({x}) over (partition by trade_date)) / stddev_samp({x}) over (partition by trade_date) end"


@query(f"with {R} select trade_date, symbol, round({_z('ret')}, 8) as ret_z from r")
def zscore(spark, sf):
    return cross_section.zscore(_sm(spark, sf), "ret").select("trade_date", "symbol", *r8("ret_z"))


@query(f"with {R}, {_CUT} select trade_date, symbol, ret_w, round({_z('ret_w')}, 8) as ret_z from cut")
def prepare_signal(spark, sf):
    return cross_section.prepare_signal(_sm(spark, sf), "ret").select("trade_date", "symbol", "ret_w", *r8("ret_z"))


@query(f"with {R}, {buckets('r', 'b', 'ret', 5)} select trade_date, symbol, coalesce(quantile, 0) as quantile from b")
def quantile_buckets_quintile(spark, sf):
    return cross_section.sorts(_sm(spark, sf), "ret", "quintile").select("trade_date", "symbol", F.coalesce("quantile", F.lit(0)).alias("quantile"))


@query(f"with {P.EU}, {buckets('eu', 'b', 'close', 10)} select trade_date, symbol, coalesce(quantile, 0) as quantile from b")
def quantile_buckets_decile(spark, sf):
    return cross_section.sorts(P.user_day(spark, sf), "close", "decile").select("trade_date", "symbol", F.coalesce("quantile", F.lit(0)).alias("quantile"))


@query(f"with {R} select trade_date, symbol, case when ret is null then null when ret <= median(ret) over (partition by trade_date) then 'S' else 'B' end as size_bucket from r")
def median_split(spark, sf):
    return cross_section.median_split(_sm(spark, sf), "ret").select("trade_date", "symbol", "size_bucket")


@query(f"with {R}, {terciles('r', 't', 'ret', 'label')} select trade_date, symbol, label from t")
def tercile_labels(spark, sf):
    return cross_section.tercile_labels(_sm(spark, sf), "ret").select("trade_date", "symbol", "label")


# factors ------------------------------------------------------------------------------------------

_SIZE = "sized as (select *, case when market_cap is null then null when market_cap <= median(market_cap) over (partition by trade_date) then 'S' else 'B' end as sz from pf)"
_SMB = long_short("sized", "sz = 'S'", "sz = 'B'", "SMB", VALUE_WEIGHT)
_HML = long_short("valued", "val = 'H' and sz is not null", "val = 'L' and sz is not null", "HML", VALUE_WEIGHT)


@query(f"with {_PF}, {_SIZE} select trade_date, round(SMB, 8) as SMB from ({_SMB})")
def factor_smb(spark, sf):
    return factors.smb(P.priced_with_fundamentals(spark, sf)).select("trade_date", *r8("SMB"))


@query(f"with {_PF}, {_SIZE}, {terciles('sized', 'valued', 'book_to_market', 'val')} select trade_date, round(HML, 8) as HML from ({_HML})")
def factor_hml(spark, sf):
    return factors.hml(P.priced_with_fundamentals(spark, sf)).select("trade_date", *r8("HML"))


_WML = long_short("momt", "lab = 'H'", "lab = 'L'", "WML")


@query(f"with {MOM}, {terciles('mom', 'momt', 'mom_12_1', 'lab')} select trade_date, round(WML, 8) as WML from ({_WML})")
def factor_wml(spark, sf):
    return factors.wml(_mom(_sm(spark, sf)), weighting="equal").select("trade_date", *r8("WML"))


_LIQ = "liqd as (select * exclude (illiq_signal), round(illiq_signal * 1e6, 10) as illiq_signal from sig)"
_ILQ = long_short("liqt", "lab2 = 'H'", "lab2 = 'L'", "ILLIQ")


def _liq(df: DataFrame, window: int = 6) -> DataFrame:
    return signals.attach_illiq_signal(df, window).withColumn("illiq_signal", F.round(F.col("illiq_signal") * 1e6, 10))


@query(f"with {R}, {illiq_sql(6)}, {_LIQ}, {terciles('liqd', 'liqt', 'illiq_signal', 'lab2')} select trade_date, round(ILLIQ, 8) as ILLIQ from ({_ILQ})")
def factor_illiq(spark, sf):
    return factors.illiq_factor(_liq(_sm(spark, sf)), weighting="equal").select("trade_date", *r8("ILLIQ"))


_FACTORS = f"{MOM}, {illiq_sql(6, 'mom')}, {_LIQ}, {terciles('liqd', 'momt', 'mom_12_1', 'lab')}, {terciles('momt', 'liqt', 'illiq_signal', 'lab2')}, fac as (select trade_date, WML, ILLIQ from ({_WML}) full join ({_ILQ}) using (trade_date))"


def _factor_panel(spark, sf) -> DataFrame:
    return factors.factor_returns(_liq(_mom(_sm(spark, sf))), size=False, value=False)


@query(f"with {_FACTORS} select trade_date, round(WML, 8) as WML, round(ILLIQ, 8) as ILLIQ from fac")
def factor_panel_full_outer(spark, sf):
    return _factor_panel(spark, sf).select("trade_date", *r8("WML", "ILLIQ"))


@query(f"with {R} select trade_date, round(avg(ret), 8) as MKT from r where ret is not null group by trade_date")
def market_ew(spark, sf):
    return factors.equal_weight_market(_sm(spark, sf)).select("trade_date", *r8("MKT"))


# portfolios ---------------------------------------------------------------------------------------


@query(f"with {R}, {P.UNI} select trade_date, symbol, ret from r where ret is not null and (trade_date, symbol) in (select as_of_date, symbol from uni)")
def eligibility_semi_join(spark, sf):
    uni = P.universe(spark, sf).withColumnRenamed("as_of_date", "trade_date")
    return portfolio.filter_eligible(_sm(spark, sf), uni).select("trade_date", "symbol", "ret")


def _weights_sql(source: str, w: str) -> str:
    return f"""wts as (select trade_date, symbol, quantile, case when quantile = 5 then 0.5::double else -0.5::double end * ({w} / sum({w}) over (partition by trade_date, quantile)) as weight,
        quantile = 5 as is_long, quantile = 1 as is_short from {source} where quantile in (1, 5))"""


_B5 = buckets("mom", "b", "mom_12_1", 5)
_EQ = f"{MOM}, {_B5}, {_weights_sql('b', '1.0::double')}"


def _weights(spark, sf) -> DataFrame:
    return portfolio.form_portfolio(_mom(_sm(spark, sf)), "mom_12_1")


@query(f"with {_EQ} select trade_date, symbol, quantile, round(weight, 8) as weight, is_long, is_short from wts")
def ls_weights_equal(spark, sf):
    return _weights(spark, sf).select("trade_date", "symbol", "quantile", *r8("weight"), "is_long", "is_short")


@query(
    f"""with {_PF}, {buckets('pf', 'b', 'ret', 5)}, cap as (select * from b where market_cap > 0), {_weights_sql('cap', 'market_cap')}
        select trade_date, symbol, quantile, round(weight, 8) as weight, is_long, is_short from wts"""
)
def ls_weights_value(spark, sf):
    out = portfolio.form_portfolio(P.priced_with_fundamentals(spark, sf), "ret", weighting="value")
    return out.select("trade_date", "symbol", "quantile", *r8("weight"), "is_long", "is_short")


@query(f"with {_EQ} select trade_date, round(sum(abs(weight)), 8) as gross, count(*) filter (is_long) as n_long, count(*) filter (is_short) as n_short from wts group by trade_date")
def weights_by_date(spark, sf):
    return portfolio.weights_by_date(_weights(spark, sf)).select("trade_date", *r8("gross"), "n_long", "n_short")


_HELD = """names as (select distinct symbol from wts), days as (select distinct trade_date from mom),
    asof_ as (select g.trade_date, g.symbol, w.weight from (select * from days cross join names) g asof left join wts w on g.symbol = w.symbol and g.trade_date >= w.trade_date),
    held as (select * from (select trade_date, symbol, lag(weight) over (partition by symbol order by trade_date) as weight from asof_) where weight is not null)"""


@query(f"with {_EQ}, {_HELD} select trade_date, symbol, round(weight, 8) as weight from held")
def propagate_weights(spark, sf):
    held = portfolio.propagate(_weights(spark, sf), calendars.trading_calendar(P.supplier_month(spark, sf)))
    return held.select("trade_date", "symbol", *r8("weight"))


_TURN = """forms as (select trade_date, row_number() over (order by trade_date) as k from (select distinct trade_date from wts)),
    chg as (select coalesce(c.k, p.k + 1) as k, coalesce(c.weight, 0) - coalesce(p.weight, 0) as d
        from (select f.k, w.symbol, w.weight from wts w join forms f using (trade_date)) c full join (select f.k, w.symbol, w.weight from wts w join forms f using (trade_date)) p on c.symbol = p.symbol and c.k = p.k + 1),
    turn as (select f.trade_date, f.k, case when f.k = 1 then 0 else t.one end as turnover_one_way, case when f.k = 1 then 0 else t.two end as turnover_two_way
        from forms f join (select k, sum(greatest(d, 0)) as one, sum(abs(d)) / 2 as two from chg group by k) t on f.k = t.k)"""


@query(f"with {_EQ}, {_TURN} select trade_date, round(turnover_one_way, 8) as turnover_one_way, round(turnover_two_way, 8) as turnover_two_way from turn")
def turnover(spark, sf):
    return portfolio.turnover(_weights(spark, sf)).select("trade_date", *r8("turnover_one_way", "turnover_two_way"))


@query(f"with {_EQ}, {_TURN} select round(coalesce(avg(turnover_one_way), 0), 8) as avg_turnover_one_way, round(coalesce(avg(turnover_two_way), 0), 8) as avg_turnover_two_way from turn where k > 1")
def avg_turnover(spark, sf):
    return portfolio.average_turnover(portfolio.turnover(_weights(spark, sf))).select(*r8("avg_turnover_one_way", "avg_turnover_two_way"))


_PNL = f"""{_EQ}, {_HELD}, {_TURN}, pnl as (select p.trade_date, gross_ret, coalesce(turnover_two_way * 10 / 10000, 0) as tc, gross_ret - coalesce(turnover_two_way * 10 / 10000, 0) as net_ret
    from (select h.trade_date, coalesce(sum(h.weight * r.ret), 0) as gross_ret from held h left join r on h.trade_date = r.trade_date and h.symbol = r.symbol group by h.trade_date) p left join turn t on p.trade_date = t.trade_date),
    wealth as (select *, product(1 + net_ret) over (order by trade_date rows unbounded preceding) as wealth from pnl)"""


def _backtest(spark, sf) -> portfolio.BacktestResult:
    config = portfolio.BacktestConfig("mom_12_1", tc_bps=10.0, validate_weights=False)
    return portfolio.run_backtest(_mom(_sm(spark, sf)), config)


@query(f"with {_PNL} select trade_date, round(gross_ret, 8) as gross_ret, round(tc, 8) as tc, round(net_ret, 8) as net_ret from pnl")
def backtest_pnl_net(spark, sf):
    return _backtest(spark, sf).pnl.select("trade_date", *r8("gross_ret", "tc", "net_ret"))


@query(f"with {_PNL} select trade_date, round(wealth, 8) as wealth from wealth")
def wealth(spark, sf):
    return _backtest(spark, sf).pnl.select("trade_date", *r8("wealth"))


@query(f"with {_PNL} select trade_date, round(wealth / max(wealth) over (order by trade_date rows unbounded preceding) - 1, 8) as drawdown from wealth")
def drawdown(spark, sf):
    return metrics.drawdown_path(_backtest(spark, sf).pnl).select("trade_date", *r8("drawdown"))


def _summary_sql(source: str, ret: str, by: str = "") -> str:
    part, group = (f"partition by {by} ", f"group by {by}") if by else ("", "")
    lead = f"{by}, " if by else ""
    return f"""select {lead}count({ret})::double as n_obs, round(avg({ret}), 8) as mean, round(stddev_samp({ret}), 8) as std, round(avg({ret}) * 252, 8) as ann_mean, round(stddev_samp({ret}) * sqrt(252), 8) as ann_vol,
        round(sqrt(252) * avg({ret}) / stddev_samp({ret}), 8) as sharpe, round(min(wlt / pk - 1), 8) as max_drawdown, round(avg(({ret} > 0)::int), 8) as hit_rate, round((max_by(wlt, trade_date) - 1) / (1 + abs(max_by(wlt, trade_date) - 1)), 8) as bounded_return
        from (select *, max(wlt) over ({part}order by trade_date rows unbounded preceding) as pk from (select *, product(1 + {ret}) over ({part}order by trade_date rows unbounded preceding) as wlt from {source})) {group}"""


@query(f"with {_PNL} {_summary_sql('pnl', 'net_ret')}")
def return_summary(spark, sf):
    out = metrics.summary(_backtest(spark, sf).pnl, "net_ret")
    return out.select("n_obs", *stats8())


_SPREAD = f"{MOM}, {_B5}, spread as (select trade_date, quantile, avg(ret) as q_ret from b where quantile is not null and ret is not null group by all)"


@query(f"with {_SPREAD} select trade_date, quantile, round(q_ret, 8) as q_ret from spread")
def quantile_spread(spark, sf):
    return portfolio.quantile_spread(_mom(_sm(spark, sf)), "mom_12_1").select("trade_date", "quantile", *r8("q_ret"))


@query(f"with {_SPREAD} {_summary_sql('spread', 'q_ret', 'quantile')}")
def quantile_metrics(spark, sf):
    out = metrics.quantile_metrics(portfolio.quantile_spread(_mom(_sm(spark, sf)), "mom_12_1"))
    return out.select("quantile", "n_obs", *stats8())


# statistics ---------------------------------------------------------------------------------------


@query(
    f"""with {_FACTORS}, k as (select * from fac where WML is not null and ILLIQ is not null), c as (select corr(WML, ILLIQ) as c from k)
        select 'WML' as factor, 1.0::double as WML, round(c, 8) as ILLIQ from c union all select 'ILLIQ', round(c, 8), 1.0::double from c"""
)
def factor_corr(spark, sf):
    return metrics.correlation_matrix(_factor_panel(spark, sf), ["WML", "ILLIQ"]).select("factor", *r8("WML", "ILLIQ"))


def _nw_sql(source: str, value: str, by: str, extra: str = "") -> str:
    """Robust means per ``by`` of a source with trade_date."""
    return f"""nw_x as (select {by} as g, {value} as v, row_number() over (partition by {by} order by trade_date) as i, count(*) over (partition by {by}) as n, avg({value}) over (partition by {by}) as m from {source} where {value} is not null),
        nw_e as (select *, v - m as e, greatest(least(floor(4 * power(n / 100.0::double, 2.0::double / 9)), n - 1), 0)::int as L from nw_x),
        nw_c as (select a.g, sum(a.e * b.e * case when a.i = b.i then 1 else 2 * (1 - (a.i - b.i) / (a.L + 1.0::double)) end) as s from nw_e a join nw_e b on a.g = b.g and b.i <= a.i and a.i - b.i <= a.L group by a.g),
        nw as (select c.g as name, any_value(e.m) as mean, case when any_value(e.L) > 0 then sqrt(greatest(any_value(c.s), 0)) / any_value(e.n) else sqrt(any_value(c.s) / ((any_value(e.n) - 1) * any_value(e.n)::double)) end as nw_se, any_value(e.n)::double as n_periods
            from nw_c c join nw_e e on c.g = e.g group by c.g having any_value(e.n) >= 2)"""


_NW_OUT = "select name, round(mean, 8) as mean, round(nw_se, 8) as nw_se, round(mean / nw_se, 6) as t_stat, n_periods from nw"


def _nw_columns(df: DataFrame) -> DataFrame:
    return df.select("name", *r8("mean", "nw_se"), F.round("t_stat", 6).alias("t_stat"), "n_periods")


@query(f"with {MOM}, {terciles('mom', 'momt', 'mom_12_1', 'lab')}, w as ({_WML}), {_nw_sql('w', 'WML', chr(39) + 'WML' + chr(39))} {_NW_OUT}")
def newey_west_mean(spark, sf):
    series = factors.wml(_mom(_sm(spark, sf)), weighting="equal").withColumn("name", F.lit("WML"))
    return _nw_columns(regress.newey_west(series, "WML", ["name"], pvalues=False))


_MKT = "mkt as (select trade_date, avg(ret) as MKT from r where ret is not null group by trade_date)"
_BETA = f"{R}, {_MKT}, betas as (select symbol, count(*) as n_obs, regr_intercept(ret, MKT) as alpha, regr_slope(ret, MKT) as beta_MKT from r join mkt using (trade_date) where ret is not null group by symbol having count(*) >= 60)"


@query(f"with {_BETA} select symbol, n_obs, round(alpha, 8) as alpha, round(beta_MKT, 8) as beta_MKT from betas")
def ts_betas_single(spark, sf):
    panel = _sm(spark, sf)
    return regress.time_series_betas(panel, factors.equal_weight_market(panel), ["MKT"], "ret").select("symbol", "n_obs", *r8("alpha", "beta_MKT"))


_GAMMA = f"{MOM}, gam as (select trade_date, regr_intercept(ret, mom_12_1) as intercept, regr_slope(ret, mom_12_1) as mom_12_1 from mom where ret is not null and mom_12_1 is not null group by trade_date having count(*) >= 20)"


@query(f"with {_GAMMA} select trade_date, round(intercept, 8) as intercept, round(mom_12_1, 8) as mom_12_1 from gam")
def fm_gamma_single(spark, sf):
    out = regress.fama_macbeth(_mom(_sm(spark, sf)), ["mom_12_1"], "ret", pvalues=False)
    return out.path.select("trade_date", *r8("intercept", "mom_12_1"))


@query(f"with {_GAMMA}, long_ as (select trade_date, 'intercept' as name, intercept as value from gam union all select trade_date, 'mom_12_1', mom_12_1 from gam), {_nw_sql('long_', 'value', 'name')} {_NW_OUT}")
def fm_lambdas_single(spark, sf):
    return _nw_columns(regress.fama_macbeth(_mom(_sm(spark, sf)), ["mom_12_1"], "ret", pvalues=False).lambdas)


@query(
    f"""with {_BETA}, gam as (select trade_date, regr_intercept(ret, beta_MKT) as intercept, regr_slope(ret, beta_MKT) as slope from r join betas using (symbol) where ret is not null group by trade_date having count(*) >= 20),
        long_ as (select trade_date, 'intercept' as name, intercept as value from gam union all select trade_date, 'beta_MKT', slope from gam), {_nw_sql('long_', 'value', 'name')} {_NW_OUT}"""
)
def fm_two_pass(spark, sf):
    panel = _sm(spark, sf)
    return _nw_columns(regress.fama_macbeth_two_pass(panel, factors.equal_weight_market(panel), ["MKT"], "ret", pvalues=False).lambdas)


@query(
    f"""with {_FACTORS}, long_ as (select trade_date, 'WML' as name, WML as value from fac where WML is not null union all select trade_date, 'ILLIQ', ILLIQ from fac where ILLIQ is not null),
        {_nw_sql('long_', 'value', 'name')}, sm_ as ({_summary_sql('long_', 'value', 'name')})
        select sm_.*, round(nw.nw_se, 8) as nw_se, round(nw.mean / nw.nw_se, 6) as t_stat from sm_ join nw using (name)"""
)
def factor_metrics(spark, sf):
    out = regress.factor_metrics(_factor_panel(spark, sf), ["WML", "ILLIQ"], pvalues=False)
    return out.select("name", "n_obs", *stats8(), *r8("nw_se"), F.round("t_stat", 6).alias("t_stat"))


@query()
def fm_p_values(spark, sf):
    """Premia with p-values, which DuckDB has no function for."""
    return regress.fama_macbeth(_mom(_sm(spark, sf)), ["mom_12_1"], "ret").lambdas


@query(
    f"""with {_GAMMA}, {_B5}, spread as (select trade_date, quantile, avg(ret) as q_ret from b where quantile is not null and ret is not null group by all),
        long_ as (select trade_date, 'intercept' as name, intercept as value from gam union all select trade_date, 'mom_12_1', mom_12_1 from gam), {_nw_sql('long_', 'value', 'name')},
        q as ({_summary_sql('spread', 'q_ret', 'quantile')})
        select 'fm_premium' as section, name, round(mean, 8) as value, round(mean / nw_se, 6) as t_stat, round(nw_se, 8) as nw_se from nw
        union all select 'quantile', 'Q' || quantile, sharpe, null, null from q"""
)
def diagnostics_union(spark, sf):
    panel = _mom(_sm(spark, sf))
    premia = regress.fama_macbeth(panel, ["mom_12_1"], "ret", pvalues=False).lambdas
    out = regress.diagnostics(premia, None, metrics.quantile_metrics(portfolio.quantile_spread(panel, "mom_12_1")))
    return out.select("section", "name", *r8("value"), F.round("t_stat", 6).alias("t_stat"), *r8("nw_se"))


# sources, sinks and SQL ---------------------------------------------------------------------------


@query(f"with {P.SD} select trade_date, symbol, close, tottrdqty, tottrdval from sd")
def partitioned_roundtrip(spark, sf):
    path = store.scratch(spark, "roundtrip")
    store.write_partitioned(P.supplier_day(spark, sf), path)
    return store.read_partitioned(spark, path, columns=["trade_date", "symbol", "close", "tottrdqty", "tottrdval"])


@query(f"with {P.SD} select symbol, count(*) as n from sd group by symbol")
def sql_view_count(spark, sf):
    path = store.scratch(spark, "view")
    store.write_partitioned(P.supplier_day(spark, sf), path)
    store.register_view(spark, "panelwright_sd", path)
    return store.sql(spark, "select symbol, count(*) as n from panelwright_sd group by 1")


@query("select event_type, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as k_sum from events group by event_type")
def json_extract(spark, sf):
    rows = P.table(spark, sf, "events").select("event_type", F.from_json("props", "k string").getField("k").try_cast("bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


def _book_pages(spark, sf) -> DataFrame:
    """A page with a balance sheet per supplier, from the month-end quarters' cents."""
    own = P.fundamentals(spark, sf).select("symbol", "as_of_date", F.round(F.col("market_cap") * 100).cast("bigint").alias("a"), F.round(F.col("book_value") * 100).cast("bigint").alias("b"))
    cells = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("as_of_date", "a", "b"))), f), "")
    grouped = own.groupBy("symbol").agg(
        cells(lambda q: F.concat(F.lit("<th>"), F.date_format(q["as_of_date"], "MMM yyyy"), F.lit("</th>"))).alias("head"),
        cells(lambda q: F.concat(F.lit("<td>"), F.format_number(q["a"], 0), F.lit("</td>"))).alias("a"),
        cells(lambda q: F.concat(F.lit("<td>"), F.format_number(q["b"], 0), F.lit("</td>"))).alias("b"),
    )
    table = F.concat(
        F.lit("<html><section id='quarters'><table class='data-table'><tr><td>x</td></tr></table></section><section id='balance-sheet'><table class='data-table'><thead><tr><th></th>"),
        "head", F.lit("</tr></thead><tr><td>Equity Capital</td>"), "a", F.lit("</tr><tr><td>Reserves&nbsp;+</td>"), "b", F.lit("</tr><tr><td>Raw PDF</td></tr></table></section></html>"),
    )
    return grouped.select("symbol", table.alias("html"))


@query(
    f"""with {P.FUND} select symbol, 'Equity Capital' as label, as_of_date, round(market_cap * 100)::bigint::double as value_crore from fund
        union all select symbol, 'Reserves', as_of_date, round(book_value * 100)::bigint::double from fund"""
)
def html_balance_sheet(spark, sf):
    return html_tables.balance_sheets(_book_pages(spark, sf))


@query(f"with {P.FUND} select symbol, as_of_date, available_date, (round(market_cap * 100)::bigint + round(book_value * 100)::bigint)::double * 1e7 as book_value from fund")
def html_book_equity(spark, sf):
    return html_tables.book_equity(html_tables.balance_sheets(_book_pages(spark, sf))).select("symbol", "as_of_date", "available_date", "book_value")


@query(f"with {P.FUND} select symbol, as_of_date, as_of_date as available_date, market_cap, book_value * 10 as book_value, book_value * 10 / market_cap as book_to_market from fund")
def vendor_sections(spark, sf):
    own = P.fundamentals(spark, sf)
    text = lambda c: F.col(c).cast("string")
    body = F.to_json(
        F.struct(
            F.struct(text("market_cap").alias("MarketCapitalization"), text("book_value").alias("BookValue"), text("as_of_date").alias("MostRecentQuarter")).alias("Highlights"),
            F.struct(F.lit("0").alias("PriceBookMRQ")).alias("Valuation"),
            F.struct(F.lit("10").alias("SharesOutstanding")).alias("SharesStats"),
        )
    )
    return vendor_json.section_snapshot(own.select("symbol", body.alias("body")))


@query(
    f"""with {P.FUND} select symbol, as_of_date, (as_of_date + interval 45 day)::date as available_date, book_value from fund
        qualify row_number() over (partition by symbol order by as_of_date desc) <= 8"""
)
def vendor_quarters(spark, sf):
    own = P.fundamentals(spark, sf)
    entry = F.struct(F.col("as_of_date").cast("string").alias("date"), F.date_add("as_of_date", 45).cast("string").alias("filing_date"), F.col("book_value").cast("string").alias("totalStockholderEquity"))
    landed = own.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("as_of_date").cast("string"), entry)))).alias("body"))
    return vendor_json.period_map_quarters(landed, periods=8).select("symbol", "as_of_date", "available_date", "book_value")


@query(
    f"""with {P.SDS} select trade_date, symbol, series, close, tottrdqty, tottrdval from sds where series in ('EQ', 'BE')
        qualify row_number() over (partition by trade_date, symbol order by case series when 'EQ' then 0 else 1 end) = 1"""
)
def price_files(spark, sf):
    """The panel written as price files of the newer dialect and parsed back."""
    rows = P.supplier_day_series(spark, sf)
    path = store.scratch(spark, "files")
    named = rows.select(F.col("trade_date").alias("TradDt"), F.col("symbol").alias("TckrSymb"), F.col("series").alias("SctySrs"), F.col("close").alias("ClsPric"), F.col("tottrdqty").alias("TtlTradgVol"), F.col("tottrdval").alias("TtlTrfVal"))
    named.write.option("header", True).csv(path)
    return prices.read_price_files(spark, path).select("trade_date", "symbol", "series", "close", "tottrdqty", "tottrdval")


@query(f"with {P.SDS} select series, count(*) as n from sds group by series")
def series_mix(spark, sf):
    return overview.series_mix(P.supplier_day_series(spark, sf))


@query(f"with {P.SD} select trade_date, count(distinct symbol) as n_symbols from sd group by trade_date")
def coverage(spark, sf):
    return overview.coverage(P.supplier_day(spark, sf))


@query(f"with {R} select 'ret' as name, count(ret) as n, round(avg(ret), 8) as mean, round(stddev_samp(ret), 8) as std, min(ret) as least, max(ret) as most from r")
def describe_returns(spark, sf):
    return overview.describe(_sm(spark, sf), ["ret"]).select("name", "n", *r8("mean", "std"), "least", "most")


# files of the lake --------------------------------------------------------------------------------

_ONE_DAY = f"{P.SDS}, day as (select * from sds where trade_date = (select max(trade_date) from sds))"
_DAY_ROWS = """select trade_date, symbol, series, close, tottrdqty, tottrdval from day where series in ('EQ', 'BE')
    qualify row_number() over (partition by symbol order by case series when 'EQ' then 0 else 1 end) = 1"""


def _one_day(spark, sf) -> tuple[list, object]:
    """The last day's rows, some thousand, and the day."""
    panel = P.supplier_day_series(spark, sf)
    day = panel.agg(F.max("trade_date")).first()[0]
    return panel.where(F.col("trade_date") == F.lit(day)).collect(), day


def _legacy_text(rows: list, day) -> str:
    head = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"
    return "\n".join([head, *[f"{r.symbol.lower()} ,{r.series},,,,{r.close!r},,,{r.tottrdqty!r},{r.tottrdval!r},{day:%d-%b-%Y},1,X," for r in rows]]) + "\n"


@query(f"with {_ONE_DAY} {_DAY_ROWS}")
def price_file_old_dialect(spark, sf):
    """A day's file in the older dialect, dated by its name."""
    rows, day = _one_day(spark, sf)
    path = store.scratch(spark, "legacy")
    store.put_bytes(spark, f"{path}/cm{day:%d%b%Y}bhav.csv", _legacy_text(rows, day).encode())
    return prices.read_price_csv(spark, path).select("trade_date", "symbol", "series", "close", "tottrdqty", "tottrdval")


@query(f"with {_ONE_DAY} {_DAY_ROWS}")
def price_zip_text_member(spark, sf):
    """A day's report zip: a text member with the table among others without one."""
    import io
    import zipfile

    rows, day = _one_day(spark, sf)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("readme.txt", "what is\nin here\n" * 100_000)
        out.writestr("a/PD.txt", _legacy_text(rows, day))
        out.writestr("index.csv", "NAME,VALUE\nx,1\n")
    path = store.scratch(spark, "report")
    store.put_bytes(spark, f"{path}/PR{day:%d%m%y}.zip", held.getvalue())
    return prices.read_price_files(spark, path).select("trade_date", "symbol", "series", "close", "tottrdqty", "tottrdval")


@query(f"with {P.SD}, {P.FUND} select 'returns' as name, year(trade_date)::varchar as part, count(*) as n from sd group by all union all select 'fundamentals', '', count(*) from fund")
def standard_views(spark, sf):
    """The lake's views, and the partitions that are listed, counted by SQL."""
    lake = store.scratch(spark, "lake")
    store.write_partitioned(P.supplier_day(spark, sf), f"{lake}/returns")
    store.write_flat(P.fundamentals(spark, sf), f"{lake}/fundamentals")
    if store.register_standard_views(spark, lake) != ["returns", "fundamentals"]:
        raise AssertionError("other views than tables")
    years = ", ".join(f"'{y}'" for y in store.partitions(spark, f"{lake}/returns"))
    return store.sql(
        spark,
        f"select 'returns' as name, cast(year as string) as part, count(*) as n from returns where cast(year as string) in ({years}) group by year union all select 'fundamentals', '', count(*) from fundamentals",
    )


@query(f"with {P.SD} select trade_date, symbol, close from sd where symbol in ('S1', 'S2', 'S3') or year(trade_date) = 1996")
def partition_pruning(spark, sf):
    """A table by symbol and one by year, read by some of their partitions."""
    path = store.scratch(spark, "pruned")
    panel = P.supplier_day(spark, sf)
    store.write_partitioned(panel, f"{path}/year")
    store.write_partitioned(panel.where("symbol in ('S1', 'S2', 'S3')"), f"{path}/symbol", by="symbol")
    some = store.read_partitioned(spark, f"{path}/symbol", symbols=["S1", "S2", "S3"], columns=["trade_date", "symbol", "close"])
    return some.union(store.read_partitioned(spark, f"{path}/year", years=[1996], columns=["trade_date", "symbol", "close"])).distinct()


@query(f"with {P.FUND} select symbol, as_of_date, case when month(as_of_date) = 3 then market_cap * 2 else market_cap end as market_cap, book_value from fund union all select symbol, (as_of_date + interval 1 day)::date, market_cap, null from fund where month(as_of_date) = 6")
def upsert_by_key(spark, sf):
    path = store.scratch(spark, "upsert")
    base = P.fundamentals(spark, sf).select("symbol", "as_of_date", "market_cap", "book_value")
    store.upsert(base, path, ["symbol", "as_of_date"])
    march = base.where(F.month("as_of_date") == 3).withColumn("market_cap", F.col("market_cap") * 2)
    june = base.where(F.month("as_of_date") == 6).select("symbol", F.date_add("as_of_date", 1).alias("as_of_date"), "market_cap", F.lit(None).cast("double").alias("book_value"))
    store.upsert(march.union(june), path, ["symbol", "as_of_date"])
    return spark.read.parquet(path)


@query(f"with {P.FUND} select symbol, as_of_date, available_date, market_cap, book_value, book_value / market_cap as book_to_market from fund")
def fundamentals_csv(spark, sf):
    path = store.scratch(spark, "fundamentals")
    own = P.fundamentals(spark, sf).select(F.date_format("as_of_date", "dd-MMM-yyyy").alias("As_Of_Date"), F.concat(F.lower("symbol"), F.lit(".NS ")).alias("SYMBOL"), "market_cap", "book_value")
    own.write.option("header", True).csv(path)
    return reference.read_fundamentals(spark, path)


@query(f"with {P.RF} select date, round(annualized_yield, 10) as annualized_yield, round(daily_rf, 12) as daily_rf, source from rf union all select date '1990-01-01', null, null, 'rbi_91d_tbill'")
def risk_free_csv(spark, sf):
    """Yields in percent, and one that is missing."""
    path = store.scratch(spark, "rates")
    own = P.risk_free(spark, sf).select(F.date_format("date", "dd/MM/yyyy").alias("Auction_Date"), (F.col("annualized_yield") * 100).cast("string").alias("YTM"))
    small = F.when(F.col("YTM").cast("double") > 1, F.col("YTM")).otherwise((F.col("YTM").cast("double") / 100).cast("string"))
    gone = spark.sql("select '01/01/1990' as Auction_Date, '-' as YTM")
    own.withColumn("YTM", small).union(gone).write.option("header", True).csv(path)
    return reference.read_risk_free(spark, path).select("date", F.round("annualized_yield", 10).alias("annualized_yield"), F.round("daily_rf", 12).alias("daily_rf"), "source")


@query(f"with {P.UNI} select as_of_date, symbol, 'Name of ' || symbol as company_name, null::varchar as industry, 'IN' || symbol as isin from uni")
def universe_csv(spark, sf):
    path = store.scratch(spark, "universe")
    own = P.universe(spark, sf).select("as_of_date", F.concat(F.lit("Name of "), "symbol").alias("Company Name"), F.col("symbol").alias("Symbol"), F.concat(F.lit("IN"), "symbol").alias("ISIN Code"))
    own.union(own).write.option("header", True).csv(path)
    return reference.read_universe(spark, path)


@query(f"with {P.FUND} select as_of_date, symbol, max(book_value) as shares from fund where month(as_of_date) <> 3 group by all")
def shares_history(spark, sf):
    path = store.scratch(spark, "shares")
    own = P.fundamentals(spark, sf).select("as_of_date", "symbol", F.when(F.month("as_of_date") != 3, F.col("book_value")).otherwise(0.0).alias("shares"))
    store.write_flat(own, path)
    return reference.read_shares(spark, path)


@query(f"with {P.SDS} select trade_date, symbol, max(close) as close from sds where year(trade_date) = 1996 group by all")
def load_closes(spark, sf):
    return prices.closes(P.supplier_day_series(spark, sf), years=[1996])


@query(
    f"""with {P.FUND} select symbol, as_of_date, (as_of_date + interval 40 day)::date as available_date, book_value from fund
        qualify row_number() over (partition by symbol order by as_of_date desc) <= 6"""
)
def vendor_statements(spark, sf):
    own = P.fundamentals(spark, sf)
    one = F.struct(F.col("as_of_date").cast("string").alias("date"), F.concat(F.date_add("as_of_date", 40).cast("string"), F.lit(" 17:00:00")).alias("acceptedDate"), F.col("book_value").cast("string").alias("totalStockholdersEquity"))
    landed = own.groupBy("symbol").agg(F.to_json(F.collect_list(one)).alias("body"))
    return vendor_json.statement_quarters(landed, periods=6).select("symbol", "as_of_date", "available_date", "book_value")


# options and whole plans --------------------------------------------------------------------------


@query(f"with {RD} select trade_date, symbol, case when tottrdval > 5000 then abs(ret) / (tottrdval - 5000) else -1 end as illiq from r where ret is not null")
def amihud_scalar(spark, sf):
    rows = _sd(spark, sf).where("ret is not null")
    return rows.select("trade_date", "symbol", signals.daily_illiq(F.col("ret"), F.col("tottrdval") - 5000, -1.0).alias("illiq"))


@query(f"with {R} select bool_or(ret is not null) as ret, false as none from r")
def usable_columns(spark, sf):
    there = signals.has_values(_sm(spark, sf).withColumn("none", F.lit(None).cast("double")), "ret", "none")
    return spark.createDataFrame([(there["ret"], there["none"])], "ret boolean, none boolean")


@query(f"with {P.FUND} select as_of_date, as_of_date as available_date, symbol, market_cap, null::double as book_value, null::double as book_to_market from fund")
def equity_as_fundamentals(spark, sf):
    return fundamentals.equity_as_fundamentals(P.fundamentals(spark, sf).select("as_of_date", "symbol", "market_cap"))


def _sleeve_mean(size: str, value: str) -> str:
    inside = f"filter (sz = '{size}' and val = '{value}')"
    return f"(sum(w * ret) {inside} / case when sum(w) {inside} <> 0 then sum(w) {inside} end)"


_SIX = f"{_PF}, {_SIZE}, {terciles('sized', 'valued', 'book_to_market', 'val')}, six as (select *, {VALUE_WEIGHT} as w from valued where ret is not null)"
_M = _sleeve_mean


@query(f"with {_SIX} select trade_date, round(({_M('S', 'L')} + {_M('S', 'N')} + {_M('S', 'H')} - {_M('B', 'L')} - {_M('B', 'N')} - {_M('B', 'H')}) / 3, 8) as SMB from six group by trade_date")
def factor_smb_2x3(spark, sf):
    return factors.smb(P.priced_with_fundamentals(spark, sf), method="ff2x3").select("trade_date", *r8("SMB"))


@query(f"with {_SIX} select trade_date, round(({_M('S', 'H')} + {_M('B', 'H')} - {_M('S', 'L')} - {_M('B', 'L')}) / 2, 8) as HML from six group by trade_date")
def factor_hml_2x3(spark, sf):
    return factors.hml(P.priced_with_fundamentals(spark, sf), method="ff2x3").select("trade_date", *r8("HML"))


@query(
    f"""with {_EQ}, formed as (select distinct trade_date from wts), full_ as (select f.trade_date, n.symbol, w.weight from formed f cross join (select distinct symbol from wts) n left join wts w on f.trade_date = w.trade_date and n.symbol = w.symbol),
        asof_ as (select g.trade_date, g.symbol, w.weight from (select * from (select distinct trade_date from mom) cross join (select distinct symbol from wts)) g asof left join full_ w on g.symbol = w.symbol and g.trade_date >= w.trade_date)
        select trade_date, symbol, round(weight, 8) as weight from (select trade_date, symbol, lag(weight) over (partition by symbol order by trade_date) as weight from asof_) where weight is not null"""
)
def propagate_weights_rebalanced(spark, sf):
    held = portfolio.propagate(_weights(spark, sf), calendars.trading_calendar(P.supplier_month(spark, sf)), hold="rebalance")
    return held.select("trade_date", "symbol", *r8("weight"))


@query(f"with {_EQ} select trade_date, round(sum(weight), 8) + 0.0 as w_sum, count(*) filter (weight = 0) as n_zero from wts group by trade_date having abs(sum(weight)) >= 1e-10 or count(*) filter (weight = 0) > 0")
def neutrality(spark, sf):
    """Dates whose weights don't sum to 0: none."""
    return portfolio.neutrality_violations(_weights(spark, sf)).select("trade_date", *r8("w_sum"), "n_zero")


_CLEAN_GRID = f"""{P.SDS}, one as (select * from sds where series in ('EQ', 'BE') qualify row_number() over (partition by trade_date, symbol order by case series when 'EQ' then 0 else 1 end) = 1),
    grid as (select * from (select distinct trade_date from sds) cross join (select distinct symbol from one)),
    full_ as (select g.trade_date, g.symbol, o.close, o.series, max(case when o.close is not null then g.trade_date end) over (partition by g.symbol) as last_date from grid g left join one o on g.trade_date = o.trade_date and g.symbol = o.symbol),
    liq as (select *, coalesce(trade_date > last_date, false) as is_liquidated from full_)"""


@query(f"with {_CLEAN_GRID} select trade_date, symbol, series, close, is_liquidated, close is null as is_suspended, close is null as is_missing_ohlc from liq")
def clean_prices_calendar(spark, sf):
    raw = P.supplier_day_series(spark, sf)
    out = clean.clean_prices(raw, apply_calendar=True, calendar=calendars.trading_calendar(raw))
    return out.select("trade_date", "symbol", "series", "close", "is_liquidated", "is_suspended", "is_missing_ohlc")


@query(f"with {_CLEAN_GRID} select trade_date, symbol, case when not is_liquidated then close / lag(close) over (partition by symbol order by trade_date) - 1 end as ret, is_liquidated from liq")
def returns_pipeline_lake(spark, sf):
    """Raw prices through the whole pipeline into a lake, and its returns read back."""
    config = returns_pipeline.PipelineConfig(out=store.scratch(spark, "pipeline"))
    return returns_pipeline.run_returns_pipeline(spark, config, P.supplier_day_series(spark, sf)).returns.select("trade_date", "symbol", "ret", "is_liquidated")


_Z = lambda x: f"round(case when stddev_samp({x}) over (partition by trade_date) > 0 then ({x} - avg({x}) over (partition by trade_date)) / stddev_samp({x}) over (partition by trade_date) end, 6)"


_RAW_MOM = MOM.replace("round(exp", "(exp").replace(" - 1, 10) end", " - 1) end")


@query(f"with {_RAW_MOM}, {illiq_sql(6, 'mom')} select trade_date, symbol, round(illiq_signal * 1e6, 8) as illiq_signal, round(mom_12_1, 10) as mom_12_1, {_Z('illiq_signal')} as illiq_signal_z, {_Z('mom_12_1')} as mom_12_1_z from sig")
def characteristic_panel(spark, sf):
    panel = factors.characteristic_panel(_sm(spark, sf), window=6, lookback=12, skip=1, winsor=False, size=False, value=False)
    return panel.select("trade_date", "symbol", F.round(F.col("illiq_signal") * 1e6, 8).alias("illiq_signal"), F.round("mom_12_1", 10).alias("mom_12_1"), F.round("illiq_signal_z", 6).alias("illiq_signal_z"), F.round("mom_12_1_z", 6).alias("mom_12_1_z"))


@query(
    f"""with {_PF}, lg as (select trade_date, symbol, ln(market_cap) as x from pf), cutl as (select l.*, case when x is not null then least(greatest(x, lo), hi) end as w
        from lg l join (select trade_date as td, {nearest('x', 0.01, '')} as lo, {nearest('x', 0.99, '')} as hi from lg group by trade_date) on trade_date = td)
        select trade_date, symbol, {_Z('w')} as log_me_z from cutl"""
)
def signal_panel_size(spark, sf):
    return factors.signal_panel(P.priced_with_fundamentals(spark, sf), "size").select("trade_date", "symbol", F.round("log_me_z", 6).alias("log_me_z"))


@query(f"with {_FACTORS}, {_MKT} select trade_date, round(WML, 8) as WML, round(ILLIQ, 8) as ILLIQ, round(MKT, 8) as MKT from fac left join mkt using (trade_date)")
def tearsheet_factors(spark, sf):
    """The tearsheet's factors with the market's, by date."""
    return tearsheet.with_market(_factor_panel(spark, sf), _sm(spark, sf)).select("trade_date", *r8("WML", "ILLIQ", "MKT"))


_TWO = f"{MOM}, two as (select trade_date, ret as y, mom_12_1 as x1, ln(tottrdval) as x2 from mom where ret is not null and mom_12_1 is not null and tottrdval > 0)"
_TWO_OUT = """sums as (select trade_date, count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, covar_pop(x1, x1) as s11, covar_pop(x2, x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y
        from two group by trade_date having count(*) >= 20),
    sol as (select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from sums)"""


def _two_signals(spark, sf) -> DataFrame:
    return _mom(_sm(spark, sf)).withColumn("log_value", F.when(F.col("tottrdval") > 0, F.log("tottrdval")))


@query(f"with {_TWO}, {_TWO_OUT} select trade_date, round(my - b1 * m1 - b2 * m2, 6) as intercept, round(b1, 6) as mom_12_1, round(b2, 6) as log_value from sol")
def fm_gamma_two(spark, sf):
    out = regress.fama_macbeth(_two_signals(spark, sf), ["mom_12_1", "log_value"], "ret", pvalues=False)
    return out.path.select("trade_date", *[F.round(c, 6).alias(c) for c in ("intercept", "mom_12_1", "log_value")])


@query(
    f"""with {_FACTORS}, {_MKT}, two as (select r.symbol, r.ret as y, mkt.MKT as x1, fac.WML as x2 from r join mkt using (trade_date) join fac using (trade_date) where r.ret is not null and fac.WML is not null),
        {_TWO_OUT.replace('trade_date', 'symbol').replace('>= 20', '>= 60')} select symbol, n as n_obs, round(my - b1 * m1 - b2 * m2, 6) as alpha, round(b1, 6) as beta_MKT, round(b2, 6) as beta_WML from sol"""
)
def ts_betas_two(spark, sf):
    both = tearsheet.with_market(_factor_panel(spark, sf), _sm(spark, sf))
    out = regress.time_series_betas(_sm(spark, sf), both, ["MKT", "WML"], "ret")
    return out.select("symbol", "n_obs", *[F.round(c, 6).alias(c) for c in ("alpha", "beta_MKT", "beta_WML")])


@query(f"with {R} select round(stddev_samp(ret) / sqrt(count(ret)), 10) as se from r where year(trade_date) = 1996")
def contrast_error(spark, sf):
    return _sm(spark, sf).where(F.year("trade_date") == 1996).agg(regress.contrast_se(F.col("ret")).alias("se")).select(F.round("se", 10).alias("se"))
