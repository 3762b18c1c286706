import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions.symbols import SymbolMap, quote_symbol
from panelwright.operators import calendars, clean, returns
from panelwright.operators.asof import asof_join

D = [dt.date(2020, 1, d) for d in (2, 3, 6, 7)]


def panel(spark):
    rows = [
        (D[0], "aaa.NS", "EQ", 10.0, 100.0, 1000.0),
        (D[0], "AAA", "BE", 11.0, 5.0, 50.0),
        (D[1], "AAA", "EQ", 12.0, 100.0, 1000.0),
        (D[0], "BBB", "EQ", 20.0, 100.0, 1000.0),
        (D[1], "BBB", "EQ", 21.0, 0.0, 1000.0),
        (D[2], "BBB", "EQ", 22.0, 100.0, 1000.0),
        (D[0], "JUNK", "BZ", 1.0, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, "trade_date date, symbol string, series string, close double, tottrdqty double, tottrdval double")


def test_clean_prefers_eq_and_drops_other_series(spark):
    out = {(r.trade_date, r.symbol): r for r in clean.clean_prices(panel(spark)).collect()}
    assert set(out) == {(D[0], "AAA"), (D[1], "AAA"), (D[0], "BBB"), (D[1], "BBB"), (D[2], "BBB")}
    assert out[D[0], "AAA"].close == 10.0 and out[D[1], "BBB"].is_suspended and not out[D[0], "BBB"].is_suspended


def test_grid_marks_liquidation_and_suspension(spark):
    calendar = spark.createDataFrame([(d,) for d in D], "trade_date date")
    out = {(r.symbol, r.trade_date): r for r in clean.clean_prices(panel(spark), apply_calendar=True, calendar=calendar).collect()}
    assert len(out) == 8
    assert [out["AAA", d].is_liquidated for d in D] == [False, False, True, True]
    assert out["AAA", D[2]].is_suspended and out["AAA", D[2]].is_missing_ohlc and not out["AAA", D[1]].is_suspended


def test_returns_null_on_gaps_and_liquidation(spark):
    calendar = spark.createDataFrame([(d,) for d in D], "trade_date date")
    rows = panel(spark).where("not (symbol = 'BBB' and trade_date = date '2020-01-03')")
    got = returns.returns_panel(clean.clean_prices(rows, apply_calendar=True, calendar=calendar))
    out = {(r.symbol, r.trade_date): r.ret for r in got.collect()}
    assert out["AAA", D[1]] == pytest.approx(0.2) and out["AAA", D[2]] is None
    assert out["BBB", D[1]] is None and out["BBB", D[2]] is None


def test_split_gives_no_return(spark):
    df = spark.createDataFrame([(D[0], "A", 100.0, 1.0), (D[1], "A", 50.0, 2.0)], "trade_date date, symbol string, close double, adj_factor double")
    assert [r.ret for r in returns.price_returns(returns.apply_factor(df)).orderBy("trade_date").collect()] == [None, pytest.approx(0.0)]
    with pytest.raises(KeyError):
        returns.apply_factor(df.drop("adj_factor"))


def test_adjustment_factor_needs_finite_nonzero(spark):
    df = spark.createDataFrame([(2.0, 4.0), (0.0, 1.0), (None, 1.0), (1.0, float("inf"))], "c double, a double")
    got = [r[0] for r in df.select(returns.adjustment_factor(F.col("c"), F.col("a"))).collect()]
    assert got[0] == 2.0 and all(math.isnan(x) for x in got[1:])


def test_adjustments_keep_all_rows(spark):
    adj = spark.createDataFrame([(D[0], "BBB", 0.5, None)], "trade_date date, symbol string, adj_factor double, yf_adj_close double")
    out = returns.attach_adjustments(panel(spark), adj)
    assert out.count() == 7 and out.where("symbol = 'BBB' and trade_date = date '2020-01-02'").first().adj_close == 10.0


def test_rates_percent_and_null_row_carried(spark):
    rf = returns.risk_free_frame(spark.createDataFrame([(D[0], 7.3), (D[1], None)], "date date, annualized_yield double"), "mibor")
    days = spark.createDataFrame([(d,) for d in D], "trade_date date")
    out = {r.date: r for r in returns.forward_fill(rf, days).collect()}
    assert out[D[0]].daily_rf == pytest.approx(0.073 / 365) and out[D[3]].daily_rf is None and out[D[3]].source == "mibor"
    assert returns.daily_rate_of(7.3) == pytest.approx(returns.daily_rate_of(0.073))


def test_foreign_rates_are_refused(spark):
    rf = spark.createDataFrame([(D[0], 0.0001, "SOFR")], "date date, daily_rf double, source string")
    rows = spark.createDataFrame([(D[0], "A", 0.1)], "trade_date date, symbol string, ret double")
    with pytest.raises(ValueError):
        returns.excess_returns(rows, rf)


def test_asof_strategies_agree_and_never_look_ahead(spark):
    left = spark.createDataFrame([(s, dt.date(2020, 1, d)) for s in "AB" for d in range(1, 29, 3)] + [("C", None), (None, D[0])], "k string, t date")
    right = spark.createDataFrame([("A", dt.date(2020, 1, d), None if d == 9 else float(d)) for d in (2, 5, 9, 20)] + [("B", dt.date(2020, 1, 4), 1.0), ("B", dt.date(2020, 1, 4), 2.0)], "k string, u date, v double")
    a, b = (sorted(map(str, asof_join(left, right, "t", "u", ["k"], strategy=s).collect())) for s in ("union", "interval"))
    assert a == b and len(a) == left.count()
    for r in asof_join(left, right, "t", "u", ["k"]).collect():
        known = [x for x in right.collect() if x.k == r.k and r.t and x.u <= r.t]
        best = max(known, key=lambda x: (x.u, x.v or 0)) if known else None
        assert (r.u, r.v) == ((best.u, best.v) if best else (None, None))


def test_calendars(spark):
    days = calendars.weekday_calendar(spark, dt.date(2020, 1, 3), dt.date(2020, 1, 7)).orderBy("trade_date").collect()
    assert [r[0] for r in days] == [dt.date(2020, 1, 3), D[2], D[3]]
    assert calendars.month_ends(panel(spark)).collect()[0][0] == D[2]
    with pytest.raises(ValueError):
        calendars.rebalance_dates(panel(spark), "weekly")


def test_symbols(spark):
    assert SymbolMap().normal(" hdfc.bo ") == "HDFCBANK" and quote_symbol("abc.NS") == "ABC.NS"
    assert SymbolMap().extend({"old.ns": "new"}).normal("OLD") == "NEW"


def test_cleaning_twice_changes_nothing(spark):
    once = clean.clean_prices(panel(spark), apply_calendar=True)
    twice = clean.liquidation_grid(once)
    assert sorted(map(str, once.select(sorted(once.columns)).collect())) == sorted(map(str, twice.select(sorted(once.columns)).collect()))
