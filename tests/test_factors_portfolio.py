import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators import cross_section, factors, metrics, portfolio, regress, signals

DAY = dt.date(2021, 1, 1)


def frame(spark, days=40, names=20, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(DAY + dt.timedelta(d), f"S{i:02d}", float(rng.normal(0.001 * i, 0.01)), 1e7 * (names - i), 1e9 * (i + 1), 0.2 + 0.05 * i, float(i + 0.01 * d)) for d in range(days) for i in range(names)]
    return spark.createDataFrame(rows, "trade_date date, symbol string, ret double, tottrdval double, market_cap double, book_to_market double, sig double")


def test_winsor_bounds_are_nearest_ranks(spark):
    df = spark.createDataFrame([(DAY, float(i)) for i in range(100)], "trade_date date, x double")
    row = cross_section.winsorize(df, "x").agg(F.min("x_w"), F.max("x_w")).first()
    assert tuple(row) == (1.0, 98.0)
    with pytest.raises(ValueError):
        cross_section.winsorize(df, "x", "other")


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(DAY, float(i) if i % 3 else None) for i in range(30)], "trade_date date, x double")
    out = cross_section.prepare_signal(df, "x").where("x is null")
    assert out.where("x_w is not null or x_z is not null").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5) | st.none(), min_size=1, max_size=40))
def test_buckets_follow_average_ranks(spark, values):
    df = spark.createDataFrame([(DAY, i, None if v is None else float(v)) for i, v in enumerate(values)], "trade_date date, i int, x double")
    got = {r.i: r.quantile for r in cross_section.quantile_buckets(df, "x", 5).collect()}
    known = [v for v in values if v is not None]
    for i, v in enumerate(values):
        if v is None or len(known) < 5:
            assert got[i] is None
        else:
            rank = sum(k < v for k in known) + (known.count(v) + 1) / 2
            assert got[i] == min(max(math.floor((rank - 1) / len(known) * 5), 0), 4) + 1


def test_factor_signs(spark):
    df = frame(spark)
    assert factors.smb(df).agg(F.avg("SMB")).first()[0] < 0
    assert factors.hml(df, size=None).agg(F.avg("HML")).first()[0] > 0
    assert set(factors.smb(df, method="ff2x3").columns) == {"trade_date", "SMB"}


def test_one_sleeve_still_gives_a_row(spark):
    df = spark.createDataFrame([(DAY, "A", 0.1, 1.0), (DAY, "B", None, 1.0)], "trade_date date, symbol string, ret double, market_cap double")
    out = factors.long_short(df, F.col("symbol") == "A", F.col("symbol") == "B", "f").collect()
    assert [(r.f) for r in out] == [pytest.approx(0.05)]


def test_build_factors_has_all_columns(spark):
    built = factors.build_factors(frame(spark), window=5, lookback=10, skip=2)
    assert {"illiq_signal_z", "mom_12_1_z", "log_me", "btm"} <= set(built.characteristics.columns)
    assert set(built.factor_returns.columns) == {"trade_date", "SMB", "HML", "WML", "ILLIQ"}
    assert set(factors.build_factors(frame(spark).drop("market_cap", "book_to_market"), 5, 10, 2).factor_returns.columns) == {"trade_date", "WML", "ILLIQ"}


def test_signal_ignores_its_own_day(spark):
    df = frame(spark, 12, 3)
    changed = df.withColumn("ret", F.when(F.col("trade_date") == DAY + dt.timedelta(8), 9.0).otherwise(F.col("ret")))
    read = lambda d: {(r.symbol, r.trade_date): r.illiq_signal for r in signals.attach_illiq_signal(d, 4).where(F.col("trade_date") <= DAY + dt.timedelta(8)).collect()}
    assert read(df) == read(changed)


def test_illiq_without_volume_is_null(spark):
    df = spark.createDataFrame([(DAY, "A", 0.1, 0.0), (DAY, "B", 0.1, float("nan")), (DAY, "C", 0.1, 10.0)], "trade_date date, symbol string, ret double, tottrdval double")
    assert [r.illiq for r in signals.attach_illiq(df).orderBy("symbol").collect()] == [None, None, pytest.approx(0.01)]


def test_momentum_needs_history_and_survives_total_loss(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(i), "A", -1.0 if i == 3 else 0.1) for i in range(12)], "trade_date date, symbol string, ret double")
    out = [r.mom_12_1 for r in signals.attach_momentum(df, 6, 1, least=5).orderBy("trade_date").collect()]
    assert out[:5] == [None] * 5 and out[5] == -1.0 and out[11] == pytest.approx(1.1**5 - 1)
    with pytest.raises(ValueError):
        signals.attach_momentum(df, 1, 1)


def test_weights_are_neutral_and_turnovers_equal(spark):
    weights = portfolio.form_portfolio(frame(spark), "sig", validate=True)
    by_date = portfolio.weights_by_date(weights).first()
    assert by_date.gross == pytest.approx(1.0)
    for r in portfolio.turnover(weights).collect():
        assert r.turnover_one_way == pytest.approx(r.turnover_two_way)
    with pytest.raises(AssertionError):
        portfolio.assert_dollar_neutral(weights.where("is_long"))


def test_turnover_of_a_swap(spark):
    rows = [(DAY, "A", 0.5), (DAY, "B", -0.5), (DAY + dt.timedelta(1), "A", 0.5), (DAY + dt.timedelta(1), "C", -0.5)]
    out = portfolio.turnover(spark.createDataFrame(rows, "trade_date date, symbol string, weight double")).orderBy("trade_date").collect()
    assert [r.turnover_two_way for r in out] == [0.0, 0.5]
    assert portfolio.average_turnover(spark.createDataFrame([], "trade_date date, turnover_one_way double, turnover_two_way double")).first()[0] == 0.0


def test_weights_start_the_next_day(spark):
    weights = spark.createDataFrame([(DAY, "A", 0.5), (DAY, "B", -0.5), (DAY + dt.timedelta(2), "A", 0.2)], "trade_date date, symbol string, weight double")
    days = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in range(4)], "trade_date date")
    held = {(r.symbol, (r.trade_date - DAY).days): r.weight for r in portfolio.propagate(weights, days).collect()}
    assert held == {("A", 1): 0.5, ("A", 2): 0.5, ("A", 3): 0.2, ("B", 1): -0.5, ("B", 2): -0.5, ("B", 3): -0.5}
    let_go = {(r.symbol, (r.trade_date - DAY).days) for r in portfolio.propagate(weights, days, "rebalance").collect()}
    assert ("B", 3) not in let_go


def test_backtest_costs(spark):
    plain, costly = (portfolio.run_backtest(frame(spark), portfolio.BacktestConfig("sig", frequency="daily", tc_bps=bps)) for bps in (0.0, 50.0))
    a, b = plain.metrics.first(), costly.metrics.first()
    assert a.n_days == b.n_days > 0 and b.total_net_return <= a.total_net_return and a.n_rebals == 40


def test_metrics_closed_form(spark):
    values = [0.01, -0.02, 0.03, float("nan"), 0.0]
    df = spark.createDataFrame([(DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "trade_date date, r double")
    out, x = metrics.summary(df, "r").first(), np.array([0.01, -0.02, 0.03, 0.0])
    assert out.n_obs == 4 and out.sharpe == pytest.approx(np.sqrt(252) * x.mean() / x.std(ddof=1)) and out.hit_rate == 0.5
    wealth = spark.createDataFrame([(DAY + dt.timedelta(i), w) for i, w in enumerate([1.0, 1.2, 0.9, 1.1, 0.8])], "trade_date date, wealth double")
    assert metrics.drawdown_path(wealth).agg(F.min("drawdown")).first()[0] == pytest.approx(0.8 / 1.2 - 1)


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = [0.0]
    for e in rng.normal(size=199):
        x.append(0.5 * x[-1] + e)
    df = spark.createDataFrame([(DAY + dt.timedelta(i), "a", float(v)) for i, v in enumerate(x)], "trade_date date, g string, v double")
    out = regress.newey_west(df, "v", ["g"]).first()
    e, n = np.array(x) - np.mean(x), 200
    lags = int(4 * (n / 100) ** (2 / 9))
    var = ((e @ e) + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n**2
    assert out.nw_se == pytest.approx(np.sqrt(var)) and out.p_value == pytest.approx(math.erfc(abs(out.t_stat) / math.sqrt(2)))
    plain = regress.newey_west(df, "v", ["g"], lags=0).first()
    assert plain.nw_se == pytest.approx(np.std(x, ddof=1) / np.sqrt(n)) and plain.nw_se != pytest.approx(out.nw_se)


def test_student_p_values():
    assert regress.p_value(2.0, 11, 0) == pytest.approx(0.0733880, abs=1e-6)  # t(10)
    assert regress.p_value(0.0, 5, 0) == pytest.approx(1.0) and regress.p_value(1.96, 50, 3) == pytest.approx(0.05, abs=1e-3)


def test_premia_are_recovered(spark):
    rng = np.random.default_rng(123)
    rows = []
    for d in range(60):
        for i in range(40):
            a, b = rng.normal(), rng.normal()
            rows.append((DAY + dt.timedelta(d), f"S{i}", float(0.002 * a - 0.001 * b + 0.0002 + rng.normal(0, 0.001)), float(a), float(b)))
    df = spark.createDataFrame(rows, "trade_date date, symbol string, excess_ret double, a double, b double")
    out = {r.name: r.mean for r in regress.fama_macbeth(df, ["a", "b"]).lambdas.collect()}
    assert out["a"] == pytest.approx(0.002, abs=2e-4) and out["b"] == pytest.approx(-0.001, abs=2e-4)
    one = df.where(F.col("trade_date") == DAY).toPandas()
    beta = np.linalg.lstsq(np.column_stack([np.ones(40), one.a, one.b]), one.excess_ret, rcond=None)[0]
    got = regress.grouped_ols(df, "excess_ret", ["a", "b"], "trade_date", 20).where(F.col("trade_date") == F.lit(DAY)).first()
    assert [got.intercept, got.a, got.b] == pytest.approx(list(beta))
    with pytest.raises(KeyError):
        regress.fama_macbeth(df, ["nope"])


def test_collinear_regressors_share_the_slope(spark):
    rows = [("g", float(i), float(2 * i), float(2 * i)) for i in range(30)]
    got = regress.grouped_ols(spark.createDataFrame(rows, "g string, y double, a double, b double"), "y", ["a", "b"], "g", 5).first()
    assert got.a == pytest.approx(0.25) and got.b == pytest.approx(0.25)


def test_betas(spark):
    rng = np.random.default_rng(1)
    market = rng.normal(0, 0.01, 120)
    rows = [(DAY + dt.timedelta(d), f"S{i}", float((0.5 + 0.1 * i) * market[d] + rng.normal(0, 1e-4))) for d in range(120) for i in range(5)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, excess_ret double")
    factor = spark.createDataFrame([(DAY + dt.timedelta(d), float(m)) for d, m in enumerate(market)], "trade_date date, MKT double")
    betas = {r.symbol: r.beta_MKT for r in regress.time_series_betas(df, factor, ["MKT"]).collect()}
    assert all(betas[f"S{i}"] == pytest.approx(0.5 + 0.1 * i, rel=0.02) for i in range(5))


def test_correlations_degenerate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "a double, b double")
    out = {r.factor: (r.a, r.b) for r in metrics.correlation_matrix(df, ["a", "b"]).collect()}
    assert out["a"][0] == 1.0 and out["a"][1] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert metrics.correlation_matrix(df, ["a"]).columns == ["factor"]
