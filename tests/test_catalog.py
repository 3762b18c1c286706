import re

import duckdb
import pytest

import __spark_entry__ as entry
from panelwright.catalog_queries import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def value(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return repr(x)
    return str(x)[:10] if hasattr(x, "year") else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_time_windows_share_one_exchange(spark, sf):
    from panelwright.operators import signals
    from panelwright.plans import panels

    df = panels.with_returns(panels.supplier_month(spark, sf))
    plan = signals.attach_momentum(signals.attach_illiq_signal(df, 6), 12, 1)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    from panelwright.plans import panels

    plan = panels.supplier_day(spark, sf).where("symbol is not null")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_comment" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_is_dealt_by_symbol_only(spark, sf):
    from panelwright.operators import clean, returns
    from panelwright.plans import panels

    grid = clean.liquidation_grid(clean.flag_quality(panels.supplier_day(spark, sf)))
    plan = plan_of(returns.price_returns(returns.ensure_adj_close(grid)))
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert all("symbol" in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))


def test_held_weights_need_no_grid(spark, sf):
    from panelwright.operators import calendars, portfolio
    from panelwright.plans import panels

    panel = panels.with_returns(panels.supplier_month(spark, sf))
    for hold in ("asof", "rebalance"):
        plan = plan_of(portfolio.propagate(portfolio.form_portfolio(panel, "ret"), calendars.trading_calendar(panel), hold))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_regressions_shuffle_sums_only(spark, sf):
    from panelwright.operators import regress
    from panelwright.plans import panels

    panel = spark.createDataFrame(panels.with_returns(panels.supplier_month(spark, sf)).limit(500).collect())
    plan = plan_of(regress.grouped_ols(panel, "ret", ["close", "tottrdval"], "trade_date", 5))
    assert "Window" not in plan and "partial_covar_pop" in plan and len(re.findall("Exchange", plan)) == 1


def test_the_engine_works_without_the_corpus_modules(monkeypatch):
    import sys

    for name in ("panelwright.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
