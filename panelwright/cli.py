"""Command line: returns, factors, evaluate, tearsheet, market-equity."""

from __future__ import annotations

import argparse
import sys

from . import store
from .operators.factors import build_factors
from .operators.fundamentals import equity_as_fundamentals, market_equity_asof, overlay_equity
from .operators.calendars import month_end_asof
from .operators.portfolio import BacktestConfig, run_backtest
from .operators.regress import fama_macbeth
from .operators.signals import has_values
from .plans.returns_pipeline import PipelineConfig, late_fundamentals, run_returns_pipeline
from .plans.tearsheet import build_tearsheet
from .report import backtest_report, premia_report
from .session import build_session
from .sources.prices import closes
from .sources.reference import read_shares


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="panelwright")
    parser.add_argument("--master")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("returns")
    p.add_argument("--raw")
    p.add_argument("--prices")
    p.add_argument("--adjustments")
    p.add_argument("--risk-free")
    p.add_argument("--fundamentals")
    p.add_argument("--lag-months", type=int, default=3)
    p.add_argument("--lake", required=True)
    p = sub.add_parser("factors")
    p.add_argument("--lake", required=True)
    p.add_argument("--amihud-window", type=int, default=30)
    p.add_argument("--lookback", type=int, default=252)
    p.add_argument("--skip", type=int, default=21)
    p.add_argument("--no-winsorize", action="store_true")
    p.add_argument("--no-persist", action="store_true")
    p = sub.add_parser("evaluate")
    p.add_argument("--lake", required=True)
    p.add_argument("--reports", required=True)
    p.add_argument("--chars", nargs="*", default=["mom_12_1_z", "illiq_signal_z"])
    p.add_argument("--nw-lags", type=int)
    p.add_argument("--min-obs", type=int, default=20)
    p.add_argument("--tc-bps", type=float, default=0.0)
    p.add_argument("--skip-backtest", action="store_true")
    p.add_argument("--skip-fm", action="store_true")
    p = sub.add_parser("tearsheet")
    p.add_argument("--lake", required=True)
    p.add_argument("--reports", required=True)
    p.add_argument("--skip-two-pass", action="store_true")
    p.add_argument("--min-ts-obs", type=int, default=60)
    p.add_argument("--min-obs", type=int, default=20)
    p = sub.add_parser("market-equity")
    p.add_argument("--lake", required=True)
    p.add_argument("--shares", required=True)
    p.add_argument("--no-merge", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session("panelwright-cli", args.master)
    table = lambda name: store.read_partitioned(spark, f"{args.lake}/{name}")
    if args.command == "returns":
        config = PipelineConfig(args.prices, args.raw, args.adjustments, args.risk_free, fundamentals=args.fundamentals, lag_months=args.lag_months, out=args.lake, register=True)
        result = run_returns_pipeline(spark, config)
        if result.fundamentals is not None and late_fundamentals(result.returns, result.fundamentals):
            print("warning: all fundamentals became available after the last trade date", file=sys.stderr)
    elif args.command == "factors":
        built = build_factors(table("returns").where("ret is not null"), args.amihud_window, args.lookback, args.skip, not args.no_winsorize)
        if args.no_persist:
            return 0 if built.factor_returns.limit(1).count() else 1
        store.write_partitioned(built.characteristics, f"{args.lake}/characteristics")
        store.write_partitioned(built.factor_returns, f"{args.lake}/factor_returns")
        return 0 if store.partitions(spark, f"{args.lake}/factor_returns") else 1
    elif args.command == "evaluate":
        panel = table("characteristics")
        if not args.skip_fm:
            usable = [c for c, there in has_values(panel, *args.chars).items() if there]
            ret = "excess_ret" if has_values(panel, "excess_ret")["excess_ret"] else "ret"
            premia_report(args.reports, fama_macbeth(panel, usable, ret, lags=args.nw_lags, least=args.min_obs))
        if not args.skip_backtest:
            for name, signal in (("momentum", "mom_12_1"), ("illiq", "illiq_signal")):
                backtest_report(args.reports, run_backtest(panel, BacktestConfig(signal, tc_bps=args.tc_bps, validate_weights=False)), name)
    elif args.command == "tearsheet":
        panel = table("returns")
        ret = "excess_ret" if has_values(panel, "excess_ret")["excess_ret"] else "ret"
        build_tearsheet(panel, table("factor_returns"), args.reports, two_pass=not args.skip_two_pass, least_series=args.min_ts_obs, least=args.min_obs, ret=ret)
    else:
        prices = closes(table("bhavcopy"))
        equity = market_equity_asof(month_end_asof(prices), prices, read_shares(spark, args.shares))
        store.upsert(equity, f"{args.lake}/market_equity", ["symbol", "as_of_date"])
        if not args.no_merge:
            base = table("fundamentals")
            new = equity_as_fundamentals(equity)
            store.upsert(new if base is None else overlay_equity(base, equity), f"{args.lake}/fundamentals", ["symbol", "as_of_date"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
