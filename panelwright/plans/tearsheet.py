"""The last phase: market factor, correlations, two-pass premia, one Markdown report."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.factors import equal_weight_market
from ..operators.metrics import correlation_matrix
from ..operators.regress import Premia, factor_metrics, fama_macbeth_two_pass
from ..report import markdown_table, master, write_report


@dataclass(frozen=True)
class Tearsheet:
    factors: DataFrame
    metrics: DataFrame
    correlations: DataFrame
    premia: Premia | None
    place: Path


def with_market(factor_returns: DataFrame, returns: DataFrame) -> DataFrame:
    """The factors with the equal-weight market of their dates."""
    return factor_returns.join(equal_weight_market(returns), "trade_date", "left")


def build_tearsheet(returns: DataFrame, factor_returns: DataFrame, folder: str, *, two_pass: bool = True, least_series: int = 60, least: int = 20, ret: str = "excess_ret", more: dict[str, Path] | None = None) -> Tearsheet:
    """MKT joined to the factors by date, their metrics and correlations, and premia of betas on all of them."""
    both = with_market(factor_returns, returns)
    columns = [c for c in both.columns if c != "trade_date"]
    metrics, corr = factor_metrics(both, columns), correlation_matrix(both, columns)
    premia = fama_macbeth_two_pass(returns, both, columns, ret, least_series=least_series, least=least) if two_pass else None
    write_report(folder, "Factors", {"factor_metrics": metrics, "factor_corr": corr} | ({"two_pass_lambdas": premia.lambdas} if premia else {}), "factors")
    sections: dict[str, str | Path] = {"Factor metrics": markdown_table(metrics), "Correlations": markdown_table(corr)}
    if premia:
        sections["Two-pass premia"] = markdown_table(premia.lambdas)
    return Tearsheet(both, metrics, corr, premia, master(folder, "Tearsheet", sections | dict(more or {})))
