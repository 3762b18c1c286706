"""Regressions per group, autocorrelation-robust means, and Fama-MacBeth premia.

The data pass is JVM aggregation: centred Gram matrices per group, summed per task before their
exchange. Python sees one row per group, to solve a small system, and one row per coefficient
for a p-value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite
from .metrics import summary


def auto_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def p_value(t: float | None, n: float | None, lags: float | None) -> float | None:
    """Two-sided: normal with lags, Student's t with n - 1 degrees of freedom without."""
    if t is None or n is None or math.isnan(t):
        return None if t is None else math.nan
    if lags:
        return math.erfc(abs(t) / math.sqrt(2))
    return _incomplete_beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def newey_west(df: DataFrame, value: str, by: list[str] | None = None, date: str = "trade_date", lags: int | None = None, pvalues: bool = True) -> DataFrame:
    """mean, nw_se, t_stat, n_periods (and p_value) of a series' finite values, per group.

    Bartlett weights, no small-sample correction; automatic lags floor(4 (n / 100)^(2/9)), at most
    n - 1. Without lags the usual standard error. Null below 2 values. A group's series, one value a
    date and so some thousand values, is gathered into one array, and each lag is a pass over it.
    """
    keys = by or []
    rows = df.where(finite(F.col(value))).select(*keys, F.col(date).alias("_t"), F.col(value).cast("double").alias("_v"))
    listed = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda s: s["_v"]).alias("_x"))  # one value a period
    n = F.size("_x")
    auto = F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))) if lags is None else F.lit(lags)
    out = listed.withColumns({"_n": n, "_L": F.greatest(F.least(auto, n - 1), F.lit(0)).cast("int")}).where("_n >= 2")
    out = out.withColumn("mean", F.expr("aggregate(_x, 0D, (a, v) -> a + v) / _n"))
    out = out.withColumn("_e", F.expr("transform(_x, v -> v - mean)"))
    out = out.withColumn("_s0", F.expr("aggregate(_e, 0D, (a, v) -> a + v * v)"))
    cross = "aggregate(zip_with(slice(_e, l + 1, _n - l), slice(_e, 1, _n - l), (p, q) -> p * q), 0D, (a, v) -> a + v)"
    out = out.withColumn("_s1", F.expr(f"if(_L = 0, 0D, aggregate(sequence(1, greatest(_L, 1)), 0D, (a, l) -> a + (1D - l / (_L + 1D)) * {cross}))"))
    variance = F.when(F.col("_L") > 0, (F.col("_s0") + 2 * F.col("_s1")) / (F.col("_n") * F.col("_n").cast("double"))).otherwise(F.col("_s0") / ((F.col("_n") - 1) * F.col("_n").cast("double")))
    out = out.withColumn("nw_se", F.sqrt(F.greatest(variance, F.lit(0.0)))).withColumn("t_stat", F.try_divide("mean", "nw_se"))
    out = out.select(*keys, "mean", "nw_se", "t_stat", F.col("_n").cast("double").alias("n_periods"), F.col("_L").alias("nw_lags"))
    return with_p_values(out) if pvalues else out


def with_p_values(df: DataFrame) -> DataFrame:
    """p_value from t_stat, n_periods and nw_lags; one row per tested mean goes through Python."""
    names = df.columns

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("t_stat", "n_periods", "nw_lags")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p_value(*r) for r in rows], pa.float64())], [*names, "p_value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(valued, f"{schema}, p_value double")


def contrast_se(value: Column) -> Column:
    """The plain standard error of a mean."""
    return F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value).cast("double")))


def grouped_ols(df: DataFrame, y: str, xs: list[str], by: str, least: int, intercept: bool = True) -> DataFrame:
    """One row per group with enough complete rows: ``by``, n, intercept (where asked for) and a coefficient per regressor.

    Means and centred products are running aggregates, updated per task and merged in one exchange
    of a row per task and group; the pseudo-inverse gives the least-norm slopes for collinear
    regressors.
    """
    values = [y, *xs]
    good = finite(F.col(y))
    for c in xs:
        good = good & finite(F.col(c))
    rows = df.where(good).select(F.col(by).alias("_g"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)])
    k = len(values)
    if intercept:
        means = [F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k)]
        products = [(F.covar_pop(f"_v{i}", f"_v{j}") * F.count(F.lit(1))).alias(f"_p{i}_{j}") for i in range(k) for j in range(i, k)]
    else:
        means = [F.lit(0.0).alias(f"_m{i}") for i in range(k)]
        products = [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_p{i}_{j}") for i in range(k) for j in range(i, k)]
    gram = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *means, *products).where(F.col("n") >= max(least, len(xs) + intercept + 1))
    kind = df.schema[by].dataType.simpleString()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([batch.column(f"_m{i}").to_numpy(zero_copy_only=False) for i in range(k)], 1)
            p = np.zeros((batch.num_rows, k, k))
            for i in range(k):
                for j in range(i, k):
                    p[:, i, j] = p[:, j, i] = batch.column(f"_p{i}_{j}").to_numpy(zero_copy_only=False)
            beta = np.einsum("gij,gj->gi", np.linalg.pinv(p[:, 1:, 1:], rcond=1e-13, hermitian=True), p[:, 1:, 0]) if xs else np.zeros((batch.num_rows, 0))
            alpha = [m[:, 0] - (m[:, 1:] * beta).sum(1)] if intercept else []
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("n"), *map(pa.array, alpha), *[pa.array(beta[:, i]) for i in range(len(xs))]], [by, "n", *["intercept"] * intercept, *xs])

    head = f"`{by}` {kind}, n long" + (", intercept double" if intercept else "")
    return gram.mapInArrow(solved, head + "".join(f", `{c}` double" for c in xs))


@dataclass(frozen=True)
class Premia:
    """Coefficient paths by date, and their means with robust errors."""

    path: DataFrame
    lambdas: DataFrame


def _premia(path: DataFrame, names: list[str], lags: int | None, pvalues: bool) -> Premia:
    long = path.unpivot(["trade_date"], names, "name", "value")
    out = newey_west(long, "value", ["name"], lags=lags, pvalues=pvalues)
    return Premia(path.select("trade_date", *names), out)


def fama_macbeth(panel: DataFrame, chars: list[str], ret: str = "excess_ret", intercept: bool = True, lags: int | None = None, least: int = 20, pvalues: bool = True) -> Premia:
    """Cross-sectional regressions per date, then robust means of the coefficients. Falls back from excess_ret to ret."""
    if ret not in panel.columns and ret == "excess_ret" and "ret" in panel.columns:
        ret = "ret"
    missing = [c for c in [ret, *chars] if c not in panel.columns]
    if missing:
        raise KeyError(missing)
    path = grouped_ols(panel, ret, chars, "trade_date", least, intercept)
    return _premia(path, [*["intercept"] * intercept, *chars], lags, pvalues)


def time_series_betas(returns: DataFrame, factors: DataFrame, columns: list[str], ret: str = "excess_ret", least: int = 60) -> DataFrame:
    """alpha and beta_<factor> of each symbol."""
    joined = returns.select("trade_date", "symbol", F.col(ret).alias("_y")).join(factors.select("trade_date", *columns), "trade_date")
    fitted = grouped_ols(joined, "_y", columns, "symbol", least)
    return fitted.select("symbol", F.col("n").alias("n_obs"), F.col("intercept").alias("alpha"), *[F.col(c).alias(f"beta_{c}") for c in columns])


def fama_macbeth_two_pass(returns: DataFrame, factors: DataFrame, columns: list[str], ret: str = "excess_ret", lags: int | None = None, least_series: int = 60, least: int = 20, pvalues: bool = True) -> Premia:
    """Full-sample betas per symbol, then cross-sections of returns on the betas."""
    betas = time_series_betas(returns, factors, columns, ret, least_series).select("symbol", *[F.col(f"beta_{c}") for c in columns])
    panel = returns.select("trade_date", "symbol", ret).join(betas, "symbol")
    return fama_macbeth(panel, [f"beta_{c}" for c in columns], ret, lags=lags, least=least, pvalues=pvalues)


def factor_metrics(factors: DataFrame, columns: list[str], lags: int | None = None, periods: float = 252, pvalues: bool = True) -> DataFrame:
    """Robust mean and summary of each factor's series; series of fewer than 2 values are left out."""
    long = factors.unpivot(["trade_date"], columns, "name", "value")
    robust = newey_west(long, "value", ["name"], lags=lags, pvalues=pvalues).drop("n_periods", "mean")
    return summary(long, "value", ["name"], periods=periods).join(robust, "name")


def diagnostics(premia: DataFrame | None = None, portfolio: DataFrame | None = None, quantiles: DataFrame | None = None) -> DataFrame:
    """section, name, value, t_stat, nw_se: premia, portfolio metrics and per-quantile Sharpe ratios stacked."""
    none = F.lit(None).cast("double")
    parts = []
    if premia is not None:
        parts.append(premia.select(F.lit("fm_premium").alias("section"), "name", F.col("mean").alias("value"), "t_stat", "nw_se"))
    if portfolio is not None:
        numbers = [c for c, kind in portfolio.dtypes if kind in ("double", "bigint", "int", "float")]
        long = portfolio.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "name", "value")
        parts.append(long.select(F.lit("portfolio").alias("section"), "name", "value", none.alias("t_stat"), none.alias("nw_se")))
    if quantiles is not None:
        parts.append(quantiles.select(F.lit("quantile").alias("section"), F.format_string("Q%d", "quantile").alias("name"), F.col("sharpe").alias("value"), none.alias("t_stat"), none.alias("nw_se")))
    if not parts:
        raise ValueError("nothing to stack")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
