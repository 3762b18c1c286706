"""Performance metrics of return series, whole or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite

PERIODS = 252
STATS = ["n_obs", "mean", "std", "ann_mean", "ann_vol", "sharpe", "max_drawdown", "hit_rate", "total_return"]


def sharpe(ret: Column, periods: float = PERIODS, rf: float = 0.0) -> Column:
    """Annualised mean over standard deviation; NaN with fewer than 2 values or next to no deviation."""
    spread = F.stddev_samp(ret)
    return F.when((F.count(ret) >= 2) & (spread >= 1e-12), F.sqrt(F.lit(float(periods))) * (F.avg(ret) - F.lit(rf)) / spread).otherwise(F.lit(float("nan")))


def hit_rate(ret: Column) -> Column:
    return F.avg((ret > 0).cast("double"))


def wealth_path(df: DataFrame, ret: str, by: list[str] | None = None, date: str = "trade_date", start: float = 1.0, out: str = "wealth") -> DataFrame:
    """Cumulative product of 1 + return; what isn't finite counts as 0. One window per series."""
    path = Window.partitionBy(*(by or [])).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    r = F.when(finite(F.col(ret)), F.col(ret)).otherwise(F.lit(0.0))
    return df.withColumn(out, F.lit(start) * F.product(F.lit(1.0) + r).over(path))


def drawdown_path(df: DataFrame, wealth: str = "wealth", by: list[str] | None = None, date: str = "trade_date", out: str = "drawdown") -> DataFrame:
    """wealth over its highest value so far, minus 1; the first value is the first peak."""
    path = Window.partitionBy(*(by or [])).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.col(wealth) / F.max(wealth).over(path) - 1)


def summary(df: DataFrame, ret: str, by: list[str] | None = None, date: str = "trade_date", periods: float = PERIODS) -> DataFrame:
    """The statistics of a series' finite returns, per group where asked for."""
    keys = by or []
    rows = drawdown_path(wealth_path(df.where(finite(F.col(ret))), ret, keys, date), "wealth", keys, date)
    r = F.col(ret)
    spread = F.coalesce(F.stddev_samp(r), F.lit(float("nan")))
    return rows.groupBy(*keys).agg(
        F.count(r).cast("double").alias("n_obs"),
        F.avg(r).alias("mean"),
        spread.alias("std"),
        (F.avg(r) * periods).alias("ann_mean"),
        (spread * F.sqrt(F.lit(float(periods)))).alias("ann_vol"),
        sharpe(r, periods).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        hit_rate(r).alias("hit_rate"),
        (F.max_by("wealth", date) - 1).alias("total_return"),
    )


def quantile_metrics(spread: DataFrame, ret: str = "q_ret", periods: float = PERIODS) -> DataFrame:
    return summary(spread, ret, ["quantile"], periods=periods)


def metrics_bundle(pnl: DataFrame, weights: DataFrame | None = None, ret: str = "net_ret", name: str = "portfolio") -> DataFrame:
    """One row: the summary, and the average turnover where weights are given."""
    from .portfolio import average_turnover, turnover

    out = summary(pnl, ret)
    if weights is not None:
        out = out.crossJoin(average_turnover(turnover(weights)))  # one row each
    return out.select(F.lit(name).alias("name"), "*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of columns over rows where all are known, in one aggregation.

    With fewer than 2 columns or 3 rows only the names (``factor``) come back.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([(c,) for c in columns], "factor string")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(a, b).alias(f"_{columns.index(a)}_{columns.index(b)}") for a, b in pairs])
    at = lambda i, j: F.col(f"_{min(i, j)}_{max(i, j)}") if i != j else F.lit(1.0)
    lines = F.array(*[F.struct(F.lit(a).alias("factor"), *[at(i, j).alias(b) for j, b in enumerate(columns)]) for i, a in enumerate(columns)])
    return sums.where("_n >= 3").select(F.explode(lines).alias("x")).select("x.*")
