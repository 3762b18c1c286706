"""Quantile portfolios: formation weights, holding, turnover, daily results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sum0
from .calendars import rebalance_dates, trading_calendar
from .cross_section import KINDS, sorts
from .signals import lag_signal


def filter_eligible(df: DataFrame, universe: DataFrame | None = None, require_return: bool = True, signal: str | None = None, ret: str = "ret") -> DataFrame:
    """Names of the universe (by date and symbol, or of any snapshot), with a return and a signal where asked for."""
    out = df
    if universe is not None:
        keys = ["trade_date", "symbol"] if "trade_date" in universe.columns else ["symbol"]
        out = out.join(universe.select(*keys).distinct(), keys, "left_semi")
    if require_return:
        out = out.where(F.col(ret).isNotNull())
    return out.where(F.col(signal).isNotNull()) if signal else out


def long_short_weights(sorted_panel: DataFrame, n: int, long_high: bool = True, weighting: str = "equal", weight_col: str | None = "market_cap", quantile: str = "quantile") -> DataFrame:
    """Weights of the extreme buckets, each side half of the gross; value weights leave out names without a positive cap."""
    high, low = F.col(quantile) == n, F.col(quantile) == 1
    rows = sorted_panel.where(high | low).withColumns({"is_long": high if long_high else low, "is_short": low if long_high else high})
    value = weighting == "value" and bool(weight_col) and weight_col in sorted_panel.columns
    if value:
        rows = rows.where(F.col(weight_col) > 0)
    raw = F.col(weight_col).cast("double") if value else F.lit(1.0)
    side = Window.partitionBy("trade_date", "is_long")
    rows = rows.withColumn("_w", raw).withColumn("weight", F.when(F.col("is_long"), 0.5).otherwise(-0.5) * F.try_divide(F.col("_w"), F.sum("_w").over(side)))
    kept = ["trade_date", "symbol", quantile, "weight", "is_long", "is_short"] + ([weight_col] if weight_col and weight_col in sorted_panel.columns else [])
    return rows.where("weight is not null and weight != 0").select(*kept)


def weights_by_date(weights: DataFrame) -> DataFrame:
    return weights.groupBy("trade_date").agg(F.sum("weight").alias("w_sum"), F.sum(F.abs("weight")).alias("gross"), F.count_if("is_long").alias("n_long"), F.count_if("is_short").alias("n_short"))


def neutrality_violations(weights: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Dates whose weights don't sum to 0, or that hold a zero weight."""
    by_date = weights.groupBy("trade_date").agg(F.sum("weight").alias("w_sum"), F.count_if(F.col("weight") == 0).alias("n_zero"))
    return by_date.where((F.abs("w_sum") >= tolerance) | (F.col("n_zero") > 0))


def assert_dollar_neutral(weights: DataFrame, tolerance: float = 1e-10) -> None:
    bad = neutrality_violations(weights, tolerance).limit(5).collect()
    if bad:
        raise AssertionError(f"not dollar neutral: {[(str(r[0]), r[1], r[2]) for r in bad]}")


def form_portfolio(panel: DataFrame, signal: str, kind: str = "quintile", long_high: bool = True, weighting: str = "equal", weight_col: str | None = "market_cap", validate: bool = False) -> DataFrame:
    weights = long_short_weights(sorts(panel, signal, kind), KINDS[kind], long_high, weighting, weight_col)
    if validate:
        assert_dollar_neutral(weights)
    return weights


def propagate(weights: DataFrame, calendar: DataFrame, hold: str = "asof") -> DataFrame:
    """Each formation's weight from the next calendar date on, until the name's next formation.

    ``hold="rebalance"`` lets go of names that the next formation leaves out; ``asof`` keeps them.
    A formation is a stretch of the calendar's numbers, which becomes a row for each of its dates;
    what a row has besides its weight is of the same formation. The numbering is a window over
    calendar and formation dates, some thousand rows.
    """
    if hold not in ("asof", "rebalance"):
        raise ValueError(f"unknown hold {hold}")
    extra = [c for c in ("quantile", "is_long", "is_short") if c in weights.columns]
    days = calendar.select("trade_date").where("trade_date is not null").distinct()
    formed = weights.select(F.col("trade_date").alias("_f")).where("_f is not null").distinct()
    order = Window.orderBy("d", "m")
    both = days.select(F.col("trade_date").alias("d"), F.lit(1).alias("m")).union(formed.select(F.col("_f").alias("d"), F.lit(0).alias("m")))
    numbered = both.withColumns({"k": F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("m").over(Window.partitionBy())})
    first = numbered.where("m = 0").select(F.col("d").alias("trade_date"), (F.col("k") + 1).alias("_from"), "n")  # the first calendar date at or after
    first = first.withColumn("_after", F.lead("_from").over(Window.orderBy("_from")))
    dates = numbered.where("m = 1").select("k", F.col("d").alias("_day"))
    rows = weights.select("trade_date", "symbol", "weight", *extra).join(first, "trade_date")
    until = F.col("_after") if hold == "rebalance" else F.lead("_from").over(Window.partitionBy("symbol").orderBy("trade_date"))
    rows = rows.withColumn("_to", F.least(F.coalesce(until, F.col("n")), F.col("n"))).where("_from < _to and weight is not null")
    held = rows.select("symbol", "weight", *extra, F.explode(F.expr("sequence(_from + 1, _to)")).alias("k"))
    return held.join(dates, "k").select(F.col("_day").alias("trade_date"), "symbol", "weight", *extra)


def turnover(weights: DataFrame) -> DataFrame:
    """One-way (bought) and two-way (half of all changes) turnover of each formation; 0 on the first.

    Each weight counts for its own formation and against the next one; the numbering is a window
    over the formation dates alone, a few thousand rows.
    """
    one = weights.groupBy("trade_date", "symbol").agg(F.max("weight").alias("weight"))
    dates = one.select("trade_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("trade_date")))
    placed = one.join(dates, "trade_date").select("k", "symbol", "weight")
    change = placed.unionByName(placed.select((F.col("k") + 1).alias("k"), "symbol", (-F.col("weight")).alias("weight"))).groupBy("k", "symbol").agg(F.sum("weight").alias("d"))
    by_date = change.groupBy("k").agg(F.sum(F.greatest("d", F.lit(0.0))).alias("bought"), (F.sum(F.abs("d")) / 2).alias("changed"))
    first = F.col("k") == 1
    return dates.join(by_date, "k").select("trade_date", F.when(first, 0.0).otherwise(F.col("bought")).alias("turnover_one_way"), F.when(first, 0.0).otherwise(F.col("changed")).alias("turnover_two_way"))


def average_turnover(by_date: DataFrame) -> DataFrame:
    """The means over all formations but the first; 0 with none."""
    rest = by_date.withColumn("_k", F.row_number().over(Window.orderBy("trade_date"))).where("_k > 1")  # one row per formation
    return rest.agg(F.coalesce(F.avg("turnover_one_way"), F.lit(0.0)).alias("avg_turnover_one_way"), F.coalesce(F.avg("turnover_two_way"), F.lit(0.0)).alias("avg_turnover_two_way"))


def daily_results(held: DataFrame, returns: DataFrame, tc_bps: float = 0.0, by_date: DataFrame | None = None, ret: str = "ret") -> DataFrame:
    """gross_ret, w_sum, tc, net_ret and wealth per date. Names without a return add nothing.

    ``tc_bps`` are basis points of two-way turnover, taken on formation dates.
    """
    rows = held.join(returns.select("trade_date", "symbol", F.col(ret).alias("_r")), ["trade_date", "symbol"], "left")
    out = rows.groupBy("trade_date").agg(sum0(F.col("weight") * F.col("_r")).alias("gross_ret"), F.sum("weight").alias("w_sum"))
    if tc_bps and by_date is not None:
        out = out.join(by_date.select("trade_date", (F.col("turnover_two_way") * tc_bps / 10_000).alias("tc")), "trade_date", "left").withColumn("tc", F.coalesce("tc", F.lit(0.0)))
    else:
        out = out.withColumn("tc", F.lit(0.0))
    out = out.withColumn("net_ret", F.col("gross_ret") - F.col("tc"))
    path = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return out.withColumn("wealth", F.product(F.lit(1.0) + F.col("net_ret")).over(path))


def quantile_spread(panel: DataFrame, signal: str, kind: str = "quintile", weighting: str = "equal", weight_col: str | None = "market_cap", ret: str = "ret") -> DataFrame:
    """q_ret: the mean (or value-weighted mean) return of each bucket on each date."""
    rows = sorts(panel, signal, kind).where(F.col("quantile").isNotNull() & F.col(ret).isNotNull())
    value = weighting == "value" and bool(weight_col) and weight_col in panel.columns
    w = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if value else F.lit(1.0)
    rows = rows.select("trade_date", "quantile", w.alias("_w"), (w * F.col(ret)).alias("_wr"))
    total = F.sum("_w")
    return rows.groupBy("trade_date", "quantile").agg(F.when(total != 0, F.sum("_wr") / total).otherwise(F.lit(float("nan"))).alias("q_ret"))


@dataclass(frozen=True)
class BacktestConfig:
    signal_col: str
    kind: str = "quintile"
    long_high: bool = True
    weighting: str = "equal"
    weight_col: str | None = "market_cap"
    frequency: str = "month_end"
    ret_col: str = "ret"
    ensure_lag: bool = False
    lag_periods: int = 1
    tc_bps: float = 0.0
    validate_weights: bool = True
    hold: str = "asof"


@dataclass(frozen=True)
class BacktestResult:
    weights: DataFrame
    held: DataFrame
    turnover: DataFrame
    pnl: DataFrame
    metrics: DataFrame
    config: BacktestConfig = field(repr=False, default=None)


def formation_panel(panel: DataFrame, config: BacktestConfig, universe: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The rows of rebalance dates that are eligible, and the signal's name."""
    signal = config.signal_col
    if config.ensure_lag:
        panel, signal = lag_signal(panel, signal, config.lag_periods), f"{signal}_lag{config.lag_periods}"
    dates = rebalance_dates(panel, config.frequency)
    rows = filter_eligible(panel, universe, require_return=False, signal=signal)
    return rows.join(dates, "trade_date", "left_semi"), signal


def run_backtest(panel: DataFrame, config: BacktestConfig, universe: DataFrame | None = None) -> BacktestResult:
    """Formation, holding, turnover, results and summary; lazy but for the validation's one action."""
    from .metrics import summary

    rows, signal = formation_panel(panel, config, universe)
    weights = form_portfolio(rows, signal, config.kind, config.long_high, config.weighting, config.weight_col, config.validate_weights)
    held = propagate(weights, trading_calendar(panel), config.hold)
    by_date = turnover(weights)
    pnl = daily_results(held, panel, config.tc_bps, by_date, config.ret_col)
    counts = rebalance_dates(panel, config.frequency).agg(F.count("*").alias("n_rebals"))
    days = pnl.agg(F.count("*").alias("n_days"), (F.max_by("wealth", "trade_date") - 1).alias("total_net_return"))
    metrics = average_turnover(by_date).crossJoin(counts).crossJoin(days).crossJoin(summary(pnl, "net_ret"))  # one row each
    return BacktestResult(weights, held, by_date, pnl, metrics, config)
