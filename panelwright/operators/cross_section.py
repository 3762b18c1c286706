"""Per-date transforms: winsorizing, z-scores, buckets, splits. One exchange by date serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, clip, nearest_quantile, section

KINDS = {"quintile": 5, "decile": 10}


def winsorize(df: DataFrame, column: str, method: str = "percentile", lower: float = 0.01, upper: float = 0.99, mad_k: float = 3.0, out: str | None = None, date: str = "trade_date") -> DataFrame:
    """Values clipped to nearest-rank quantiles, or to median +- k median absolute deviations, of their date."""
    x, out = F.col(column), out or f"{column}_w"
    if method == "percentile":
        bounds = df.withColumns({"_lo": nearest_quantile(x, lower, [date]), "_hi": nearest_quantile(x, upper, [date])})
    elif method == "mad":
        centred = df.withColumn("_m", F.median(x).over(section(date)))
        centred = centred.withColumn("_d", F.median(F.abs(x - F.col("_m"))).over(section(date)))
        spread = F.when(F.col("_d") > 0, F.col("_d") * F.lit(mad_k))
        bounds = centred.withColumns({"_lo": F.col("_m") - spread, "_hi": F.col("_m") + spread}).drop("_m", "_d")
    else:
        raise ValueError(f"unknown method {method}")
    return bounds.withColumn(out, clip(x, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def zscore(df: DataFrame, column: str, out: str | None = None, date: str = "trade_date") -> DataFrame:
    """(x - mean) / standard deviation of the date; null where that is null or 0."""
    x = F.col(column)
    spread = F.stddev_samp(x).over(section(date))
    return df.withColumn(out or f"{column}_z", F.when(spread > 0, (x - F.avg(x).over(section(date))) / spread))


def prepare_signal(df: DataFrame, column: str, winsor: bool = True, standard: bool = True, **how) -> DataFrame:
    """{column}_w and its z-score {column}_z."""
    out = winsorize(df, column, **how) if winsor else df.withColumn(f"{column}_w", F.col(column))
    return zscore(out, f"{column}_w", f"{column}_z") if standard else out


def quantile_buckets(df: DataFrame, column: str, n: int, ascending: bool = True, out: str = "quantile", date: str = "trade_date") -> DataFrame:
    """Buckets 1 to n by average rank, ties together; null on dates with fewer than n values."""
    signed = df.withColumn("_x", F.col(column) if ascending else -F.col(column))
    held = F.count("_x").over(section(date))
    bucket = F.floor((average_rank(F.col("_x"), [date], "_x") - 1) / held * n)
    bucket = F.least(F.greatest(bucket, F.lit(0)), F.lit(n - 1)) + 1
    return signed.withColumn(out, F.when(F.col("_x").isNotNull() & (held >= n), bucket).cast("int")).drop("_x")


def sorts(df: DataFrame, column: str, kind: str = "quintile", **how) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return quantile_buckets(df, column, KINDS[kind], **how)


def median_split(df: DataFrame, column: str, out: str = "size_bucket", low: str = "S", high: str = "B", date: str = "trade_date") -> DataFrame:
    """``low`` up to the date's median, ``high`` above; null stays null."""
    x = F.col(column)
    return df.withColumn("_m", F.median(x).over(section(date))).withColumn(out, F.when(x.isNull(), None).when(x <= F.col("_m"), low).otherwise(high)).drop("_m")


def tercile_labels(df: DataFrame, column: str, low_q: float = 0.3, high_q: float = 0.7, out: str = "label", date: str = "trade_date") -> DataFrame:
    """L up to the low quantile (looked at first), H from the high one, else N; null stays null."""
    x = F.col(column)
    edges = df.withColumns({"_lo": nearest_quantile(x, low_q, [date]), "_hi": nearest_quantile(x, high_q, [date])})
    label = F.when(x.isNull(), None).when(x <= F.col("_lo"), "L").when(x >= F.col("_hi"), "H").otherwise("N")
    return edges.withColumn(out, label).drop("_lo", "_hi")
