"""Counts and coverage of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("series").agg(F.count("*").alias("n"))


def coverage(df: DataFrame) -> DataFrame:
    """Symbols per date."""
    return df.groupBy("trade_date").agg(F.countDistinct("symbol").alias("n_symbols"))


def known_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of non-null values of each column, one row."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, standard deviation, minimum and maximum per column."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def to_numpy(df: DataFrame, column: str):
    """A column of a small frame as an array."""
    return df.select(column).toArrow()[column].to_numpy(zero_copy_only=False)
