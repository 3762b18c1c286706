"""Backward as-of joins: each left row gets the last right row at or before its own time.

The whole right row is carried, its nulls included. Two strategies with equal results: ``union``
tags both sides, unions them and carries the last right row over one ordered window (one shuffle,
for keyed joins of any size); ``interval`` turns the right side into validity intervals and joins
on the range, for right sides without a key or small enough for Spark to broadcast by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: list[str] | None = None,
    payload: list[str] | None = None,
    *,
    tie: list[str] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """``left`` with the right side's ``payload`` (default: all but ``by``), null without a match.

    Of right rows with one time and key the greatest by ``tie`` (default: the payload) wins. Null times never match.
    """
    keys = list(by or [])
    carried = payload or [c for c in right.columns if c not in keys]
    order = tie or carried
    clash = set(carried) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    rows = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), F.struct(*carried).alias("_r"), F.struct(*[right[c].alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"))
    rows = rows.groupBy(*keys, "_t").agg(F.max_by("_r", "_o").alias("_r"))
    if strategy == "auto":
        strategy = "union" if keys else "interval"
    if strategy == "union":
        tagged_left = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
        tagged_right = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t", F.lit(0).alias("_side"), "_r")
        both = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
        names = [f"_k{i}" for i in range(len(keys))]
        seen = Window.partitionBy(*names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
        matched = F.lit(True)
        for name in names:
            matched = matched & F.col(name).isNotNull()
        matched = matched & F.col("_t").isNotNull()
        return out.select("_l.*", *[F.when(matched, F.col("_m").getField(c)).alias(c) for c in carried])
    if strategy != "interval":
        raise ValueError(f"unknown strategy {strategy}")
    # without a key the window has one partition: a series by date, thousands of rows
    upto = F.lead("_t").over(Window.partitionBy(*keys).orderBy("_t")) if keys else F.lead("_t").over(Window.orderBy("_t"))
    spans = rows.withColumn("_to", upto).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t", "_to", "_r")
    on = (left[left_on] >= spans["_t"]) & (spans["_to"].isNull() | (left[left_on] < spans["_to"]))
    for i, k in enumerate(keys):
        on = on & (left[k] == spans[f"_k{i}"])
    return left.join(spans, on, "left").select(*[left[c] for c in left.columns], *[F.col("_r").getField(c).alias(c) for c in carried])
