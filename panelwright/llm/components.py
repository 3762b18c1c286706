"""Connected components of a table of links, by contraction.

In each round every node goes to the neighbour of least rank (a fixed hash), or stays where its
own is least; links are then drawn between the nodes gone to. A star contracts in two rounds, a
chain by a constant factor a round. Nothing of the graph reaches the driver but whether links are
left. Minima are summed per node before the shuffle, and joins read written tables, so that Spark
may split them where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging


def component_links(links: DataFrame, stage: Staging, name: str) -> DataFrame:
    """(u, v): each node of ``links`` (u, v: node numbers, no loops) with the node that stands for its component, where it is another."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("c"))
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select("v", "u"))
        least = F.least(F.min(rank("v")), rank("u"))
        step = stage.put(both.groupBy("u").agg(least.getField("c").alias("to")), f"{name}-step{len(steps)}")
        gone = links.join(step.select("u", F.col("to").alias("a")), "u").join(step.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        links = stage.put(gone.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-links{len(steps)}")
        if steps:
            stage.drop(f"{name}-links{len(steps) - 1}")
        steps.append(step)
    if not steps:
        return links
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("u").alias("to"), F.col("to").alias("further")), "to", "left").select("u", F.coalesce("further", "to").alias("to"))
    out = stage.put(out.where("u != to").select("u", F.col("to").alias("v")), name)
    stage.drop(*[f"{name}-step{k}" for k in range(len(steps))], f"{name}-links{len(steps) - 1}")
    return out
