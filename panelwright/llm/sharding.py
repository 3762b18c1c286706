"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level a row draws one exponential clock per child, ``-ln(u) / weight`` with ``u`` hashed
from the row's key and the child's name, and goes down to the child whose clock is first; a
child's weight is the sum of the shards' weights below it. A child's clock depends on nothing but
the key, its name and its weight, so a changed weight moves rows only into or out of the subtrees
whose weights changed. ``grow`` hangs each added shard into a region of its own: then only that
region's weight changes, and one more shard takes rows only into itself (law ``key``).

Everything is built-in SQL functions. The text is read map-side for its size and checksum and is
not shuffled; slots come from one range shuffle of narrow rows and a table of counts that has one
row per (partition, shard).

Defined results: a null key is a key of its own, so all its rows share a shard. A null text has
no bytes: size 1, checksum 0. Rows with the same key share a shard and get slots in any order. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import own
from .staging import Staging

#: Hash digits of 4 bits in a draw: 52 bits, as many as a double keeps exactly.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n: int, base: int = 8, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """The layout of ``n`` shards: the first ``base`` fill regions in order, each further one is ``grow``n."""
    first = [Shard(i // (racks * per_rack), i // per_rack, i) for i in range(min(n, base))]
    return first if n <= base else grow(first, n - base)


def grow(shards: list[Shard], more: int = 1, weight: float = 1.0) -> list[Shard]:
    """``shards`` and ``more`` new ones, each in a new region and rack."""
    out = list(shards)
    for _ in range(more):
        out.append(Shard(max(s.region for s in out) + 1, max(s.rack for s in out) + 1, max(s.shard for s in out) + 1, weight))
    return out


def _clock(key: Column, level: str, name: int, weight: float) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(level), F.lit(str(name)), key))
    u = (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(u) / F.lit(float(weight))


def _draw(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the first clock."""
    children = sorted(weights)
    if len(children) == 1:
        return F.lit(children[0])
    return F.array_min(F.array(*[F.struct(_clock(key, level, c, weights[c]).alias("t"), F.lit(c).alias("c")) for c in children])).getField("c")


def _sums(shards: list[Shard], by: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in shards:
        out[getattr(s, by)] = out.get(getattr(s, by), 0.0) + s.weight
    return out


def tree_shard(key: Column, shards: list[Shard]) -> Column:
    """The shard of ``key``: three draws, one for each level of the path."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    region = _draw(key, "region", _sums(live, "region"))
    out = F.lit(None).cast("int")
    for r in sorted({s.region for s in live}):
        of_region = [s for s in live if s.region == r]
        rack = _draw(key, "rack", _sums(of_region, "rack"))
        leaf = F.lit(None).cast("int")
        for k in sorted({s.rack for s in of_region}):
            leaf = F.when(rack == k, _draw(key, "shard", _sums([s for s in of_region if s.rack == k], "shard"))).otherwise(leaf)
        out = F.when(region == r, leaf).otherwise(out)
    return out.cast("int")


def shard_rows(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null without ``grown``) for each row."""
    stage = Staging(docs.sparkSession, "shards")
    bytes_ = F.encode(F.coalesce(own(docs, text_col).cast("string"), F.lit("")), "UTF-8")
    narrow = docs.select(
        own(docs, id_col).alias("doc_id"),
        (F.length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).cast("long").alias("text_crc32"),
        tree_shard(own(docs, id_col), shards).alias("shard"),
        (tree_shard(own(docs, id_col), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    narrow = stage.put(narrow, "narrow")  # the range shuffle below samples it; the texts are read once
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = stage.put(ranged.select("*", F.shiftrightunsigned(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ranged")
    counts = ranged.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # one row per (partition, shard): a partition holds one stretch of the order, so at most partitions + shards rows
    before = F.coalesce(F.expr("sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = counts.withColumn("start", before).select("part", "shard", "first", "start")
    return ranged.join(F.broadcast(starts), ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard"),
    )
