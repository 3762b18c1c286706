"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the corpus' bytes over its actual share, so ``rate`` copies
of each of its documents are expected. Each document's number of copies inverts the Poisson
distribution at a uniform value hashed from its id, and the copies are dealt out by a hash of
(id, copy): every row's partition, and its place in it, is random and repeatable.

A mean over ``SPLIT`` is drawn as the sum of equal smaller Poisson draws, each inverted exactly, so
no count is capped. Sources without a weight of their own share the weight of ``rest``. The table
of rates has at most one row per listed weight and one for the rest, and is broadcast. Documents
of at most ``BLOCK`` draws are repeated where they are read; of those with more (sources that are
to be repeated a thousand times and more) each block of draws is a row of its own, dealt out
before its copies are made. A rate over ``MOST`` raises an error that names it, as a weight that
asks for ten million copies of each document is taken for a mistake.

Defined results: a null source belongs to the rest; a null text weighs nothing but is replicated
like the others of its source; rows with the same id, nulls included, get equal counts, and copies
of rows with the same id are dealt out by their texts too. A source (the rest counting as one)
without bytes has no rate: its documents, all null or empty, are left out and its weight goes to
the others. With no bytes at all, or weights of 0, nothing is returned. Ids may be of any type
that can be cast to a string. Other columns pass through unchanged, whatever they are called;
``copy`` and ``n_copies`` replace columns of these names where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import own, starts, whole_row

#: The largest mean that is inverted in one draw, and the terms of its distribution that a double can tell from 1.
SPLIT, TERMS = 32, 140
#: Draws of one document that are made in one row, and the largest mean of all its draws.
BLOCK, MOST = 32, 10_000_000
HEX_DIGITS = 13
REST = "\u0000rest"


def uniform(*parts: Column | str) -> Column:
    """A repeatable value in [0, 1) hashed from the parts."""
    digest = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def _rates(docs: DataFrame, bucket: Column, text: Column, weights: dict[str, float], rest: float) -> DataFrame:
    """bucket, pieces, cdf: a row for each bucket that has bytes."""
    known = F.create_map(*[F.lit(x) for k, w in {**weights, REST: rest}.items() for x in (k, float(w))])
    sizes = docs.select(bucket.alias("bucket"), F.octet_length(text).alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"))
    sizes = sizes.where("size > 0").withColumn("weight", F.element_at(known, F.col("bucket"))).where("weight > 0")
    whole = Window.partitionBy(F.lit(0))  # at most one row per listed weight and one more
    rates = sizes.withColumns({"total": F.sum("size").over(whole), "weights": F.sum("weight").over(whole)}).withColumn("rate", F.expr("weight / weights * total / size"))
    too_many = F.raise_error(F.concat(F.lit("a source would be repeated "), F.col("rate").cast("string"), F.lit(f" times, over {MOST}")))
    rates = rates.withColumn("pieces", F.when(F.col("rate") <= MOST, F.ceil(F.col("rate") / SPLIT)).otherwise(too_many.cast("long")).cast("int")).withColumn("mean", F.col("rate") / F.col("pieces"))
    cdf = f"""aggregate(sequence(1, {TERMS}),
        named_struct('p', exp(-mean), 'c', exp(-mean), 'all', array(exp(-mean))),
        (a, k) -> named_struct('p', a.p * mean / k, 'c', a.c + a.p * mean / k, 'all', concat(a.all, array(a.c + a.p * mean / k))), a -> a.all)"""
    return rates.select("bucket", "rate", "pieces", F.expr(cdf).alias("cdf"))


def replicate(
    docs: DataFrame, weights: dict[str, float], rest: float = 1.0, seed: int = 0, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", marks: bool = True
) -> DataFrame:
    """Copies of ``docs`` in random order; with ``marks`` also copy (from 1) and n_copies."""
    listed = F.create_map(*[F.lit(x) for k in weights for x in (k, k)]) if weights else F.lit(None)
    bucket = F.coalesce(F.element_at(listed, own(docs, source_col).cast("string")), F.lit(REST)) if weights else F.lit(REST)
    text = own(docs, text_col).cast("string")
    rates = _rates(docs, bucket, text, weights, rest)
    key = F.coalesce(own(docs, id_col).cast("string"), F.lit("null"))
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"), F.xxhash64(text).alias("salt"), bucket.alias("bucket"))
    us = F.transform(F.sequence(F.lit(1), "pieces"), lambda j: uniform(str(seed), "count", F.col("key"), j.cast("string")))
    count = "aggregate({}, 0, (n, u) -> n + size(filter(cdf, c -> c <= u)))"
    few = rows.join(F.broadcast(rates.where(F.col("pieces") <= BLOCK)), "bucket").withColumn("us", us)
    few = few.withColumn("n_copies", F.expr(count.format("us"))).where("n_copies > 0").select("row", "key", "salt", "n_copies", F.lit(0).alias("start"), F.col("n_copies").alias("n"))
    many = rows.join(F.broadcast(rates.where(F.col("pieces") > BLOCK)), "bucket").withColumn("us", us)
    blocks = F.expr(f"transform(sequence(0, (pieces - 1) div {BLOCK}), k -> {count.format(f'slice(us, cast(k * {BLOCK} + 1 as int), {BLOCK})')})")
    many = many.withColumn("blocks", blocks).withColumns({"n_copies": F.expr("aggregate(blocks, 0, (t, x) -> t + x)"), "starts": F.expr(starts("blocks"))})
    many = many.select("row", "key", "salt", "n_copies", F.explode(F.arrays_zip("starts", "blocks")).alias("x")).select("row", "key", "salt", "n_copies", F.col("x.starts").alias("start"), F.col("x.blocks").alias("n"))
    many = many.where("n > 0").repartition("key", "salt", "start")
    copies = few.unionByName(many).select("row", "key", "salt", "n_copies", F.explode(F.expr("sequence(start + 1, start + n)")).alias("copy"))
    copies = copies.withColumn("dealt", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "key", F.col("copy").cast("string"), F.col("salt").cast("string"))))
    copies = copies.repartition("dealt").sortWithinPartitions("dealt")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if not marks or c not in ("copy", "n_copies")]
    return copies.select(*kept, *(["copy", "n_copies"] if marks else []))
