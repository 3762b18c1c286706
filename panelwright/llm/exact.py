"""Exact deduplication by most-significant-digit radix partitioning of the documents' bytes.

A document's digits are its length in bytes, then successive slices of its bytes. Each round
splits every group by its next digit; a group with one member, or whose members have ended,
leaves. Equality is decided by the digits alone: the one hash used (of the first digits, into
a bitmap of fixed size) only tells documents that are surely alone from those that enter the
rounds, and a false hit costs one round.

Slices widen by a constant factor, so the number of rounds grows with the logarithm of the
longest text up to ``widest`` (16 MiB, a tenth of what a row can hold) and linearly beyond. A round shuffles digits, sums them per group
before the shuffle, and joins the sums back with a join that Spark may split where a group is hot.

Defined results: ids may be of any type with an order. A null text counts as empty. Only A-Z are folded. A null id counts as the
smallest. Of rows with the same id and equal texts, one (any) stays. An empty table gives an
empty table. Columns other than id and text are not read by ``radix_groups`` and pass through
``drop_exact_copies`` unchanged, whatever they are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import own, whole_row
from .staging import Staging

#: Bits of the bitmap that clears surely single documents: 4 MB at most, whatever the input.
BITMAP_BITS = 1 << 25


def folded(text: Column) -> Column:
    """Text with A-Z in lower case; null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _marked(rows: DataFrame, head: int, stage: Staging) -> DataFrame:
    """``rows`` plus ``alone``: true where no other row can have the same length and head."""
    place = F.pmod(F.xxhash64("n_bytes", F.expr(f"substring(bytes, 1, {head})")), F.lit(BITMAP_BITS))
    firsts = rows.select("n_bytes", F.expr(f"substring(bytes, 1, {head})").alias("digit"))
    shared = firsts.groupBy("n_bytes", "digit").count().where("count > 1")
    spot = F.pmod(F.xxhash64("n_bytes", "digit"), F.lit(BITMAP_BITS))
    bits = (
        shared.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    bits = stage.put(bits, "bits")  # at most BITMAP_BITS / 32768 + 1 rows of 4 KB
    hit = F.expr("(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(at % 8 as int))) != 0")
    placed = rows.withColumn("spot", place).withColumns({"bucket": F.bitmap_bucket_number("spot"), "at": F.bitmap_bit_position("spot")})
    return placed.join(F.broadcast(bits), "bucket", "left").withColumn("alone", ~F.coalesce(hit, F.lit(False))).drop("bucket", "at", "bits", "spot")


def _rounds(members: DataFrame, stage: Staging, head: int, factor: int, widest: int) -> DataFrame:
    """(rid, keep_id, keep_rid, n) for each of ``members`` (rid, doc_id, n_bytes, bytes)."""
    here = members.select("rid", "doc_id", F.col("n_bytes").cast("long").alias("cls"), F.col("bytes").alias("rest"))
    settled: list[DataFrame] = []
    width, k = head, 0
    while True:
        digit = F.expr(f"substring(rest, 1, {width})")
        keyed = here.withColumn("digit", digit)
        # numbers only, so that the sums are hashed and not sorted; without any id the largest row number stays
        sums = keyed.groupBy("cls", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.max("rid")).alias("keep_rid"))
        sums = stage.put(sums, f"sums{k}")
        done = (F.col("n") == 1) | (F.length("rest") <= width)
        split = keyed.join(sums, ["cls", "digit"]).select(
            "rid",
            "doc_id",
            F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            "n",
            "keep_id",
            "keep_rid",
            done.alias("done"),
        )
        split = stage.put(split, f"round{k}", by=["done"])
        settled.append(split.where("done").select("rid", "keep_id", "keep_rid", "n"))
        onward = split.where("not done")
        stage.drop(f"sums{k}")
        if onward.isEmpty():
            break
        here = onward.select("rid", "doc_id", F.col("keep_rid").alias("cls"), "rest")
        width, k = min(width * factor, widest), k + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def radix_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    carry: bool = False,
    head: int = 64,
    factor: int = 8,
    widest: int = 1 << 24,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; with ``carry`` also ``row``, the whole row."""
    stage = Staging(docs.sparkSession, "radix")
    body = F.encode(folded(own(docs, text_col)), "UTF-8")
    rows = docs.select(
        own(docs, id_col).alias("doc_id"),
        body.alias("bytes"),
        *([whole_row(docs).alias("row")] if carry else []),
    ).withColumn("n_bytes", F.length("bytes"))
    marked = _marked(rows, head, stage)
    sha = F.sha2("bytes", 256).alias("text_sha256")
    also = ["row"] if carry else []
    single = marked.where("alone").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, *also
    )
    members = marked.where("not alone").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_bytes", "bytes", sha, *also)
    members = stage.put(members, "members")
    found = _rounds(members, stage, head, factor, widest)
    grouped = (
        members.select("rid", "doc_id", "text_sha256", *also)
        .join(found, "rid")
        .select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("keep_rid") == F.col("rid")).alias("kept"), "text_sha256", *also)
    )
    return single.unionByName(grouped)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id."""
    return radix_groups(docs, id_col, text_col, carry=True).where("kept").select("row.*")
