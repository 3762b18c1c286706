"""Preference formatting: the common prefix of two conversations once, then two masked completions.

A pair has a chosen and a rejected conversation. The longest common prefix of their turns (equal
role and text, as they are written) is rendered once as the prompt; what follows on either side is
that side's completion. In a completion only what an assistant says, with its closing mark, is
trained on: the spans are given in code points of the completion.

Only built-in SQL functions. ``format_preferences`` has one shuffle, by pair; ``swapped_replies``
one by conversation and one of the last replies. A conversation is one training example and has
to fit into one row. When rendered, roles and texts are cut from control marks: ``<|im_`` inside
them becomes ``<| im_``.

Defined results: turns are ordered by their number (null first), ties by role and text, so
repeated rows are repeated turns. A null role is ``unknown``, a null text is empty; both count as
equal to those. A side without turns has an empty completion. If one side is a prefix of the other
its completion is empty. Rows with a null pair or another side than ``chosen`` and ``rejected``
are left out. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, starts

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


def _turn() -> Column:
    """A row's turn, in the order of turns."""
    return F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bare(turns: str) -> str:
    return f"transform({turns}, x -> named_struct('role', x.role, 'text', x.text))"


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '\\n', t.text, '{CLOSE}\\n')), '')")


def _spans(turns: str) -> Column:
    """start:end of what assistants say in the rendered turns, comma-joined."""
    around, closing = f"length('{OPEN}') + length(t.role) + 1", f"length('{CLOSE}')"
    begin = starts(f"transform({turns}, t -> {around} + length(t.text) + {closing} + 1)")
    said = f"transform({turns}, (t, i) -> if(t.role = 'assistant', concat(begin[i] + {around}, ':', begin[i] + {around} + length(t.text) + {closing}), null))"
    return F.expr(let(begin, "begin", f"array_join({said}, ',')"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_spans and rejected_spans of rows (pair_id, c, r), c and r arrays of turns."""
    common = "if(least(size(c), size(r)) = 0, 0, aggregate(sequence(1, least(size(c), size(r))), 0, (n, i) -> if(n = i - 1 and c[i - 1] = r[i - 1], i, n)))"
    clean = lambda turns: F.expr(f"transform({turns}, t -> named_struct('role', replace(t.role, '<|im_', '<| im_'), 'text', replace(t.text, '<|im_', '<| im_')))")
    cut = pairs.withColumn("n_common", F.expr(common)).select(
        "pair_id", "n_common", clean("slice(c, 1, n_common)").alias("p"), clean("slice(c, n_common + 1, size(c))").alias("c"), clean("slice(r, n_common + 1, size(r))").alias("r")
    )
    return cut.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        _rendered("p").alias("prompt"),
        _rendered("c").alias("chosen"),
        _rendered("r").alias("rejected"),
        _spans("c").alias("chosen_spans"),
        _spans("r").alias("rejected_spans"),
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """The formatted pairs of ``turns`` (pair_id, side, turn, role, text)."""
    rows = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select("pair_id", "side", _turn().alias("t"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    return format_pairs(pairs.select("pair_id", F.expr(_bare("c")).alias("c"), F.expr(_bare("r")).alias("r")))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r) from plain conversations (conv_id, turn, role, text): chosen ends at a
    conversation's last assistant turn, rejected has in its place the last reply of the neighbour
    (conv_id with the last bit flipped), or nothing where the neighbour has no reply.

    Conversations without an assistant turn give no pair. Turns after the last assistant turn are
    part of no completion and are left out. Of several last assistant turns of one number, the
    least text counts. Rows with a null conversation or turn are left out; other columns are
    ignored.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", _turn().alias("t"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    told = told.withColumn("said", F.expr("filter(t, x -> x.role = 'assistant')")).where("size(said) > 0")
    told = told.withColumn("last", F.expr("array_max(transform(said, x -> x.turn))")).withColumn("reply", F.expr("array_min(transform(filter(said, x -> x.turn = last), x -> x.text))"))
    before = F.expr(_bare("filter(t, x -> x.turn < last)"))
    own = told.select(F.col("conv_id").alias("pair_id"), before.alias("before"), "reply")
    other = told.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply").alias("other"))
    ends = lambda text: f"concat(before, array(named_struct('role', 'assistant', 'text', {text})))"
    both = own.join(other, "pair_id", "left")
    return both.select("pair_id", F.expr(ends("reply")).alias("c"), F.expr(f"if(other is null, before, {ends('other')})").alias("r"))
