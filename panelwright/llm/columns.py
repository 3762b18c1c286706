"""Columns by their exact names, schemas of passed-through columns, and SQL parts that take linear time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items whose positions are summed one by one; beyond, sums of blocks are.
BLOCK = 256


def own(df: DataFrame, name: str) -> Column:
    """The column of this very name, whatever characters are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame, *without: str) -> Column:
    """All columns but some as one struct."""
    return F.struct(*[own(df, c).alias(c) for c in df.columns if c not in without])


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """A schema with further nullable fields."""
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with a name for a value that it uses more than once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def starts(sizes: str) -> str:
    """SQL for where each item begins, given the sizes of all as array<int>: sums of those before it."""
    step = "(t, x) -> named_struct('at', t.at + x, 'out', concat(t.out, array(t.at)))"
    zero = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    blocks = f"transform(sequence(0, (size(sz) - 1) div {BLOCK}), k -> slice(sz, cast(k * {BLOCK} + 1 as int), {BLOCK}))"
    inner = f"transform({blocks}, block -> aggregate(block, {zero}, {step}))"
    bases = f"aggregate(transform(local, x -> x.at), {zero}, {step}, t -> t.out)"
    summed = let(inner, "local", let(bases, "bases", "flatten(zip_with(local, bases, (x, base) -> transform(x.out, y -> y + base)))"))
    return let(sizes, "sz", f"if(size(sz) = 0, cast(array() as array<int>), {summed})")
