"""Running aggregates that never put a whole key into one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_block_carry(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    totals: Mapping[str, Column],
    carries: Mapping[str, Callable[[WindowSpec], Column]],
    alone: bool = False,
) -> DataFrame:
    """Adds ``block`` and, to every row, what the other blocks of its key contribute.

    A running aggregate over ``keys`` splits into one within ``(keys, block)``,
    which the caller takes with an ordinary window, and one over the blocks,
    taken here on a single row per block: ``totals`` aggregates each block and
    ``carries`` turns those into columns, given the window of a key's blocks in
    order; each may use the ones before it. A hot key is thus spread over as many tasks as it has blocks.

    ``df`` is read twice: it should be a table, or cheap to derive from one. With ``alone``, all rows are known to lie in one
    block and the carries to be of other blocks only: then they are null, and rows are neither totalled nor joined.
    """
    df = df.withColumn("block", block)
    over_blocks = Window.partitionBy(*keys).orderBy("block")
    per_block = df.groupBy(*keys, "block").agg(*[agg.alias(name) for name, agg in totals.items()])
    for name, make in carries.items():
        per_block = per_block.withColumn(name, make(over_blocks))
    if alone:
        null = {c: F.lit(None).cast(per_block.schema[c].dataType) for c in carries}
        return df.dropna(subset=[*keys, "block"]).withColumns(null)
    return df.join(per_block.select(*keys, "block", *carries), [*keys, "block"])


def one_block(df: DataFrame, block: Column) -> bool:
    """Whether all rows lie in one block. ``df`` should be a table, of which this reads what ``block`` needs."""
    low, high = df.agg(F.min(block), F.max(block)).first()
    return low == high


def before(window: WindowSpec) -> WindowSpec:
    """All rows before the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def so_far(window: WindowSpec) -> WindowSpec:
    """All rows up to and including the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def so_far_with_ties(window: WindowSpec) -> WindowSpec:
    """All rows up to the current one, plus those with the same order value."""
    return window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
