"""Which cities are asked about after each batch, and which readings come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.functions.timegrid import bucket_of, slice_start
from hazemeter.operators.batches import SEQ_BLOCK, advancing
from hazemeter.operators.scan import before, one_block, so_far, with_block_carry
from hazemeter.params import DEFAULTS, Params
from hazemeter.session import together, written

KEY = ["city", "period"]


def arrivals(readings: DataFrame) -> DataFrame:
    """Per city, period and batch: latest, earliest and first-positioned reading time."""
    return readings.groupBy(*KEY, "seq").agg(
        F.max("ts_ms").alias("max_ts"),
        F.min("ts_ms").alias("min_ts"),
        F.min_by("ts_ms", "pos").alias("first_ts"),
    )


def arrivals_of_cells(cells: DataFrame) -> DataFrame:
    """``arrivals``, plus the last-positioned reading, from cells."""
    return cells.groupBy(*KEY, "seq").agg(
        F.max("max_ts").alias("max_ts"),
        F.min("min_ts").alias("min_ts"),
        F.min_by("first_ts", "first_pos").alias("first_ts"),
        F.max("last_pos").alias("last_pos"),
        F.max_by("last_ts", "last_pos").alias("last_ts"),
    )


def _latest_batch_at(times: DataFrame, headers: DataFrame, width: int) -> DataFrame:
    """For each distinct ``t``, the last batch with ``wm <= t`` (as-of lookup).

    Both sides share one time axis, cut into blocks of ``width``; a block holds at
    most one row per distinct millisecond of ``t`` plus its batches.
    """
    axis = (
        times.select("t").distinct().withColumn("at_seq", F.lit(None).cast("bigint"))
        .unionByName(headers.select(F.col("wm").alias("t"), F.col("seq").alias("at_seq")))
    )
    scanned = with_block_carry(
        axis, [], bucket_of(F.col("t"), width),
        {"block_last": F.max("at_seq")},
        {"carry": lambda w: F.max("block_last").over(before(w))},
    )
    # batches sort before lookups at the same time
    inside = so_far(Window.partitionBy("block").orderBy("t", F.col("at_seq").isNull()))
    found = F.greatest("carry", F.max("at_seq").over(inside)).alias("last_seq")
    return scanned.select("t", "at_seq", found).where("at_seq is null").drop("at_seq")


def active_probes(arrived: DataFrame, headers: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per batch and city with a reading no older than ``wm - active_ms``.

    Between two of its batches a city's latest reading time stays the same and
    watermarks only advance, so it is active from a batch up to the last one whose
    watermark is still within reach. That end comes from an as-of lookup; the
    batches in between are then generated (batch numbers are consecutive), and
    every generated row is a result.
    """
    block = bucket_of(F.col("seq"), SEQ_BLOCK)
    carried = with_block_carry(
        arrived.select(*KEY, "seq", "max_ts"), KEY, block,
        {"block_max": F.max("max_ts"), "block_first": F.min("seq")},
        {
            "carry": lambda w: F.max("block_max").over(before(w)),
            "next_first": lambda w: F.lead("block_first").over(w),
        },
        alone=one_block(arrived, block),
    )
    inside = Window.partitionBy(*KEY, "block").orderBy("seq")
    spans = carried.select(
        *KEY, "seq",
        F.coalesce(F.lead("seq").over(inside), F.col("next_first")).alias("next_seq"),
        (F.greatest("carry", F.max("max_ts").over(so_far(inside))) + params.active_ms).alias("t"),
    )
    # both feed several branches below
    ahead, spans = together(lambda: written(advancing(headers), "ahead"), lambda: written(spans, "spans"))
    ends = _latest_batch_at(spans, ahead, params.step_ms)
    return (
        spans.join(ends, "t")
        .where("last_seq is not null")
        .withColumn("until", F.least("last_seq", F.col("next_seq") - 1))
        .where("until >= seq")
        .select(*KEY, F.explode(F.sequence("seq", "until")).alias("seq"))
        .join(ahead, "seq")
        .select("seq", "wm", *KEY)
    )


def late_bounds(arrived: DataFrame, probes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(city, period, seq, bound)`` for the batches that hold late readings.

    A reading is late if it is older than the latest watermark its city was asked
    about in an earlier batch, or than the slice of the city's first reading.
    """
    none = F.lit(None).cast("bigint")
    both = (
        arrived.select(*KEY, "seq", "min_ts", "first_ts", none.alias("wm"))
        .unionByName(probes.select(*KEY, "seq", none.alias("min_ts"), none.alias("first_ts"), "wm"))
    )
    block = bucket_of(F.col("seq"), SEQ_BLOCK)
    scanned = with_block_carry(
        both, KEY, block,
        {"block_wm": F.max("wm"), "block_first": F.min_by("first_ts", F.when(F.col("first_ts").isNotNull(), F.col("seq")))},
        {
            "carry": lambda w: F.max("block_wm").over(before(w)),
            "carry_first": lambda w: F.first("block_first", ignorenulls=True).over(before(w)),
        },
        alone=one_block(both, block),
    )
    # a batch's readings come before its own probe
    order = Window.partitionBy(*KEY, "block").orderBy("seq", F.col("wm").isNotNull())
    asked = F.greatest("carry", F.max("wm").over(before(order)))
    first = F.coalesce("carry_first", F.first("first_ts", ignorenulls=True).over(so_far(order)))
    return (
        scanned.withColumns({"asked": asked, "first": first}).where("min_ts is not null")
        .withColumn("bound", F.greatest("asked", slice_start(F.col("first"), params.step_ms, params.origin_ms)))
        .where("min_ts < bound")
        .select(*KEY, "seq", "bound")
    )


def drop_late(readings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Readings at or after their bound; ``bounds`` lists only batches with late ones."""
    return (
        readings.join(bounds, [*KEY, "seq"], "left")
        .where("bound is null or ts_ms >= bound")
        .select(*readings.columns)
    )
