"""Five-minute slices: the pre-aggregate every sliding window is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.functions.sums import SUMS, added, exact, nothing, sums
from hazemeter.functions.timegrid import slice_start
from hazemeter.params import DEFAULTS, Params

KEY = ["city", "period"]
PART = 288  # slices: a day of them
SPREAD = 8  # tasks at most that sum one cell before it is put together


def slice_sums(readings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(city, period, slice_end)`` and SUMS over ``[end - step, end)``, with ``s1`` and ``s2``, the sums as decimals.

    The sums are exact, and the partial aggregate runs before the
    shuffle, so a hot city arrives as one row per slice and input task.
    """
    start = slice_start(F.col("ts_ms"), params.step_ms, params.origin_ms)
    slices = readings.groupBy(*KEY, (start + params.step_ms).alias("slice_end")).agg(*sums())
    return slices.withColumns({"s1": exact(1), "s2": exact(2)})


def slice_cells(readings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Slice sums kept apart by batch, with the times and positions the rest needs.

    One pass over the readings from which arrivals, batch watermarks and slices
    are rolled up. There can be as many cells as readings, all held by the task that sums them, and a file may come as
    one task: so the readings are dealt out first, a cell's to SPREAD tasks at most, and a busy one still arrives as that many rows.
    """
    start = slice_start(F.col("ts_ms"), params.step_ms, params.origin_ms)
    needed = readings.select(*KEY, "seq", "ts_ms", "pos", "p1", "p2")
    dealt = needed.repartition(*KEY, "seq", start, F.col("pos") % SPREAD)
    return dealt.groupBy(*KEY, "seq", (start + params.step_ms).alias("slice_end")).agg(
        *sums(),
        F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"),
        F.min("pos").alias("first_pos"), F.min_by("ts_ms", "pos").alias("first_ts"),
        F.max("pos").alias("last_pos"), F.max_by("ts_ms", "pos").alias("last_ts"),
    )


def slices_of_cells(
    cells: DataFrame, readings: DataFrame, late: DataFrame | None, params: Params = DEFAULTS
) -> DataFrame:
    """``slice_sums`` of the readings that are not late, from cells.

    ``late`` has the bounds of the batches with late readings, or is None. Cells
    before their bound vanish, cells behind it count as they are; only a cell the
    bound cuts through is summed again from its readings.
    """
    if late is None:
        return cells.groupBy(*KEY, "slice_end").agg(*added())
    bounded = cells.join(late, [*KEY, "seq"], "left")
    whole = bounded.where("bound is null or min_ts >= bound").select(*KEY, "slice_end", *SUMS)
    cut = bounded.where("min_ts < bound and max_ts >= bound").select(*KEY, "seq", "slice_end", "bound")
    end = slice_start(F.col("ts_ms"), params.step_ms, params.origin_ms) + params.step_ms
    again = (
        readings.withColumn("slice_end", end)
        .join(cut, [*KEY, "seq", "slice_end"])
        .where("ts_ms >= bound")
    )
    return whole.unionByName(slice_sums(again, params).drop("s1", "s2")).groupBy(*KEY, "slice_end").agg(*added())


def slice_densify(slices: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Every slice from a key's first to its last, empty ones with zeros.

    A key's time is cut into parts first, so no array holds more than one part's slices.
    """
    step, part = (F.lit(n * params.step_ms).cast("bigint") for n in (1, PART))
    grid = (
        slices.groupBy(*KEY)
        .agg(F.min("slice_end").alias("lo"), F.max("slice_end").alias("hi"))
        .select(*KEY, "hi", F.explode(F.sequence("lo", "hi", part)).alias("lo"))
        .select(*KEY, F.explode(F.sequence("lo", F.least("hi", F.col("lo") + part - step), step)).alias("slice_end"))
    )
    dense = grid.join(slices, [*KEY, "slice_end"], "left").withColumns({c: F.coalesce(c, zero) for c, zero in nothing().items()})
    return dense.withColumns({"s1": exact(1), "s2": exact(2)})
