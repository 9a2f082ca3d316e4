"""From numbered batches to flat readings, and the batch headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.functions.timegrid import bucket_of, epoch_ms
from hazemeter.operators.scan import before, with_block_carry
from hazemeter.params import DEFAULTS, Params
from hazemeter.schema import CURRENT, LAST_YEAR
from hazemeter.session import written

# Batch numbers per block of a scan over all batches: with n batches, no task
# sees more than this many headers, or n divided by it block totals.
SEQ_BLOCK = 1 << 15


#: Repeated batch numbers that are told apart by a list in the plan; more are by a join.
LISTED = 10_000


def limit_batches(batches: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` batches by ``seq_id`` (all if None), none after the first one flagged ``last``.

    Both bounds are numbers, found from numbers and flags; the readings pass a comparison.
    """
    headers = batches.select("seq_id", "last")
    end = headers.where("last").agg(F.min("seq_id")).scalar()
    until = end.isNull() | (F.col("seq_id") <= end)
    if n is None:
        return batches.where(until)
    highest = headers.where(until).select("seq_id").distinct().orderBy("seq_id").limit(n).agg(F.max("seq_id")).scalar()
    return batches.where(until & (F.col("seq_id") <= highest))


def without_repeats(batches: DataFrame, numbers: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """One copy of every batch number; of differing copies the one with the least hash of its content.

    The choice depends on nothing but the copies, so repeating a job repeats it. Only copies are compared: what comes
    once passes by a look at its number. Up to ``listed`` repeated numbers are part of the plan, more meet the batches in
    a join. ``numbers`` has each number with the ``copies`` of it, if that is known.
    """
    batches = batches.where("seq_id is not null")
    if numbers is None:
        numbers = batches.groupBy("seq_id").agg(F.count(F.lit(1)).alias("copies"))
    repeated = numbers.where("copies > 1").select("seq_id")
    few = sorted(r[0] for r in repeated.limit(listed + 1).collect())
    if not few:
        return batches
    if len(few) <= listed:
        known = F.col("seq_id").isin(few)
        once, copies = batches.where(~known), batches.where(known)
    else:
        once, copies = (batches.join(repeated, "seq_id", how) for how in ("left_anti", "left_semi"))
    content = F.xxhash64("last", "current", "lastyear")
    order = Window.partitionBy("seq_id").orderBy("hash")
    chosen = copies.withColumn("hash", content).withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return once.unionByName(chosen.select(*once.columns))


def release_bounds(numbers: DataFrame, start: int = 0, n: int | None = None) -> tuple[int, int]:
    """The numbers ``[start, end)`` that can be released: without a gap, up to the first one flagged ``last``, ``n`` at most.

    ``numbers`` has each number once, with its ``copies`` and whether any copy is ``last``. The first gap is the
    smallest number whose successor has not arrived, found by joining the numbers to themselves shifted by one.
    """
    followed = numbers.select((F.col("seq_id") - 1).alias("seq_id"))
    gap = numbers.join(followed, "seq_id", "left_anti").agg(F.min("seq_id")).scalar()
    ends = numbers.agg(F.min("seq_id").alias("first"), F.min(F.when(F.col("last"), F.col("seq_id"))).alias("flagged"))
    first, flagged, run_end = ends.select("first", "flagged", gap.alias("run_end")).first()
    if first != start:
        return start, start
    end = (run_end if flagged is None else min(run_end, flagged)) + 1
    return start, end if n is None else min(end, start + n)


def feed_bounds(numbers: DataFrame, due: DataFrame, feed: str, together: bool = False) -> DataFrame:
    """``(feed, first, end)``: of every feed the numbers that can be released, ``first`` being the one that is ``due``, or 0.

    ``numbers(feed, seq_id)`` has those that wait, each once, none below the one that is due; ``due(feed, due)`` the state so far. A
    feed's run ends before its first gap. With ``together`` all feeds end where the slowest does: the merged order is by
    number, then by feed.
    """
    first = F.coalesce("due", F.lit(0).cast("bigint"))
    feeds = numbers.select(feed).union(due.select(feed)).distinct().join(due, feed, "left").select(feed, first.alias("first"))
    followed = numbers.select(feed, (F.col("seq_id") - 1).alias("seq_id"))
    run = numbers.join(followed, [feed, "seq_id"], "left_anti").groupBy(feed).agg(F.min("seq_id").alias("run_end"))
    begun = numbers.groupBy(feed).agg(F.min("seq_id").alias("lowest"))
    ends = feeds.join(run, feed, "left").join(begun, feed, "left").select(
        feed, "first", F.when(F.col("lowest") == F.col("first"), F.col("run_end") + 1).otherwise(F.col("first")).alias("end")
    )
    if not together:
        return ends
    slowest = ends.agg(F.min("end")).scalar()
    return ends.withColumn("end", F.greatest("first", F.least("end", slowest)))


def arrived_numbers(batches: DataFrame, start: int = 0) -> DataFrame:
    """``(seq_id, copies, last)`` of the batches from number ``start`` on: a row per number, without any readings."""
    return batches.where(F.col("seq_id") >= start).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("copies"), F.bool_or(F.coalesce("last", F.lit(False))).alias("last")
    )


def released(batches: DataFrame, numbers: DataFrame, first: int, end: int) -> DataFrame:
    """One copy of each batch in ``[first, end)``."""
    inside = (F.col("seq_id") >= first) & (F.col("seq_id") < end)
    return without_repeats(batches.where(inside), numbers.where(inside))


def ingest(batches: DataFrame, start: int = 0, n: int | None = None) -> DataFrame:
    """What both questions take from arrived batches, in a batch job as in a stream.

    The batches that follow on ``start`` without a gap are taken, up to the first one flagged ``last`` and ``n`` of them at
    most, one copy of each. Numbers and flags alone decide, in a table of a row per number; the readings are neither shuffled nor copied
    but where a number has come more than once.
    """
    numbers = written(arrived_numbers(batches, start), "numbers")
    return released(batches, numbers, *release_bounds(numbers, start, n))


def valid_readings(readings: DataFrame) -> DataFrame:
    """Readings with a time and both values; one that lacks any of them (null or NaN) is no reading."""
    value = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return readings.where(F.col("ts_ms").isNotNull() & value("p1") & value("p2"))


def ordered_prefix(
    batches: DataFrame, n: int | None = None, feed: str | None = None, start: int = 0
) -> DataFrame:
    """Batches that can be released in order: start…s have all arrived, up to number ``n``.

    The first gap of a feed is the smallest number whose predecessor is missing,
    found by joining the headers to themselves shifted by one.
    """
    keys = [feed] if feed else []
    headers = batches.where(F.col("seq_id") >= start).select(*keys, "seq_id").distinct()
    successors = headers.withColumn("seq_id", F.col("seq_id") + 1)
    after_gap = headers.where(F.col("seq_id") > start).join(successors, [*keys, "seq_id"], "left_anti")
    first_gap = F.min("seq_id").alias("first_gap")
    started = headers.where(F.col("seq_id") == start)
    if feed:
        started = started.join(after_gap.groupBy(feed).agg(first_gap), feed, "left").drop("seq_id")
        out = batches.join(started, feed)
    else:
        has_start = started.agg(F.count(F.lit(1))).scalar() > 0
        out = batches.where(has_start).withColumn("first_gap", after_gap.agg(first_gap).scalar())
    released = F.col("first_gap").isNull() | (F.col("seq_id") < F.col("first_gap"))
    out = out.where(released & (F.col("seq_id") >= start)).drop("first_gap")
    return out if n is None else out.where(F.col("seq_id") < n)


def flatten_batches(batches: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per valid reading; last year's are moved to this year's time."""

    def side(array: str, period: str) -> DataFrame:
        # "last" positions differ per array; the period keeps them apart
        return batches.select(
            F.col("seq_id").alias("seq"), F.lit(period).alias("period"),
            F.posexplode(array).alias("pos", "m"),
        )

    flat = side("current", CURRENT).unionByName(side("lastyear", LAST_YEAR))
    taken = epoch_ms(F.col("m.timestamp.seconds"), F.col("m.timestamp.nanos"), params.nanos_divisor)
    return valid_readings(flat.select(
        "seq", F.col("pos").cast("bigint").alias("pos"), "period",
        shifted(taken, F.col("period") == LAST_YEAR, params.shift_ms).alias("ts_ms"),
        F.col("m.p1").cast("double").alias("p1"), F.col("m.p2").cast("double").alias("p2"),
        F.col("m.latitude").alias("lat"), F.col("m.longitude").alias("lon"),
    ))


def shifted(ts_ms: Column, is_last_year: Column, shift_ms: int = DEFAULTS.shift_ms) -> Column:
    """Last year's time on this year's axis (a fixed distance, not a calendar year)."""
    return F.when(is_last_year, ts_ms + F.lit(shift_ms).cast("bigint")).otherwise(ts_ms)


def nested_headers(batches: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(seq, wm)`` straight from the arrays: time of the last-positioned reading.

    A batch without readings has no watermark and is kept with NULL.
    """

    def last_ms(array: str) -> Column:
        last = F.try_element_at(array, F.lit(-1))
        return epoch_ms(last["timestamp"]["seconds"], last["timestamp"]["nanos"], params.nanos_divisor)

    shift = F.lit(params.shift_ms).cast("bigint")
    return batches.select(
        F.col("seq_id").alias("seq"),
        F.coalesce(last_ms("current"), last_ms("lastyear") + shift).alias("wm"),
    )


def flat_headers(readings: DataFrame, ts: str = "ts_ms", pos: str = "pos") -> DataFrame:
    """``(seq, wm)`` from flat readings, whose last-year times are already shifted.

    Arrivals serve as well, with the columns of their last-positioned reading.
    """
    is_current = F.col("period") == CURRENT
    return readings.groupBy("seq").agg(
        F.coalesce(
            F.max_by(F.when(is_current, F.col(ts)), F.when(is_current, F.col(pos))),
            F.max_by(ts, pos),
        ).alias("wm")
    )


def watermark_guard(headers: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Drops end-of-data watermarks, which answer no question."""
    return headers.where(F.col("wm") <= params.max_watermark_ms)


def advancing(headers: DataFrame) -> DataFrame:
    """Headers whose watermark does not fall behind an earlier batch's.

    A batch with an older watermark cannot change any answer: its probes are late.
    """
    scanned = with_block_carry(
        headers.where("wm is not null"), [], bucket_of(F.col("seq"), SEQ_BLOCK),
        {"block_max": F.max("wm")},
        {"carry": lambda w: F.max("block_max").over(before(w))},
    )
    inside = before(Window.partitionBy("block").orderBy("seq"))
    earlier = F.greatest("carry", F.max("wm").over(inside))
    return (
        scanned.withColumn("earlier", earlier)
        .where("earlier is null or wm >= earlier")
        .select("seq", "wm")
    )
