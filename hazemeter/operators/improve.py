"""Joining the two years and ranking the cities that improved most."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.functions.aqi import milli
from hazemeter.functions.timegrid import bucket_of
from hazemeter.params import DEFAULTS
from hazemeter.schema import CURRENT, LAST_YEAR

#: Rows of a key and bucket that meet others together, at most.
CHUNK = 512
#: A chunk of the left side has so many times fewer: the shorter it is in time, the more of its rows meet a right chunk whole.
FEWER = 8
#: Rows of both sides that a task joins, about, where their number is known; more of them are more tasks.
TASK_ROWS = 20_000


def _chunks(side: DataFrame, keys: Sequence[str], ts: str, name: str, rows: int | None, chunk: int) -> DataFrame:
    """``(keys, first, last, times)``: up to ``chunk`` rows that follow each other in time, the last of ``keys`` being their bucket.

    ``times`` has every time and its rows, in order. A task holds one chunk and not a key.
    """
    tasks = -(-(rows or 0) // TASK_ROWS)
    many = tasks > side.sparkSession.sparkContext.defaultParallelism
    row = F.struct(*[c for c in side.columns if c != keys[-1]])
    known = side.where(" and ".join(f"`{c}` is not null" for c in (*keys, ts)))
    dealt = known.repartition(*([tasks] if many else []), *keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    at_once = (
        dealt.select(*keys, F.floor(number / chunk).alias("chunk"), F.col(ts).alias("at"), row.alias("row"))
        .groupBy(*keys, "chunk", "at").agg(F.collect_list("row").alias("rows"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("at", "rows")), lambda a, b: F.signum(a["at"] - b["at"]).cast("int"))
    return at_once.groupBy(*keys, "chunk").agg(
        F.min("at").alias(f"{name}_first"), F.max("at").alias(f"{name}_last"), in_order.alias(f"{name}_times")
    ).drop("chunk")


def _met(left: DataFrame, right: DataFrame, keys: list[Column], lo_ms: int, hi_ms: int) -> DataFrame:
    """Pairs of the rows in chunks, those of the same two times side by side."""
    near = [F.col("right_last") >= F.col("left_first") + lo_ms, F.col("right_first") <= F.col("left_last") + hi_ms]
    out = left.join(right, [*keys, *near]).select("left_times", "right_times")
    out = out.select(F.explode("left_times").alias("l"), "right_times").select("l", F.explode("right_times").alias("r"))
    out = out.where(F.col("r.at").between(F.col("l.at") + lo_ms, F.col("l.at") + hi_ms))
    out = out.select(F.inline("l.rows"), F.col("r.rows").alias("r"))
    return out.select(*out.columns[:-1], F.inline("r"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    lo_ms: int,
    hi_ms: int,
    ts: str = "ts_ms",
    event_time: str | None = None,
    select: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Column]] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` and ``right.ts`` in ``[left.ts + lo_ms, left.ts + hi_ms]``.

    A zero interval is an equi-join on the time. Otherwise time is cut into
    buckets as wide as the interval: a left row meets the one or two buckets its
    interval touches, a right row has exactly one, so no pair is found twice and a
    hot key is spread over time. ``select`` receives two column getters and
    returns the projection; by default right columns get the prefix ``r_``.

    There can be far more pairs than rows. So rows at rest meet in chunks, by time, and pairs come out with those of one left
    row and of the same two times side by side, which stores in fewer bytes; with ``rows``, the number of both
    sides, tasks follow from it and not from the bytes shuffled.

    On two streams, ``event_time`` names a TIMESTAMP column of the same times that
    carries a watermark on both sides; Spark then drops rows no partner can reach.
    """
    if hi_ms < lo_ms:
        raise ValueError("empty interval")
    l_names, r_names = left.columns, right.columns
    left = left.select([F.col(c).alias(f"l_{c}") for c in l_names])
    right = right.select([F.col(c).alias(f"r_{c}") for c in r_names])
    l_ts, r_ts = F.col(f"l_{ts}"), F.col(f"r_{ts}")
    keys = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in on]
    if event_time:
        start = f"l_{event_time} + interval {lo_ms} milliseconds"
        end = f"l_{event_time} + interval {hi_ms} milliseconds"
        keys.append(F.expr(f"r_{event_time} >= {start} and r_{event_time} <= {end}"))
    if lo_ms == hi_ms:
        pairs = left.join(right, [*keys, l_ts + lo_ms == r_ts])
    else:
        width = hi_ms - lo_ms
        from_bucket, to_bucket = bucket_of(l_ts + lo_ms, width), bucket_of(l_ts + hi_ms, width)
        left = left.withColumn("l_bucket", F.explode(F.sequence(from_bucket, to_bucket)))
        right = right.withColumn("r_bucket", bucket_of(r_ts, width))
        keys.append(F.col("l_bucket") == F.col("r_bucket"))
        if event_time or left.isStreaming or right.isStreaming:
            pairs = left.join(right, [*keys, r_ts.between(l_ts + lo_ms, l_ts + hi_ms)])
        else:
            l_chunks = _chunks(left, [*(f"l_{c}" for c in on), "l_bucket"], f"l_{ts}", "left", rows, -(-CHUNK // FEWER))
            r_chunks = _chunks(right, [*(f"r_{c}" for c in on), "r_bucket"], f"r_{ts}", "right", rows, CHUNK)
            pairs = _met(l_chunks, r_chunks, keys, lo_ms, hi_ms)
    if select is None:
        kept = [F.col(f"l_{c}").alias(c) for c in l_names]
        return pairs.select(*kept, *[F.col(f"r_{c}") for c in r_names if c not in on])
    return pairs.select(*select(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))


def improvement_of(current: Column, last_year: Column) -> Column:
    """How far the index fell; -1 if either side has no data."""
    missing = F.least(current, last_year) < 0
    return F.when(missing, F.lit(-1.0)).otherwise(last_year - current)


def aqi_improvement(means: DataFrame) -> DataFrame:
    """``(seq, city, ts_ms, improvement, aqi_p1, aqi_p2)`` where both years have a mean.

    The batch number is part of the key, so that two batches with one watermark
    do not answer for each other.
    """
    return interval_join(
        means.where(F.col("period") == CURRENT),
        means.where(F.col("period") == LAST_YEAR),
        ["city", "seq"], 0, 0,
        select=lambda cur, last: [
            cur("seq").alias("seq"), cur("city").alias("city"), cur("ts_ms").alias("ts_ms"),
            improvement_of(cur("aqi"), last("aqi")).alias("improvement"),
            cur("aqi_p1").alias("aqi_p1"), cur("aqi_p2").alias("aqi_p2"),
        ],
    )


def top_improvements(improvements: DataFrame, k: int = DEFAULTS.k) -> DataFrame:
    """The ``k`` most improved cities of each batch, in thousandths; ties by city name."""
    order = Window.partitionBy("seq").orderBy(F.desc("improvement"), "city")
    return (
        improvements.where("improvement >= 0")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select(
            F.col("seq").alias("batch_seq_id"), "position", "city",
            milli(F.col("improvement")).alias("avg_improvement"),
            milli(F.col("aqi_p1")).alias("current_p1"), milli(F.col("aqi_p2")).alias("current_p2"),
        )
    )


def for_every_batch(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Result ``rows`` with one more for every batch of ``headers`` that has none: its number, and nulls."""
    return headers.select(F.col("seq").alias("batch_seq_id")).distinct().join(rows, "batch_seq_id", "left")


def nested_top(headers: DataFrame, top: DataFrame) -> DataFrame:
    """One row per batch, with an empty list where no city improved.

    A list never holds more than the ranking's ``k`` entries.
    """
    entry = F.struct("position", "city", "avg_improvement", "current_p1", "current_p2")
    lists = top.groupBy("batch_seq_id").agg(F.sort_array(F.collect_list(entry)).alias("topkimproved"))
    empty = F.array().cast(lists.schema["topkimproved"].dataType)
    return (
        headers.select(F.col("seq").alias("batch_seq_id"))
        .join(lists, "batch_seq_id", "left")
        .withColumn("topkimproved", F.coalesce("topkimproved", empty))
    )
