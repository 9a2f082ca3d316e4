"""Epoch-millisecond time and the slice grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazemeter.params import DEFAULTS


def epoch_ms(seconds: Column, nanos: Column, nanos_divisor: int = DEFAULTS.nanos_divisor) -> Column:
    """Seconds + nanos as whole milliseconds."""
    return seconds * F.lit(1000).cast("bigint") + F.floor(nanos.cast("bigint") / F.lit(nanos_divisor))


def utc_time(ts_ms: Column) -> Column:
    """UTC wall-clock time, whatever the session time zone."""
    return F.timestamp_add("MILLISECOND", ts_ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ntz_to_epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(1000))


def slice_start(ts_ms: Column, step: int = DEFAULTS.step_ms, origin: int = DEFAULTS.origin_ms) -> Column:
    """Start of the grid slice holding ``ts_ms``, also for times before the origin."""
    return ts_ms - F.pmod(ts_ms - F.lit(origin).cast("bigint"), F.lit(step).cast("bigint"))


def slice_membership(ts_ms: Column, start: Column, end: Column) -> Column:
    """-1 before, 0 inside, 1 at or after the end of ``[start, end)``."""
    return F.when(ts_ms < start, -1).when(ts_ms < end, 0).otherwise(1)


def bucket_of(value: Column, width: int) -> Column:
    """Floor division of a BIGINT, exact and also right below zero."""
    width_col = F.lit(width).cast("bigint")
    return F.floor((value - F.pmod(value, width_col)) / width_col)
