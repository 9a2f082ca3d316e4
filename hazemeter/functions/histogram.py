"""Buckets of the good-air streak histogram."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazemeter.functions.aqi import f32, round_half_up
from hazemeter.params import DEFAULTS, Params


def bucket_width(wm: Column, params: Params = DEFAULTS) -> Column:
    """Bucket width in ms: grows with the time since the origin until the cap is covered."""
    since = F.greatest(wm - F.lit(params.histogram_origin_ms).cast("bigint"), F.lit(0).cast("bigint"))
    full = params.streak_cap_ms // params.buckets
    return F.least(F.floor(since / F.lit(params.buckets)), F.lit(full).cast("bigint")).cast("int")


def streak_bucket(wm: Column, good_since: Column, width: Column, params: Params = DEFAULTS) -> Column:
    """Bucket of a streak; no streak or no width yet → 0.

    A streak at the cap falls into the last bucket, or one past it with
    ``legacy_overflow``.
    """
    streak = F.least(wm - good_since, F.lit(params.streak_cap_ms).cast("bigint"))
    bucket = F.floor(streak / F.nullif(width, F.lit(0)))
    if not params.legacy_overflow:
        bucket = F.least(bucket, F.lit(params.buckets - 1).cast("bigint"))
    has_both = good_since.isNotNull() & (width > 0)
    return F.when(has_both, bucket).otherwise(F.lit(0).cast("bigint")).cast("int")


def per_mille(part: Column, total: Column) -> Column:
    """Share in thousandths, single precision, half up."""
    share = f32(part.cast("float") / F.nullif(total, F.lit(0)).cast("float"))
    return round_half_up(share * f32(1000)).cast("int")
