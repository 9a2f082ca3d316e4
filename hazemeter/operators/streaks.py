"""How long a city's air has been good, and the histogram over all cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.functions.aqi import is_good
from hazemeter.functions.histogram import bucket_width, per_mille, streak_bucket
from hazemeter.operators.scan import so_far_with_ties
from hazemeter.params import DEFAULTS, Params

KEY = ["city", "period"]
#: Stands for the time of a value that is not known yet.
OPEN = (1 << 63) - 1


def good_streak(values: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``good_since``: start of the run of good values, NULL at a bad one.

    A run starts at the value that follows the latest bad one, or at the city's first; silence does not end it. So one running
    aggregate is enough: the latest bad value with the time of the one that follows it. A city has as many rows here as where its
    values were made: one per slice and batch at most.
    """
    inside = Window.partitionBy(*KEY).orderBy("ts_ms")
    good = is_good(F.col("aqi"), params.good_max)
    ended = F.struct(F.col("ts_ms").alias("at"), F.coalesce("following", F.lit(OPEN)).alias("next"))
    known = values.withColumns({"good": good, "following": F.lead("ts_ms").over(inside)}).withColumn("bad", F.when(~F.col("good"), ended))
    # values at one time are alike, and all of them see what any of them ends
    seen = known.withColumns({"latest": F.max("bad").over(so_far_with_ties(inside)), "first": F.min("ts_ms").over(so_far_with_ties(inside))})
    since = F.coalesce(F.col("latest.next"), F.col("first"))
    return seen.withColumn("good_since", F.when(F.col("good"), since)).drop("good", "following", "bad", "latest", "first")


def streak_at_watermark(values: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(seq, city, ts_last, good_since)`` at every watermark value of one period."""
    return good_streak(values, params).where("is_probe").select(
        "seq", "city", F.col("ts_ms").alias("ts_last"), "good_since"
    )


def bucketed_streaks(streaks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds the histogram's ``width`` at the row's watermark and the ``bucket``."""
    wm = F.col("ts_last")
    return streaks.withColumn("width", bucket_width(wm, params)).withColumn(
        "bucket", streak_bucket(wm, F.col("good_since"), F.col("width"), params)
    )


def streak_histogram(headers: DataFrame, streaks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(batch_seq_id, bucket_from, bucket_to, bucket_percent)``: every bucket of every batch.

    One aggregate row per batch holds all bucket counts, so the counting combines
    before the shuffle; batches without an active city get zeros, those without a watermark have no buckets.
    """
    buckets = range(params.buckets)
    counts = bucketed_streaks(streaks, params).groupBy("seq").agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(F.col("bucket") == i) for i in buckets]).alias("counts"),
    )
    nothing = F.array(*[F.lit(0).cast("bigint") for _ in buckets])
    width = F.col("width")
    return (
        headers.where("wm is not null").join(counts, "seq", "left")
        .select(
            F.col("seq").alias("batch_seq_id"), bucket_width(F.col("wm"), params).alias("width"),
            F.coalesce("total", F.lit(0)).alias("total"),
            F.posexplode(F.coalesce("counts", nothing)).alias("i", "n"),
        )
        .select(
            "batch_seq_id",
            (F.col("i") * width).alias("bucket_from"), ((F.col("i") + 1) * width).alias("bucket_to"),
            F.coalesce(per_mille(F.col("n"), F.col("total")), F.lit(0)).alias("bucket_percent"),
        )
    )
