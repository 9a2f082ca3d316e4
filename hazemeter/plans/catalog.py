"""Registered queries: one per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazemeter.functions.aqi import agg_aqi, aqi_combined, aqi_pm10, aqi_pm25, is_good
from hazemeter.functions.histogram import bucket_width
from hazemeter.functions.sums import nearest, shown
from hazemeter.functions.timegrid import bucket_of, epoch_ms, ntz_to_epoch_ms, slice_membership, slice_start, utc_time
from hazemeter.operators import batches as b
from hazemeter.operators.geo import locate, point_in_polygon
from hazemeter.operators.improve import interval_join, nested_top
from hazemeter.operators.probes import active_probes, arrivals_of_cells
from hazemeter.operators.slices import slice_cells, slice_densify, slice_sums
from hazemeter.operators.streaks import bucketed_streaks, good_streak
from hazemeter.operators.windows import aqi5d, aqi24_all, aqi24_at_watermark, aqi24_snapshots, sliding_aqi
from hazemeter.params import DAY, DEFAULTS, HOUR, MINUTE
from hazemeter.plans import fixtures as fx
from hazemeter.plans import standing as st
from hazemeter.schema import CURRENT, LAST_YEAR, Q1, Q2
from hazemeter.session import configure, shared_dir, stored_by_differences, written
from hazemeter.sources.tables import archive_batches, load_locations, read_archive, read_results, stream_batches, write_results
from hazemeter.streaming.feeds import released as released_batches_of
from hazemeter.streaming.feeds import run_release
from hazemeter.streaming.job import answers, run_questions
from hazemeter.streaming.joins import expanded, run_interval_join

WIDE = replace(DEFAULTS, active_ms=12 * HOUR, k=20, histogram_origin_ms=fx.T0)
SHIFT = replace(DEFAULTS, shift_ms=fx.SHIFT)
LOCATED = replace(WIDE, shift_ms=fx.SHIFT, active_ms=6 * HOUR)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _timely(spark, sf_dir, wide=False, late=False, odd=False) -> st.Timely:
    readings = fx.readings(spark, sf_dir, wide=wide, late=late, odd=odd)
    return st.timely(readings, params=WIDE if wide else DEFAULTS)


def _probes(spark, sf_dir, wide=False) -> DataFrame:
    readings = fx.readings(spark, sf_dir, wide=wide)
    arrived = written(arrivals_of_cells(slice_cells(readings)), "arrivals")
    headers = written(b.flat_headers(arrived, "last_ts", "last_pos"), "headers")
    return active_probes(arrived, headers, WIDE if wide else DEFAULTS)


def _events(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "events").withColumn("ms", ntz_to_epoch_ms(F.col("ts")))


# --- scalar expressions -------------------------------------------------------


@query
def aqi_pm25_(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", aqi_pm25("value * 2").alias("aqi"))


@query
def aqi_pm10_(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", aqi_pm10("value * 2").alias("aqi"))


@query
def aqi_combined_(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id", aqi_combined("value * 0.5", "value").alias("aqi")
    )


@query
def aqi_good(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").withColumn("aqi", aqi_combined("value * 0.25", "value"))
    return events.select("event_id", is_good(F.col("aqi")).alias("good"))


@query
def slice_align(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", slice_start(F.col("ms"), DEFAULTS.step_ms, fx.T0).alias("slice_start")
    )


@query
def slice_membership_(spark, sf_dir):
    hour = slice_start(F.col("ms"), HOUR)
    side = slice_membership(F.col("ms"), hour + 20 * MINUTE, hour + 40 * MINUTE)
    return _events(spark, sf_dir).select("event_id", side.alias("side"))


@query
def ts_normalize(spark, sf_dir):
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz"))
    wire = fx.table(spark, sf_dir, "events").select(
        "event_id", F.floor(us / 1_000_000).alias("seconds"),
        (F.pmod(us, F.lit(1_000_000)) * 1_000).cast("int").alias("nanos"),
    )
    seconds, nanos = F.col("seconds"), F.col("nanos")
    return wire.select(
        "event_id", epoch_ms(seconds, nanos).alias("ts_ms"),
        epoch_ms(seconds, nanos, 1_000).alias("ts_ms_micros"),
    )


@query
def utc_time_(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", utc_time(F.col("ms")).alias("utc"))


# --- batches ------------------------------------------------------------------


@query
def batch_limit(spark, sf_dir):
    return b.limit_batches(fx.batches(spark, sf_dir), 20).select(
        "seq_id", "last", F.size("current").alias("n_current"), F.size("lastyear").alias("n_lastyear")
    )


@query
def ordered_prefix(spark, sf_dir):
    """Every event type is a feed of hourly batches; an hour without events is a gap."""
    feeds = _events(spark, sf_dir).groupBy(
        F.col("event_type").alias("feed"),
        bucket_of(F.col("ms") - F.lit(fx.T0 - 14 * DAY).cast("bigint"), HOUR).alias("seq_id"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return b.ordered_prefix(feeds, 500, feed="feed").select("feed", "seq_id", "n")


@query
def flatten_batches(spark, sf_dir):
    return b.flatten_batches(fx.batches(spark, sf_dir), SHIFT).drop("lat", "lon")


@query
def period_shift(spark, sf_dir):
    last_year = F.col("ms") < fx.T0
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("pos"), F.when(last_year, LAST_YEAR).otherwise(CURRENT).alias("period"),
        b.shifted(F.col("ms"), last_year, fx.SHIFT).alias("ts_ms"),
    )


@query
def period_split(spark, sf_dir):
    readings = fx.readings(spark, sf_dir)

    def half(period):
        return readings.where(F.col("period") == period).groupBy("period", "seq").agg(
            F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")
        )

    return half(CURRENT).unionByName(half(LAST_YEAR))


@query
def batch_watermark(spark, sf_dir):
    """From the arrays, and from the flat readings made of them."""
    batches = fx.batches(spark, sf_dir)
    flat = b.flat_headers(b.flatten_batches(batches, SHIFT)).withColumnRenamed("wm", "flat_wm")
    return b.nested_headers(batches, SHIFT).join(flat, "seq")


@query
def watermark_guard(spark, sf_dir):
    params = replace(DEFAULTS, max_watermark_ms=fx.T0 + 7 * DAY)
    return b.watermark_guard(b.flat_headers(fx.readings(spark, sf_dir)), params)


@query
def active_probes_(spark, sf_dir):
    return _probes(spark, sf_dir)


@query
def active_probes_wide(spark, sf_dir):
    return _probes(spark, sf_dir, wide=True)


@query
def late_drop(spark, sf_dir):
    return _timely(spark, sf_dir, late=True).readings.select("city", "period", "seq", "pos", "ts_ms")


@query
def late_slice_sums(spark, sf_dir):
    """Slices behind the late bounds, where some are cut by one."""
    return _slice_values(_timely(spark, sf_dir, late=True).slices)


# --- joins --------------------------------------------------------------------


@query
def point_in_polygon_(spark, sf_dir):
    return point_in_polygon(fx.readings(spark, sf_dir), fx.locations(spark, sf_dir))


@query
def city_lookup_distinct(spark, sf_dir):
    return locate(fx.readings(spark, sf_dir), fx.locations(spark, sf_dir)).select("pos", "city")


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("period") == CURRENT), df.where(F.col("period") == LAST_YEAR)


@query
def interval_join_exact(spark, sf_dir):
    slices = slice_sums(fx.readings(spark, sf_dir)).withColumnRenamed("slice_end", "ts_ms")
    return interval_join(*_halves(slices), ["city"], 0, 0).select("city", "ts_ms", "n", "r_n")


@query
def interval_join_range(spark, sf_dir):
    """The result grows with the square of the readings of a city; ``apart`` takes most of it and is stored by its differences."""
    timed = fx.readings(stored_by_differences(spark), sf_dir).select("city", "period", "pos", "ts_ms")
    return interval_join(
        *(half.drop("period") for half in _halves(timed)), ["city"], -10 * MINUTE, 25 * MINUTE, rows=timed.count(),
        select=lambda cur, last: [
            cur("city").alias("city"), cur("pos").alias("pos"), last("pos").alias("r_pos"),
            (last("ts_ms") - cur("ts_ms")).alias("apart"),
        ],
    )


@query
def interval_join_streamed(spark, sf_dir):
    """The range join of two streams, in four parts by time, ended and started again after each."""
    root = f"{shared_dir(spark)}/joined-{uuid.uuid4().hex}"
    timed = fx.readings(spark, sf_dir).select("city", "period", "pos", "ts_ms").withColumn("at", F.timestamp_millis("ts_ms"))
    timed = written(timed, "timed")
    low, high = timed.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    part = F.floor((F.col("ts_ms") - low) * 4 / (high - low + 1))
    for i in range(4):
        sides = []
        for period in (CURRENT, LAST_YEAR):
            folder = f"{root}/{period}"
            timed.where((part == i) & (F.col("period") == period)).drop("period").write.mode("append").parquet(folder)
            sides.append(spark.readStream.schema(timed.drop("period").schema).parquet(folder))
        run_interval_join(*sides, ["city"], -10 * MINUTE, 25 * MINUTE, root, packed=True).awaitTermination()
    pairs = expanded(spark.read.parquet(f"{root}/packed"), ["city"], -10 * MINUTE, 25 * MINUTE)
    return pairs.select("city", "pos", "r_pos", (F.col("r_ts_ms") - F.col("ts_ms")).alias("apart"))


# --- slices and windows -------------------------------------------------------


def _slice_values(slices: DataFrame) -> DataFrame:
    return slices.select(
        "city", "period", "slice_end", shown(nearest(1), "i1").alias("sum_p1"), shown(nearest(2), "i2").alias("sum_p2"), "n"
    )


@query
def slice_sums_(spark, sf_dir):
    """Among readings of any size."""
    return _slice_values(slice_sums(fx.readings(spark, sf_dir, odd=True)))


@query
def aqi24_snapshots_odd(spark, sf_dir):
    """Infinite readings enter windows and leave them again."""
    return aqi24_snapshots(slice_sums(fx.readings(spark, sf_dir, odd=True)))


@query
def aqi24_at_watermark_odd(spark, sf_dir):
    return _timely(spark, sf_dir, odd=True).at_watermark()


@query
def avg_aqi_odd(spark, sf_dir):
    return fx.readings(spark, sf_dir, odd=True).groupBy("city", "period").agg(agg_aqi("p1", "p2").alias("aqi"))


@query
def slice_densify_(spark, sf_dir):
    slices = written(slice_sums(fx.readings(spark, sf_dir)), "slices")
    return slice_densify(slices).select("city", "period", "slice_end", "n", shown(nearest(1), "i1").alias("sum_p1"))


@query
def avg_aqi_by_city(spark, sf_dir):
    return fx.readings(spark, sf_dir).groupBy("city", "period").agg(agg_aqi("p1", "p2").alias("aqi"))


@query
def aqi24_snapshots_(spark, sf_dir):
    return aqi24_snapshots(slice_sums(fx.readings(spark, sf_dir)))


@query
def aqi24_custom_window(spark, sf_dir):
    return sliding_aqi(fx.readings(spark, sf_dir), 6 * HOUR, 15 * MINUTE, MINUTE)


@query
def aqi24_at_watermark_(spark, sf_dir):
    return _timely(spark, sf_dir).at_watermark()


@query
def aqi24_at_watermark_wide(spark, sf_dir):
    return _timely(spark, sf_dir, wide=True).at_watermark()


@query
def aqi24_no_history(spark, sf_dir):
    """Probes of all cities, answered from purchase events only."""
    probes = written(_probes(spark, sf_dir), "probes")
    bought = fx.events_of_type(spark, sf_dir, "purchase")
    return aqi24_at_watermark(bought, written(slice_sums(bought), "slices"), probes)


@query
def aqi24_all_(spark, sf_dir):
    base = _timely(spark, sf_dir)
    return aqi24_all(aqi24_snapshots(base.slices), base.at_watermark())


@query
def aqi5d_(spark, sf_dir):
    base = _timely(spark, sf_dir, wide=True)
    at_watermark = written(base.at_watermark(), "at-watermark")
    return aqi5d(aqi24_snapshots(base.slices), at_watermark, base.params)


@query
def aqi5d_cold_start(spark, sf_dir):
    """Means of cities as they come and go, and whether there was one or the watermark value stood in."""
    base = _timely(spark, sf_dir, wide=True)
    at_watermark = written(base.at_watermark(), "at-watermark")
    return aqi5d(aqi24_snapshots(base.slices), at_watermark, base.params, origin=True)


# --- improvement ranking ------------------------------------------------------


@query
def aqi_improvement(spark, sf_dir):
    return st.improvements(_timely(spark, sf_dir, wide=True))


@query
def q1_top50(spark, sf_dir):
    return st.q1(_timely(spark, sf_dir))


@query
def q1_topk_wide(spark, sf_dir):
    return st.q1(_timely(spark, sf_dir, wide=True))


@query
def q1_results_nested(spark, sf_dir):
    base = _timely(spark, sf_dir, wide=True)
    return nested_top(base.headers, written(st.q1(base), "q1"))


@query
def q1_results_json(spark, sf_dir):
    """The nested results as text."""
    base = _timely(spark, sf_dir, wide=True)
    nested = nested_top(base.headers, written(st.q1(base), "q1"))
    return nested.select("batch_seq_id", F.to_json("topkimproved").alias("topkimproved"))


@query
def q1_results_flat(spark, sf_dir):
    """A row of nulls for batches without any improved city."""
    return st.q1_results(_timely(spark, sf_dir, wide=True))


def _located(spark, sf_dir) -> st.Timely:
    """From nested batches, with cities from geometry."""
    places = written(fx.locations(spark, sf_dir), "locations")
    return st.timely_batches(written(fx.batches(spark, sf_dir), "batches"), places, LOCATED)


@query
def q1_located(spark, sf_dir):
    return st.q1(_located(spark, sf_dir))


# --- streaks ------------------------------------------------------------------


@query
def good_streak_(spark, sf_dir):
    base = _timely(spark, sf_dir)
    values = aqi24_all(aqi24_snapshots(base.slices), base.at_watermark()).where(F.col("period") == CURRENT)
    return good_streak(written(values, "values")).select("city", "ts_ms", "is_probe", "good_since")


@query
def streak_at_watermark(spark, sf_dir):
    return st.current_streaks(_timely(spark, sf_dir, wide=True))


@query
def streak_bucket(spark, sf_dir):
    return bucketed_streaks(st.current_streaks(_timely(spark, sf_dir, wide=True)), WIDE)


@query
def bucket_width_(spark, sf_dir):
    return b.flat_headers(fx.readings(spark, sf_dir)).select(
        "seq", "wm", bucket_width(F.col("wm"), WIDE).alias("width"), bucket_width(F.col("wm")).alias("full_width")
    )


@query
def q2_histogram(spark, sf_dir):
    return st.q2(_timely(spark, sf_dir))


@query
def q2_histogram_wide(spark, sf_dir):
    return st.q2(_timely(spark, sf_dir, wide=True))


@query
def q2_located(spark, sf_dir):
    return st.q2(_located(spark, sf_dir))


def _as_answers(ranking: DataFrame, histogram: DataFrame) -> DataFrame:
    return ranking.select(
        F.lit("q1").alias("question"), "batch_seq_id", "city", F.col("position").alias("a"),
        F.col("avg_improvement").alias("b"), F.col("current_p1").alias("c"), F.col("current_p2").alias("d"),
    ).unionByName(histogram.select(
        F.lit("q2").alias("question"), "batch_seq_id", F.lit(None).cast("string").alias("city"),
        F.col("bucket_from").alias("a"), F.col("bucket_to").alias("b"), F.col("bucket_percent").alias("c"),
        F.lit(None).cast("int").alias("d"),
    ))


@query
def results_sink(spark, sf_dir):
    """Both questions' results written in several calls, some batches twice, and read back."""
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    tables = [written(t, "results") for t in st.both(_timely(spark, sf_dir, wide=True))]
    for part in (0, 1, 2, 1):
        for name, rows in zip(("q1", "q2"), tables):
            some = rows.where(F.pmod("batch_seq_id", F.lit(3)) == part)
            if part == 2:  # what is written first is wrong, or of batches that turn out empty
                write_results(some.withColumns({c: F.lit(7).cast(t) for c, t in some.dtypes if t == "int"}), f"{root}/{name}", versions=3)
            write_results(some, f"{root}/{name}", versions=3)
    return _as_answers(*(read_results(spark, f"{root}/{name}", t) for name, t in (("q1", Q1), ("q2", Q2))))


@query
def archive_replay(spark, sf_dir):
    """Batches archived in two calls, replayed from number 10 on."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    batches = written(fx.batches(spark, sf_dir), "batches")
    for part in (0, 1):
        archive_batches(batches.where(F.pmod("seq_id", F.lit(2)) == part), path)
    return read_archive(spark, path, 10).select(
        "seq_id", "last", F.size("current").alias("n_current"), F.size("lastyear").alias("n_lastyear")
    )


@query
def locations_cached(spark, sf_dir):
    """Locations built on first use, then loaded from where they were stored."""
    path = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    load_locations(spark, path, lambda: fx.locations(spark, sf_dir))
    return load_locations(spark, path).select(
        "zipcode", "city", F.size("polygons").alias("n_rings"), F.size(F.col("polygons")[0]["points"]).alias("n_points")
    )


@query
def released_batches(spark, sf_dir):
    """What is taken of batches that come twice, with readings without a value, one missing or one flagged last."""
    top = F.col("top")
    batches = fx.batches(spark, sf_dir)
    batches = written(batches.withColumn("top", batches.agg(F.max("seq_id")).scalar()), "batches")
    blank = F.transform("current", lambda m, i: F.when(i % 10 == 0, m.withField("p1", F.lit(None).cast("float"))).otherwise(m))
    some = batches.withColumn("current", F.when(F.col("seq_id") % 5 == 0, blank).otherwise(F.col("current")))
    twice = some.unionByName(some.where("seq_id % 3 = 0"))
    number = F.col("seq_id")
    cases = {
        "gap": twice.where(number != F.floor(top * 3 / 4)).withColumn("last", F.lit(False)),
        "last": twice.withColumn("last", number == F.floor(top / 2)),
        "cap": twice,
    }
    taken = [
        b.flatten_batches(b.ingest(case.drop("top"), n=7 if name == "cap" else None), SHIFT)
        .groupBy(F.lit(name).alias("rule"), "seq", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))
        for name, case in cases.items()
    ]
    return reduce(DataFrame.unionByName, taken)


@query
def streamed_answers(spark, sf_dir):
    """Both questions from a stream that is stopped and restarted half way; one batch of the second half comes early."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    places = written(fx.locations(spark, sf_dir), "locations")
    batches = written(fx.batches(spark, sf_dir), "batches")
    half = batches.agg(F.max("seq_id")).first()[0] // 2
    early = F.col("seq_id") == half + 2
    for part in ((F.col("seq_id") <= half) | early, (F.col("seq_id") > half) & ~early):
        batches.where(part).repartition(6).write.mode("append").parquet(f"{root}/in")
        arriving = stream_batches(spark, f"{root}/in", files_per_trigger=4)
        run_questions(arriving, places, f"{root}/out", LOCATED).awaitTermination()
    return _as_answers(*answers(spark, f"{root}/out"))


@query
def released_feeds(spark, sf_dir):
    """Two feeds of batches that arrive in three parts, the second with a gap until the last; on their own and together."""
    root = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    size = lambda c: F.size(c).cast("long").alias(c)
    each = fx.batches(spark, sf_dir).select("seq_id", size("current"), size("lastyear"))
    both = written(each.withColumn("feed", F.explode(F.array(F.lit("a"), F.lit("b")))), "feeds")
    top = both.agg(F.max("seq_id")).first()[0]
    number, second = F.col("seq_id"), F.col("feed") == "b"
    gap, missing = second & (number == top // 3), second & (number == top - 1)
    parts = [(number <= top // 2) & ~gap, (number > top // 2) & ~missing, gap]
    out = []
    for i, part in enumerate(parts):
        both.where(part).repartition(2).write.mode("append").parquet(f"{root}/in")
        for together in (False, True):
            arriving = spark.readStream.schema(both.schema).parquet(f"{root}/in")
            run_release(arriving, f"{root}/{together}", together=together).awaitTermination()
            if i != 1:
                found = released_batches_of(spark, f"{root}/{together}", both.schema)
                out.append(written(found.drop("epoch").withColumns({"together": F.lit(together), "part": F.lit(i)}), "released"))
    return reduce(DataFrame.unionByName, out)


@query
def state_kept(spark, sf_dir):
    """Readings a stream still holds after its last batch, which comes alone: those of days its watermarks can reach."""
    root = f"{shared_dir(spark)}/expiring-{uuid.uuid4().hex}"
    places = written(fx.locations(spark, sf_dir), "locations")
    batches = written(fx.batches(spark, sf_dir), "batches")
    top = batches.agg(F.max("seq_id")).first()[0]
    for part in (F.col("seq_id") < top, F.col("seq_id") == top):
        batches.where(part).repartition(3).write.mode("append").parquet(f"{root}/in")
        arriving = stream_batches(spark, f"{root}/in", files_per_trigger=3)
        run_questions(arriving, places, f"{root}/out", LOCATED).awaitTermination()
    kept = spark.read.parquet(f"{root}/out/readings")
    return kept.groupBy("city", "period", F.col("day").cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    """Query name → ``(spark, sf_dir) -> DataFrame``."""
    return {name.rstrip("_"): run for name, run in QUERIES.items()}
