"""Both standing questions in Structured Streaming, with tables as state.

Every micro-batch runs the batch operators on what it brings plus a look back that
does not grow: one row per city and period, slice sums of the last window + mean, and
readings of the last window. All of that is partitioned tables, so a hot city is
spread over tasks exactly as in a batch run, and no state lives in one worker.

A micro-batch reads the state its predecessor left and writes only folders of its
own epoch: repeating it after a failure gives the same state and results. It removes
state that neither it nor a later one can read, and its own intermediate tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazemeter.functions.sums import DDL, added
from hazemeter.functions.timegrid import bucket_of, slice_start
from hazemeter.operators.batches import (
    arrived_numbers, flatten_batches, nested_headers, release_bounds, released, watermark_guard,
)
from hazemeter.operators.geo import point_in_polygon, with_city
from hazemeter.operators.improve import aqi_improvement, for_every_batch, top_improvements
from hazemeter.operators.probes import active_probes, arrivals, drop_late, late_bounds
from hazemeter.operators.slices import slice_sums
from hazemeter.operators.streaks import good_streak, streak_histogram
from hazemeter.operators.windows import aqi5d, aqi24_all, aqi24_at_watermark, aqi24_snapshots
from hazemeter.params import DAY, DEFAULTS, Params
from hazemeter.schema import BATCH, CURRENT, Q1, Q2
from hazemeter.session import configure, counted, folders, remove, temporary_tables, written
from hazemeter.sources.tables import read_results, write_epoch, write_results

KEY = ["city", "period"]
TABLES = {
    "cities": (
        "city STRING, period STRING, max_ts BIGINT, last_wm BIGINT, origin BIGINT, "
        "good_since BIGINT, done BIGINT, epoch BIGINT"
    ),
    "slices": (
        f"city STRING, period STRING, slice_end BIGINT, {DDL}, day BIGINT, epoch BIGINT"
    ),
    "readings": (
        "seq BIGINT, pos BIGINT, city STRING, period STRING, ts_ms BIGINT, p1 DOUBLE, p2 DOUBLE, "
        "day BIGINT, epoch BIGINT"
    ),
    "held": f"{BATCH}, epoch BIGINT",
    "run": "max_wm BIGINT, last_seq BIGINT, cities_epoch BIGINT, ended BOOLEAN, epoch BIGINT",
}


@dataclass(frozen=True)
class Stores:
    """Folders of the state and result tables below one root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, spark: SparkSession) -> None:
        """Empty state tables, where there are none yet."""
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(self.path(name))

    def expire(self, spark: SparkSession, name: str, key: str, low: int) -> None:
        """Removes folders of a table whose ``key`` is below ``low``."""
        for folder in folders(spark, self.path(name)):
            at = folder.removeprefix(f"{key}=")
            if at != folder and at.lstrip("-").isdigit() and int(at) < low:
                remove(spark, f"{self.path(name)}/{folder}")


def _day(column: str):
    return bucket_of(F.col(column), DAY)


def _from_day(table: DataFrame, low_ms: int, column: str, epoch: int) -> DataFrame:
    """Rows at or after ``low_ms`` from this and earlier micro-batches."""
    recent = table.where((F.col("day") >= low_ms // DAY) & (F.col("epoch") <= epoch))
    return recent.where(F.col(column) >= low_ms).drop("day", "epoch")


def answer_epoch(
    arrived_batches: DataFrame, epoch: int, locations: DataFrame, stores: Stores, params: Params = DEFAULTS
) -> None:
    """Answers both questions for the batches a micro-batch makes releasable.

    Batches are taken in the order of their numbers; those ahead of a missing one
    are held for a later micro-batch, repeated ones are ignored, and so are those after one flagged ``last``.
    """
    spark = configure(arrived_batches.sparkSession)
    with temporary_tables(spark):
        _epoch(spark, arrived_batches, epoch, locations, stores, params)


def _epoch(
    spark: SparkSession, arrived_batches: DataFrame, epoch: int, locations: DataFrame, stores: Stores, params: Params
) -> None:
    before = (
        stores.read(spark, "run").where(F.col("epoch") < epoch)
        .agg(*[F.max_by(c, "epoch") for c in ("max_wm", "last_seq", "cities_epoch", "ended", "epoch")]).first()
    )
    low_wm, last_seq, cities_epoch, ended, last_epoch = before
    due_seq = 0 if last_seq is None else last_seq + 1
    if last_epoch is not None:
        for name, oldest in (("run", last_epoch), ("cities", cities_epoch)):
            stores.expire(spark, name, "epoch", last_epoch if oldest is None else oldest)
    if low_wm is not None:
        stores.expire(spark, "readings", "day", _log_low(low_wm, params) // DAY)
        stores.expire(spark, "slices", "day", _slices_low(low_wm, params) // DAY)

    waiting = _held(spark, stores, due_seq, epoch)
    due = (F.col("seq_id") >= due_seq) & F.lit(not ended)
    inbox = arrived_batches.unionByName(waiting.drop("epoch")).where(due)
    numbers = written(arrived_numbers(inbox, due_seq), "numbers")
    first, end = release_bounds(numbers, due_seq)
    early = arrived_batches.where(due & (F.col("seq_id") >= end))
    write_epoch(early.select("seq_id", "last", "current", "lastyear"), stores.path("held"), epoch)

    progress = (low_wm, last_seq, cities_epoch, bool(ended))
    if end > first:
        batches = released(inbox, numbers, first, end)
        every = written(nested_headers(batches, params), "headers")
        headers = watermark_guard(every, params)
        ahead = headers if low_wm is None else headers.where(F.col("wm") >= low_wm)
        min_wm, max_wm = ahead.agg(F.min("wm"), F.max("wm")).first()
        _answer(
            batches, every, ahead, min_wm, max_wm, low_wm, due_seq - 1, cities_epoch, epoch, locations, stores, params
        )
        flagged = numbers.where((F.col("seq_id") < end) & F.col("last")).limit(1).count()
        progress = (low_wm if max_wm is None else max_wm, end - 1, epoch, bool(flagged))
    schema = "max_wm BIGINT, last_seq BIGINT, cities_epoch BIGINT, ended BOOLEAN"
    write_epoch(spark.createDataFrame([progress], schema), stores.path("run"), epoch)


def _held(spark: SparkSession, stores: Stores, due_seq: int, epoch: int) -> DataFrame:
    """Batches that came ahead of a missing one, where the micro-batch they came with has put them.

    They are written once and stay there; what is looked at until they are released is their numbers. A folder goes
    when none of its numbers is waiting any more.
    """
    held = stores.read(spark, "held").where(F.col("epoch") < epoch)
    waiting = {r[0] for r in held.where(F.col("seq_id") >= due_seq).select("epoch").distinct().collect()}  # a row per folder
    for folder in folders(spark, stores.path("held")):
        at = folder.removeprefix("epoch=")
        if at.isdigit() and int(at) < epoch and int(at) not in waiting:
            remove(spark, f"{stores.path('held')}/{folder}")
    return stores.read(spark, "held").where(F.col("epoch").isin(sorted(waiting)))


def _log_low(wm: int, params: Params) -> int:
    """Readings before this time are not needed at watermarks from ``wm`` on."""
    return wm - max(params.window_ms, params.active_ms) - params.step_ms


def _slices_low(wm: int, params: Params) -> int:
    """Slices that end before this time are not needed at watermarks from ``wm`` on."""
    return min(_log_low(wm, params), wm - params.mean_ms - params.window_ms - params.step_ms)


def _answer(
    batches: DataFrame, every: DataFrame, ahead: DataFrame, min_wm: int | None, max_wm: int | None, low_wm: int | None,
    last_seq: int, cities_epoch: int | None, epoch: int, locations: DataFrame, stores: Stores, params: Params,
) -> None:
    """Answers for released batches, all of them after ``last_seq``."""
    spark = batches.sparkSession
    carried_seq = F.lit(last_seq).cast("bigint")
    known = written(
        stores.read(spark, "cities").where(F.col("epoch") == F.lit(cities_epoch)).drop("epoch"), "cities"
    )
    flat = flatten_batches(batches, params)
    lookup = written(point_in_polygon(flat, locations), "lookup")
    fresh = written(with_city(flat, lookup).select("seq", "pos", *KEY, "ts_ms", "p1", "p2"), "located")
    none = F.lit(None).cast("bigint")
    carried = known.select(
        *KEY, carried_seq.alias("seq"), "max_ts", none.alias("min_ts"), F.col("origin").alias("first_ts")
    )
    arrived = written(arrivals(fresh).unionByName(carried), "arrivals")
    probes = written(active_probes(arrived, ahead, params), "probes")
    # what a city was asked about, or its streak is done with, is settled
    asked = known.select(carried_seq.alias("seq"), F.greatest("last_wm", "done").alias("wm"), *KEY).where("wm is not null")
    late, n_late = counted(late_bounds(arrived, probes.unionByName(asked), params), "late")
    kept = drop_late(fresh, late) if n_late else fresh

    write_epoch(kept.withColumn("day", _day("ts_ms")), stores.path("readings"), epoch, "day")
    mine = stores.read(spark, "readings").where(F.col("epoch") == epoch).drop("day", "epoch")
    write_epoch(
        slice_sums(mine, params).drop("s1", "s2").withColumn("day", _day("slice_end")), stores.path("slices"), epoch, "day"
    )

    if min_wm is None:  # nothing is asked: every batch has its empty result, the cities what arrived
        nothing = lambda schema: spark.createDataFrame([], schema)
        write_results(for_every_batch(every, nothing(Q1)), stores.path("q1"), version=epoch)
        write_results(for_every_batch(every, nothing(Q2)), stores.path("q2"), version=epoch)
        newest = nothing("city STRING, period STRING, until BIGINT")
        streaks = nothing("city STRING, period STRING, ts_ms BIGINT, good_since BIGINT")
        write_epoch(_cities(known, arrived, newest, streaks, none, params), stores.path("cities"), epoch)
        return

    # the look back begins where the last micro-batch ended, so it is as long however much lies behind it
    base = min_wm if low_wm is None else low_wm
    newest = probes.groupBy(*KEY).agg(F.max("wm").alias("until"))
    log = _from_day(stores.read(spark, "readings"), _log_low(min_wm, params), "ts_ms", epoch)
    slices = written(
        _from_day(stores.read(spark, "slices"), _slices_low(base, params), "slice_end", epoch)
        .groupBy(*KEY, "slice_end")
        .agg(*added()),
        "slices",
    )
    snapshots = written(aqi24_snapshots(slices, params), "snapshots")
    at_watermark = written(
        aqi24_at_watermark(log, slices, probes, params, unseen=False), "at-watermark"
    )

    ranking = top_improvements(aqi_improvement(aqi5d(snapshots, at_watermark, params)), params.k)
    write_results(for_every_batch(every, ranking), stores.path("q1"), version=epoch)

    # A city's streak advances to the last watermark it was asked about. That of a silent city advances as
    # far as the next micro-batch can no longer see; what arrives behind that later is late.
    silent = F.lit(max_wm - params.mean_ms).cast("bigint")
    due = (
        snapshots.join(newest, KEY, "left")
        .join(known.select(*KEY, "last_wm", "done"), KEY, "left")
        .where(F.col("ts_ms") <= F.coalesce("until", silent))
        .where(F.col("ts_ms") > F.coalesce(F.greatest("last_wm", "done"), F.lit(-(1 << 62))))
        .drop("until", "last_wm", "done")
    )
    now = F.col("period") == CURRENT
    running = known.where("good_since is not null").select(
        none.alias("seq"), *KEY, F.col("good_since").alias("ts_ms"),
        *[F.lit(0).alias(c) for c in ("aqi", "aqi_p1", "aqi_p2")], F.lit(False).alias("is_probe"),
    )
    values = aqi24_all(due, at_watermark).unionByName(running).where(now)
    streaks = written(good_streak(values, params), "streaks")
    probed = streaks.where("is_probe").select("seq", "city", F.col("ts_ms").alias("ts_last"), "good_since")
    histogram = streak_histogram(watermark_guard(every, params), probed, params)
    write_results(for_every_batch(every, histogram), stores.path("q2"), version=epoch)

    write_epoch(_cities(known, arrived, newest, streaks, silent, params), stores.path("cities"), epoch)


def _cities(
    known: DataFrame, arrived: DataFrame, newest: DataFrame, streaks: DataFrame, silent: Column, params: Params
) -> DataFrame:
    """What the next micro-batch has to know about each city: one row per key."""
    seen = arrived.groupBy(*KEY).agg(
        F.max("max_ts").alias("max_ts"),
        slice_start(F.min_by("first_ts", "seq"), params.step_ms, params.origin_ms).alias("origin"),
    )
    ended = streaks.groupBy(*KEY).agg(
        F.max_by("good_since", "ts_ms").alias("since"), F.first(F.lit(True)).alias("moved")
    )
    return (
        seen.join(newest, KEY, "left").join(ended, KEY, "left")
        .join(known.select(*KEY, "last_wm", "good_since", "done"), KEY, "left")
        .select(
            *KEY, "max_ts", F.greatest("last_wm", "until").alias("last_wm"), "origin",
            F.when(F.col("moved"), F.col("since")).otherwise(F.col("good_since")).alias("good_since"),
            F.greatest("done", silent).alias("done"),
        )
    )


def answers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What a stream has answered so far: ranking and histogram rows."""
    stores = Stores(root)
    return tuple(read_results(spark, stores.path(name), schema) for name, schema in (("q1", Q1), ("q2", Q2)))


def run_questions(
    batches: DataFrame, locations: DataFrame, root: str, params: Params = DEFAULTS, every: str | None = None
) -> StreamingQuery:
    """Starts the stream; results and state are kept below ``root``.

    With ``every``, say "10 seconds", the query goes on taking what has arrived at that interval. Without, it ends when
    all present batches are answered. A later call with the same ``root`` goes on from there.
    """
    stores = Stores(root)
    stores.create(batches.sparkSession)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        batches.writeStream
        .foreachBatch(lambda df, epoch: answer_epoch(df, epoch, locations, stores, params))
        .option("checkpointLocation", stores.path("checkpoint"))
        .trigger(**trigger)
        .start()
    )
