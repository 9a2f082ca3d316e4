"""Sliding windows over slices.

A window sum at time t is kept as a running sum of changes: a slice adds its sums
when it enters the window and takes them back when it leaves. Sums are exact
integers, so nothing drifts, and each row costs the same however long the window
is (a RANGE frame would add up to 288 or 1440 rows again for every output row).
The rows per key are bounded by elapsed time over the step, not by readings.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.functions.aqi import with_index
from hazemeter.functions.sums import SUMS, added, nothing, sums, taken_back
from hazemeter.functions.timegrid import slice_start
from hazemeter.operators.scan import so_far
from hazemeter.operators.slices import slice_sums
from hazemeter.params import DEFAULTS, Params
from hazemeter.session import written

KEY = ["city", "period"]
#: Rows that one task sorts for a window, about; more of them are more tasks.
TASK_ROWS = 400_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, a key's in one task. What fits the tasks at hand is left to Spark to deal."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(*([tasks] if tasks > rows.sparkSession.sparkContext.defaultParallelism else []), *KEY)


def aqi24_snapshots(slices: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(city, period, ts_ms, aqi, aqi_p1, aqi_p2)`` at grid ends E with data.

    The index is that of the means over ``[E - window, E)``; E is reported if a
    reading lies in the last two slices before it.
    """
    end = F.col("slice_end")

    def change(at, values, reported):
        return F.struct(at.alias("ts_ms"), *values, F.lit(reported).alias("reported"))

    none = [zero.alias(c) for c, zero in nothing().items()]
    # shuffled before a row becomes three
    changes = slices.repartition(*KEY).select(
        *KEY,
        F.inline(F.array(
            change(end, map(F.col, SUMS), True),
            change(end + params.step_ms, none, True),
            change(end + params.window_ms, taken_back(), False),
        )),
    )
    # of the rows at one time the last has all changes, and is a reported one if any is
    order = Window.partitionBy(*KEY).orderBy("ts_ms", "reported")
    inside = (
        changes.withColumns({c: F.sum(c).over(so_far(order)) for c in SUMS} | {"next": F.lead("ts_ms").over(order)})
        .where("reported and n > 0 and (next is null or next > ts_ms)")
        .select(*KEY, "ts_ms", *SUMS)
    )
    return with_index(inside)


def sliding_aqi(
    readings: DataFrame, window_ms: int, step_ms: int, origin_ms: int = 0, params: Params = DEFAULTS
) -> DataFrame:
    """Snapshots with a window, slide and grid origin of one's own."""
    own = replace(
        params, window_ms=window_ms, step_ms=step_ms, origin_ms=origin_ms,
        mean_ms=params.mean_ms // step_ms * step_ms,
    )
    return aqi24_snapshots(slice_sums(readings, own), own)


def _points(readings: DataFrame, slices: DataFrame, watermarks: DataFrame, params: Params) -> DataFrame:
    """``(city, period, t)`` and SUMS: the readings in groups that lie, by their ``t``, on the same side of every edge of a window.

    ``watermarks(wm)`` lists each time that is asked about once. A slice without an edge inside is one group. The readings of the others are first
    summed by millisecond, which combines before the shuffle and spreads a busy slice over tasks, then from edge to edge. So a
    key has at most a row per slice and edge, however many readings it has.
    """
    edges = watermarks.select(F.explode(F.array("wm", F.col("wm") - params.window_ms, F.col("wm") - params.active_ms)).alias("t"))
    grid = slice_start(F.col("t"), params.step_ms, params.origin_ms)
    cut = edges.withColumn("grid", grid).where("t > grid").groupBy("grid").agg(F.collect_set("t").alias("edges"))
    cut = written(cut, "edges")
    whole = slices.withColumn("grid", F.col("slice_end") - params.step_ms).join(cut.select("grid"), "grid", "left_anti")
    start = slice_start(F.col("ts_ms"), params.step_ms, params.origin_ms)
    ticks = readings.groupBy(*KEY, start.alias("grid"), F.col("ts_ms").alias("tick")).agg(*sums()).join(cut.select("grid"), "grid", "left_semi")
    passed = F.array_max(F.filter("edges", lambda e: e <= F.col("tick")))
    parts = ticks.join(cut, "grid").groupBy(*KEY, F.greatest("grid", passed).alias("t")).agg(*added())
    return whole.select(*KEY, F.col("grid").alias("t"), *SUMS).unionByName(parts)


def aqi24_at_watermark(
    readings: DataFrame,
    slices: DataFrame,
    probes: DataFrame,
    params: Params = DEFAULTS,
    unseen: bool = True,
) -> DataFrame:
    """``(seq, city, period, ts_ms, aqi, aqi_p1, aqi_p2)`` at each probe's watermark.

    The means run over exactly ``[wm - window, wm)``. A probe is answered if a
    reading lies in ``[wm - active, wm)``. With ``unseen``, a probe of a city
    without any reading so far is answered with index -1; probes derived from the
    readings themselves never need that.
    """
    wm = F.col("wm")
    points = _points(readings, slices, written(probes.select("wm").distinct(), "watermarks"), params)
    # Points enter the window behind their time and leave it a window later; they are shuffled once, before that makes two rows of them.
    asked = probes.select(*KEY, wm.alias("t"), "seq").withColumns(nothing())
    both = points.withColumn("seq", F.lit(None).cast("bigint")).withColumn("is_probe", F.lit(False)).unionByName(asked.withColumn("is_probe", F.lit(True)))
    none = F.lit(None).cast("bigint")
    change = lambda at, values, latest: F.struct(at.alias("at"), *values, latest.alias("latest"))
    own = [F.col(c) for c in SUMS]
    changes = _dealt(both, slices.count() + probes.count()).select(
        *KEY, "seq", "is_probe",
        F.inline(
            F.when(F.col("is_probe"), F.array(change(F.col("t"), own, none)))
            .otherwise(F.array(change(F.col("t"), own, F.col("t")), change(F.col("t") + params.window_ms, taken_back(), none)))
        ),
    )
    # at equal times the probe comes first: its window excludes readings at its own time, and has those a whole window older
    run = so_far(Window.partitionBy(*KEY).orderBy("at", F.col("is_probe").desc()))
    known = (
        changes.withColumns({c: F.sum(c).over(run) for c in SUMS} | {"latest": F.max("latest").over(run)})
        .where("is_probe and n > 0").where(F.col("latest") >= F.col("at") - params.active_ms)
        .select("seq", *KEY, F.col("at").alias("ts_ms"), *SUMS)
    )
    known = with_index(known)
    if not unseen:
        return known
    first_seen = readings.groupBy(*KEY).agg(F.min("seq").alias("first_seq"))
    blank = (
        probes.join(first_seen, KEY, "left")
        .where("first_seq is null or first_seq > seq")
        .select(
            "seq", *KEY, wm.alias("ts_ms"),
            F.lit(0).alias("aqi_p1"), F.lit(0).alias("aqi_p2"), F.lit(-1).alias("aqi"),
        )
    )
    return known.unionByName(blank)


def aqi24_all(snapshots: DataFrame, at_watermark: DataFrame) -> DataFrame:
    """Both kinds of values as one sequence; ``is_probe`` tells them apart.

    A watermark on the grid yields the snapshot and the watermark value at the
    same time, with the same index.
    """
    return snapshots.select(
        F.lit(None).cast("bigint").alias("seq"), *KEY, "ts_ms", "aqi", "aqi_p1", "aqi_p2",
        F.lit(False).alias("is_probe"),
    ).unionByName(at_watermark.withColumn("is_probe", F.lit(True)))


def aqi5d(
    snapshots: DataFrame, at_watermark: DataFrame, params: Params = DEFAULTS, origin: bool = False
) -> DataFrame:
    """Mean snapshot index over ``(wm - mean, wm]`` for every watermark value.

    Snapshots lie on the grid, so the mean at ``wm`` is the mean at the grid point
    before it: one running sum per grid point serves all watermarks of its slice.
    Without a snapshot in reach the watermark's own index stands in; ``origin`` adds ``is_mean`` to tell which it is.
    """
    grid = slice_start(F.col("ts_ms"), params.step_ms, params.origin_ms)
    answer = F.struct("seq", "ts_ms", "aqi", "aqi_p1", "aqi_p2")
    values = snapshots.select(*KEY, F.col("ts_ms").alias("at"), F.col("aqi").cast("bigint").alias("value"), F.lit(None).alias("asked"))
    asked = at_watermark.select(*KEY, grid.alias("at"), F.lit(None).cast("bigint").alias("value"), answer.alias("asked"))
    at, value = F.col("at"), F.col("value")
    change = lambda at, total, n: F.struct(
        at.alias("grid"), total.alias("total"), F.lit(n).cast("bigint").alias("n")
    )
    # Both are shuffled once, before a snapshot becomes two rows; what is asked goes along and needs no join.
    changes = values.unionByName(asked).repartition(*KEY).select(
        *KEY, "asked",
        F.inline(
            F.when(F.col("asked").isNotNull(), F.array(change(at, F.lit(0).cast("bigint"), 0)))
            .otherwise(F.array(change(at, value, 1), change(at + params.mean_ms, -value, -1)))
        ),
    )
    run = so_far(Window.partitionBy(*KEY).orderBy("grid", F.col("asked").isNotNull()))
    return (
        changes.withColumns({c: F.sum(c).over(run) for c in ("total", "n")})
        .where("asked is not null")
        .withColumn("mean", F.col("total").cast("double") / F.nullif("n", F.lit(0)))
        .select(
            "asked.seq", *KEY, "asked.ts_ms",
            F.coalesce("mean", F.col("asked.aqi").cast("double")).alias("aqi"), "asked.aqi_p1", "asked.aqi_p2",
            *[F.col("mean").isNotNull().alias("is_mean")] * origin,
        )
    )
