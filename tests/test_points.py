"""Windows at watermarks take one pass: a row per slice and edge of a window, however many readings, and a row per probe."""

import random

from pyspark.sql import functions as F

from hazemeter.operators.slices import slice_sums
from hazemeter.operators.windows import _points, aqi24_at_watermark, aqi24_snapshots
from tests.helpers import PROBE, READING, index_of_means
from tests.test_ingest import plan_of
from tests.test_windows import PARAMS

WATERMARKS = [600_001, 600_500, 660_000, 1_200_700, 1_260_001]


def hot(spark, n=3000):
    rng = random.Random(5)
    rows = [(0, i, "hot", "current", rng.randrange(1_300_000), round(rng.random() * 300, 2), 3.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, READING).repartition(3)


def test_points_follow_slices_and_edges(spark):
    rows, readings = hot(spark)
    slices = slice_sums(readings, PARAMS)
    watermarks = spark.createDataFrame([(w,) for w in WATERMARKS], "wm long")
    points = _points(readings, slices, watermarks, PARAMS).collect()
    edges = {w - d for w in WATERMARKS for d in (0, PARAMS.window_ms, PARAMS.active_ms)}
    assert len(points) <= slices.count() + len(edges)
    assert sum(p.n for p in points) == len(rows)
    for e in edges:
        assert sum(p.n for p in points if p.t < e) == sum(r[4] < e for r in rows)


def test_a_hot_city_at_its_watermarks(spark):
    rows, readings = hot(spark)
    probes = spark.createDataFrame([(i, w, "hot", "current") for i, w in enumerate(WATERMARKS)], PROBE)
    got = {r.ts_ms: (r.aqi, r.aqi_p1, r.aqi_p2) for r in aqi24_at_watermark(readings, slice_sums(readings, PARAMS), probes, PARAMS).collect()}
    inside = lambda w: [{"p1": r[5], "p2": r[6]} for r in rows if w - PARAMS.window_ms <= r[4] < w]
    assert got == {w: index_of_means(inside(w)) for w in WATERMARKS}


def test_probes_are_one_row_and_slices_are_shuffled_before_they_are_three(spark):
    _, readings = hot(spark, 50)
    slices = slice_sums(readings, PARAMS)
    probes = spark.createDataFrame([(0, WATERMARKS[0], "hot", "current")], PROBE)
    at = plan_of(aqi24_at_watermark(readings, slices, probes, PARAMS, unseen=False))
    assert sum("Window [" in line or "Window(" in line for line in at) == 1
    for lines in (at, plan_of(aqi24_snapshots(slices.withColumn("n", F.col("n")), PARAMS))):
        made = next(i for i, line in enumerate(lines) if "Generate inline" in line)
        assert not any("Exchange" in line for line in lines[:made])
