"""Sums of readings of any size, against decimal arithmetic."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import functions as F

from hazemeter.functions import aqi, sums
from hazemeter.operators.slices import slice_sums
from hazemeter.operators.windows import aqi24_at_watermark, aqi24_snapshots
from hazemeter.params import Params
from tests.helpers import PROBE, READING

PARAMS = Params(step_ms=60_000, window_ms=180_000, mean_ms=360_000, active_ms=120_000)


def nine(x):
    return Decimal(x).quantize(Decimal("1e-9"), ROUND_HALF_EVEN)


def test_sums_are_exact_in_any_order(spark):
    rng = random.Random(8)
    values = [float(np.float32(rng.choice([1, -1]) * 10 ** rng.uniform(-9, 14.9))) for _ in range(2000)]
    values += [0.00001, 0.000012345, 1e-9, 999999999999999.0, -999999999999999.0, 123456789.123456789, -0.5, 0.0] * 3
    want = sum(nine(v) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for parts in (1, 5):
        got = df.repartition(parts).agg(F.expr(sums.total("v")).alias("s"), F.expr(sums.beyond("v")).alias("i")).first()
        assert (got.s, got.i) == (want, 0)
    none = df.limit(0).agg(F.expr(sums.total("v")).alias("s"), F.expr(sums.beyond("v")).alias("i")).first()
    assert (none.s, none.i) == (0, 0)


def test_huge_readings_are_counted_apart(spark):
    inf = float("inf")
    rows = [("a", 1.5), ("a", inf), ("b", -inf), ("b", 2.0), ("c", 1e16), ("c", -inf), ("d", -1e15), ("d", 0.25), ("e", 9e14), ("e", -9e14), ("e", 0.125)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(F.expr(sums.total("v")).alias("s"), F.expr(sums.beyond("v")).alias("i"), F.count("v").alias("n"))
    got = {r.k: r for r in df.select("k", "s", sums.shown("s", "i").alias("shown"), F.expr(sums.mean("s", "i", "n")).alias("mean")).collect()}
    assert {k: (r.shown, r["mean"]) for k, r in got.items()} == {"a": (inf, inf), "b": (-inf, -inf), "c": (inf, inf), "d": (-inf, -inf), "e": (0.125, np.float32(0.125 / 3))}


def reading(pos, ts, p1, p2):
    return (0, pos, "x", "current", ts, p1, p2)


def test_infinite_readings_enter_and_leave_windows(spark):
    """One in the second minute: windows with it have the last index, those before and after their own."""
    inf = float("inf")
    rows = [reading(i, 30_000 + 60_000 * i, 20.0, 5.00001) for i in range(9)] + [reading(9, 90_000, inf, 5.0), reading(10, 330_000, 20.0, -inf), reading(11, 331_000, 20.0, 1e16)]
    readings = spark.createDataFrame(rows, READING)
    slices = slice_sums(readings, PARAMS)
    got = {r.ts_ms // 60_000: (r.aqi_p1, r.aqi_p2) for r in aqi24_snapshots(slices, PARAMS).collect()}
    usual = (aqi_of(spark, 20.0, aqi.aqi_pm10), aqi_of(spark, 5.0, aqi.aqi_pm25))
    assert {t: v for t, v in got.items() if t in (1, 5, 9)} == {1: usual, 5: usual, 9: usual}
    assert {got[t][0] for t in (2, 3, 4)} == {999} and {got[t][1] for t in (6, 7, 8)} == {999}
    probes = spark.createDataFrame([(0, t, "x", "current") for t in (90_000, 90_001, 270_000, 270_001, 330_001, 331_001)], PROBE)
    at = {r.ts_ms: (r.aqi_p1, r.aqi_p2) for r in aqi24_at_watermark(readings, slices, probes, PARAMS).collect()}
    assert at == {90_000: usual, 90_001: (999, usual[1]), 270_000: (999, usual[1]), 270_001: usual, 330_001: (usual[0], 0), 331_001: (usual[0], 999)}


def aqi_of(spark, value, fn):
    return spark.createDataFrame([(value,)], "v double").select(fn("v").alias("a")).first().a
