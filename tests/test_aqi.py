import pytest
from pyspark.sql import functions as F

from hazemeter.functions import aqi as A

# Concentration and expected index.
PM10 = [(100, 73), (54.99, 50), (55, 51), (0, 0), (604, 500), (1e11, 999)]
PM25 = [(35.9, 102), (35.49999, 100), (35.5, 101), (350.4, 400), (350.5, 401), (0, 0), (500.4, 500), (1e11, 999)]


@pytest.mark.parametrize("fn, cases", [(A.aqi_pm10, PM10), (A.aqi_pm25, PM25)])
def test_golden_indexes(spark, fn, cases):
    df = spark.createDataFrame([(float(v), want) for v, want in cases], "v double, want int")
    df = df.withColumn("v", F.col("v").cast("float"))
    assert df.where(~fn("v").eqNullSafe(F.col("want"))).count() == 0


def test_combined_and_good(spark):
    df = spark.createDataFrame([(10.0, 20.0), (36.0, 20.0), (1.0, 300.0)], "p25 double, p10 double")
    got = df.select(A.aqi_combined("p25", "p10").alias("a")).collect()
    assert [r.a for r in got] == [42, 102, 173]
    flags = spark.createDataFrame([(-1,), (0,), (50,), (51,)], "a int").select(A.is_good(F.col("a")).alias("g"))
    assert [r.g for r in flags.collect()] == [False, True, True, False]


def test_milli_rounds_half_up(spark):
    df = spark.createDataFrame([(1.0005,), (-1.0005,), (2.5,), (-0.0005,)], "v double")
    assert [r.m for r in df.select(A.milli(F.col("v")).alias("m")).collect()] == [1001, -1000, 2500, 0]


def test_group_index_ignores_input_order(spark):
    rows = [("a", 0.1, 35.5), ("a", 0.2, 35.5), ("a", 0.3, 35.5)] * 50
    df = spark.createDataFrame(rows, "k string, p1 double, p2 double")
    for parts in (1, 7):
        got = df.repartition(parts).groupBy("k").agg(A.agg_aqi("p1", "p2").alias("a")).first().a
        assert got == 101
