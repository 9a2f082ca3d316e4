from pyspark.sql import functions as F

from hazemeter.functions.timegrid import bucket_of, epoch_ms, slice_membership, slice_start, utc_time
from hazemeter.operators import batches as B
from hazemeter.params import Params
from hazemeter.schema import BATCH
from tests.helpers import rows_of


def reading(seconds, nanos=0, lat=52.5, lon=13.3, p1=1.0, p2=2.0):
    return ((seconds, nanos), lat, lon, p1, p2)


def numbered(spark, *flags):
    return spark.createDataFrame([(seq, last, [], []) for seq, last in flags], BATCH)


def test_limit_stops_at_the_flag_or_the_count(spark):
    some = numbered(spark, (3, False), (0, False), (2, True), (1, False))
    assert [r[0] for r in rows_of(B.limit_batches(some, 10).select("seq_id"))] == [0, 1, 2]
    assert [r[0] for r in rows_of(B.limit_batches(some, 2).select("seq_id"))] == [0, 1]
    none = numbered(spark, (3, False), (5, False))
    assert [r[0] for r in rows_of(B.limit_batches(none, 10).select("seq_id"))] == [3, 5]


def test_ordered_prefix_waits_for_the_gap(spark):
    some = numbered(spark, *[(s, False) for s in (0, 2, 1, 4, 5)])
    assert [r[0] for r in rows_of(B.ordered_prefix(some).select("seq_id"))] == [0, 1, 2]
    assert [r[0] for r in rows_of(B.ordered_prefix(some, 2).select("seq_id"))] == [0, 1]
    late_start = numbered(spark, (1, False), (2, False))
    assert B.ordered_prefix(late_start).count() == 0
    whole = numbered(spark, (1, False), (0, False))
    assert B.ordered_prefix(whole).count() == 2


def test_ordered_prefix_per_feed(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1), ("c", 0)], "feed string, seq_id bigint")
    assert rows_of(B.ordered_prefix(df, feed="feed")) == [("a", 0), ("a", 1), ("c", 0)]


def test_flatten_shifts_only_last_year(spark):
    params = Params(shift_ms=1_000_000)
    df = spark.createDataFrame(
        [(7, False, [reading(10, 5_000_000), reading(11)], [reading(3)])], BATCH
    )
    got = B.flatten_batches(df, params).select("seq", "period", "pos", "ts_ms")
    assert rows_of(got) == [
        ("current", 0, 7, 10_005), ("current", 1, 7, 11_000), ("lastyear", 0, 7, 1_003_000)
    ]


def test_watermark_is_the_last_position_not_the_maximum(spark):
    params = Params(shift_ms=1_000_000)
    df = spark.createDataFrame([
        (0, False, [reading(20), reading(10)], [reading(99)]),
        (1, False, [], [reading(5), reading(4)]),
        (2, True, [], []),
    ], BATCH)
    assert rows_of(B.nested_headers(df, params)) == [(0, 10_000), (1, 1_004_000), (2, None)]
    flat = B.flat_headers(B.flatten_batches(df, params))
    assert rows_of(flat) == [(0, 10_000), (1, 1_004_000)]


def test_advancing_both_ways(spark, monkeypatch):
    wms = [5, 9, 7, 9, None, 12, 11, 13, 2, 14]
    df = spark.createDataFrame(list(enumerate(wms)), "seq bigint, wm bigint")
    want = [(0, 5), (1, 9), (3, 9), (5, 12), (7, 13), (9, 14)]
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(B, "SEQ_BLOCK", block)
        assert rows_of(B.advancing(df)) == want


def test_time_columns(spark):
    df = spark.createDataFrame([(1, 999_999_999, -1)], "s bigint, n int, t bigint")
    row = df.select(
        epoch_ms(F.col("s"), F.col("n")).alias("ms"), epoch_ms(F.col("s"), F.col("n"), 1000).alias("legacy"),
        slice_start(F.col("t")).alias("start"), bucket_of(F.col("t"), 10).alias("b"),
        utc_time(F.col("t")).cast("string").alias("u"),
        slice_membership(F.lit(5), F.lit(5), F.lit(6)).alias("m"),
    ).first()
    assert (row.ms, row.legacy, row.start, row.b, row.m) == (1999, 1_000_999, -300_000, -1, 0)
    assert row.u == "1969-12-31 23:59:59.999"
