import os

from pyspark.sql import functions as F

from hazemeter.operators.improve import interval_join
from hazemeter.params import HOUR, Params
from hazemeter.plans import fixtures as fx
from hazemeter.plans import standing as st
from hazemeter.sources import tables as S
from hazemeter.streaming import joins
from hazemeter.streaming.job import answers, run_questions
from tests.helpers import rows_of

WIDE = Params(shift_ms=fx.SHIFT, active_ms=12 * HOUR, k=5, histogram_origin_ms=fx.T0)


def feed(batches, folder, low, high, name):
    """Adds batches ``low`` to ``high`` as one file that sorts after earlier ones."""
    part = batches.where(F.col("seq_id").between(low, high)).coalesce(1)
    part.write.mode("append").parquet(folder)
    for file in os.listdir(folder):
        if file.endswith(".parquet") and not file.startswith("b"):
            os.rename(f"{folder}/{file}", f"{folder}/b{name}.parquet")
            os.utime(f"{folder}/b{name}.parquet", (1_000_000 + name, 1_000_000 + name))


def test_stream_equals_batch_across_a_restart(spark, sf_dir, tmp_path):
    batches = fx.batches(spark, sf_dir).cache()
    places = S.load_locations(spark, f"{tmp_path}/places", lambda: fx.locations(spark, sf_dir))
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    last = batches.agg(F.max("seq_id")).first()[0]
    feed(batches, folder, 0, last // 3, 1)
    feed(batches, folder, last // 3 + 1, 2 * last // 3, 2)
    run_questions(S.stream_batches(spark, folder, files_per_trigger=1), places, out, WIDE).awaitTermination()
    feed(batches, folder, 2 * last // 3 + 1, last, 3)
    run_questions(S.stream_batches(spark, folder), places, out, WIDE).awaitTermination()

    base = st.timely_batches(S.read_batches(spark, folder), places, WIDE)
    assert len([f for f in os.listdir(f"{out}/q2") if f.startswith("version=")]) == 3
    for got, want in zip(answers(spark, out), (st.q1_results(base), st.q2_results(base))):
        assert rows_of(got) == rows_of(want)
        assert want.count() > 0


def test_stream_holds_early_batches_and_ignores_repeats(spark, sf_dir, tmp_path):
    batches = fx.batches(spark, sf_dir).cache()
    places = S.load_locations(spark, f"{tmp_path}/places", lambda: fx.locations(spark, sf_dir))
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    last = batches.agg(F.max("seq_id")).first()[0]
    stream = lambda: run_questions(S.stream_batches(spark, folder), places, out, WIDE)
    seen = lambda: {r.batch_seq_id for r in answers(spark, out)[1].collect()}
    feed(batches, folder, 0, 0, 1)
    feed(batches, folder, 2, last, 2)
    stream().awaitTermination()
    assert seen() == {0}
    feed(batches, folder, 0, 1, 3)
    stream().awaitTermination()
    assert seen() == set(range(last + 1))
    together = st.both(st.timely_batches(batches, places, WIDE))
    for got, want in zip(answers(spark, out), together):
        assert rows_of(got) == rows_of(want)


def test_interval_join_of_two_streams(spark, tmp_path):
    import random

    rng = random.Random(3)
    schema = "seq_id bigint, city string, ts_ms bigint, at timestamp"
    sides = {}
    for side in ("left", "right"):
        rows = [(t // 500, rng.choice("ab"), t) for t in sorted(rng.sample(range(1500), 90))]
        df = spark.createDataFrame(rows, "seq_id bigint, city string, ts_ms bigint")
        sides[side] = df.withColumn("at", F.timestamp_millis("ts_ms"))
        for i in range(3):
            feed(sides[side], f"{tmp_path}/{side}", i, i, i + 1)

    def arriving(side):
        return (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}")
            .withWatermark("at", "1 second")
        )

    query = (
        interval_join(arriving("left"), arriving("right"), ["city"], -20, 30, event_time="at")
        .writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    want = interval_join(sides["left"], sides["right"], ["city"], -20, 30)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert want.count() > 20
    assert rows_of(got.select(want.columns)) == rows_of(want)
    states = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 3


def test_streamed_join_keeps_little_and_goes_on_after_an_end(spark, tmp_path):
    """State lies in RocksDB, shrinks as the watermark passes, and is there again when the query starts anew."""
    import random

    rng = random.Random(9)
    schema = "city string, ts_ms bigint, at timestamp"
    root, sides = f"{tmp_path}/join", {"left": [], "right": []}
    kept, before = [], spark.conf.get(joins.PROVIDER)
    for i in range(4):
        streams = []
        for side in sides:
            rows = [(rng.choice("ab"), 20_000 * i + t) for t in rng.sample(range(20_000), 300 if i < 2 else 20)]
            sides[side] += rows
            df = spark.createDataFrame(rows, "city string, ts_ms bigint").withColumn("at", F.timestamp_millis("ts_ms"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")
            streams.append(spark.readStream.schema(schema).parquet(f"{tmp_path}/{side}"))
        query = joins.run_interval_join(*streams, ["city"], -500, 2_000, root)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0])
    assert spark.conf.get(joins.PROVIDER) == before
    left, right = (spark.createDataFrame(rows, "city string, ts_ms bigint") for rows in sides.values())
    want = interval_join(left, right, ["city"], -500, 2_000)
    got = spark.read.parquet(f"{root}/pairs").select("city", "ts_ms", "r_ts_ms")
    assert want.count() > 100 and rows_of(got) == rows_of(want.select("city", "ts_ms", "r_ts_ms"))
    assert any("rocksdb" in name for name in kept[0]["customMetrics"])
    held = [k["numRowsTotal"] for k in kept]
    assert max(held) < 300 and held[3] < held[1]
