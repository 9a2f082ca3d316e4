"""Arrived batches as they come: empty, outside, repeated, early, unreadable; in a batch job and in a stream."""

import math
import os

from pyspark.sql import functions as F

from hazemeter.operators import batches as B
from hazemeter.operators.slices import slice_sums
from hazemeter.operators.windows import aqi24_at_watermark
from hazemeter.params import DAY, HOUR, MINUTE, Params
from hazemeter.plans import standing as st
from hazemeter.schema import BATCH, LOCATION
from hazemeter.sources import tables as S
from hazemeter.streaming import job
from tests.helpers import rows_of

PARAMS = Params(shift_ms=0, active_ms=HOUR, k=5, window_ms=6 * HOUR, mean_ms=12 * HOUR, histogram_origin_ms=0)
T = 1_700_000_000


def reading(at, p1, lat=1.0, lon=1.0, p2=1.0):
    return ((T + at, 0), lat, lon, p1, p2)


def places(spark):
    ring = lambda x: [([(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0)],)]
    return spark.createDataFrame([("1", "A", 1.0, 0, ring(0.0)), ("2", "B", 1.0, 0, ring(10.0))], LOCATION)


def pair(at, p1, **where):
    """A batch's two sides: last year's air was worse."""
    return [reading(at, p1, **where)], [reading(at, p1 + 60.0, **where)]


def messy():
    nan = math.nan
    rows = [(i, False, *pair(i * 1800, 10.0 + i)) for i in range(12)]
    rows[3] = (3, False, [], [])  # nothing in it
    rows[5] = (5, False, *pair(5 * 1800, 20.0, lat=50.0))  # all outside
    now, before = pair(7 * 1800, 5.0, lon=11.0)
    rows[7] = (7, False, [reading(7 * 1800, None), reading(7 * 1800, nan), *now, reading(7 * 1800 + 1, 3.0, p2=None)], before)
    rows[9] = (9, False, None, None)
    rows.append(rows[4])
    rows.append((6, False, *pair(6 * 1800, 400.0)))  # another copy of a number
    rows.append((None, False, *pair(0, 400.0)))
    rows += [(i, i == 15, *pair(i * 1800, 8.0)) for i in (13, 14, 15, 16)]  # 12 is missing
    return rows


def test_ingest(spark):
    df = spark.createDataFrame(messy(), BATCH).repartition(3)
    assert sorted(r.seq_id for r in B.ingest(df).collect()) == list(range(12))
    assert sorted(r.seq_id for r in B.ingest(df, 4, 3).collect()) == [4, 5, 6]
    assert sorted(r.seq_id for r in B.ingest(df, 13).collect()) == [13, 14, 15]  # none after the last
    assert B.ingest(df, 12).count() == 0
    once = str(rows_of(B.ingest(df)))
    assert str(rows_of(B.ingest(df.repartition(1)))) == once  # the same copy of number 6
    flat = B.flatten_batches(B.ingest(df), PARAMS)
    assert rows_of(flat.where("seq = 7").select("period", "pos", "p1")) == [(5.0, "current", 2), (65.0, "lastyear", 0)]
    assert flat.where("seq in (3, 9)").count() == 0


def test_every_batch_has_a_result(spark):
    df = spark.createDataFrame(messy(), BATCH)
    ranking, histogram = st.both(st.timely_batches(df, places(spark), PARAMS))
    for out in (ranking, histogram):
        assert {r.batch_seq_id for r in out.collect()} == set(range(12))
    assert {r.batch_seq_id for r in ranking.where("city is null").collect()} >= {3, 9}
    assert rows_of(histogram.where("bucket_from is null").select("batch_seq_id")) == [(3,), (9,)]
    # the mean of what is there: a null and a NaN beside 5 do not count
    assert ranking.where("batch_seq_id = 7 and city = 'B'").first().current_p1 == 5000


def stream(spark, folder, out, where):
    job.run_questions(S.stream_batches(spark, folder), where, out, PARAMS).awaitTermination()


def arrive(spark, rows, folder, name):
    spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    for file in os.listdir(f"{folder}-{name}"):
        if file.endswith(".parquet"):
            os.rename(f"{folder}-{name}/{file}", f"{folder}/{name}.parquet")
            os.utime(f"{folder}/{name}.parquet", (1_000_000 + name, 1_000_000 + name))


def compare(spark, out, batches, where):
    for got, want in zip(job.answers(spark, out), st.both(st.timely_batches(batches, where, PARAMS))):
        assert rows_of(got) == rows_of(want)


def test_stream_equals_batch_on_messy_input(spark, tmp_path):
    where, folder, out = places(spark), f"{tmp_path}/in", f"{tmp_path}/out"
    rows = messy()
    first = [r for r in rows if r[0] is None or r[0] in (0, 1, 2, 5, 6)]
    second = [r for r in rows if r[0] in (0, 3)]  # only the empty one is new
    third = [r for r in rows if r[0] is not None and (r[0] in (4, 7, 8) or r[0] > 8)]
    for i, part in enumerate((first, second, third)):
        arrive(spark, part, folder, i)
    stream(spark, folder, out, where)
    compare(spark, out, spark.createDataFrame(rows, BATCH), where)
    arrive(spark, [(12, False, *pair(12 * 1800, 9.0))], folder, 8)
    arrive(spark, [(17, False, *pair(17 * 1800, 9.0))], folder, 9)
    stream(spark, folder, out, where)  # 12 lets 13 to 15 go, and 15 was the last
    compare(spark, out, spark.createDataFrame([*rows, (12, False, *pair(12 * 1800, 9.0))], BATCH), where)
    assert spark.read.parquet(f"{out}/run").agg(F.max("last_seq")).first()[0] == 15


def test_state_does_not_grow_and_a_silent_city_comes_back(spark, tmp_path):
    """A city is silent for days; state stays as large, and a repeated epoch changes nothing."""
    where, out = places(spark), f"{tmp_path}/out"
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        _grow(spark, where, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def _grow(spark, where, out):
    stores = job.Stores(out)
    stores.create(spark)
    rows = []
    for i in range(30):
        now, before = pair(i * 4 * 3600, 10.0 + i % 3 * 45)
        if i < 2 or i > 26:
            more = pair(i * 4 * 3600 + 30, 12.0, lon=11.0)
            now, before = now + more[0], before + more[1]
        rows.append((i, False, now, before))
    sizes = {}
    for i, row in enumerate(rows):
        df = spark.createDataFrame([row], BATCH)
        if i == 12:  # it fails after its slices are written, and runs again
            fails = job.aqi24_snapshots
            job.aqi24_snapshots = lambda *a: 1 / 0
            try:
                job.answer_epoch(df, i, where, stores, PARAMS)
            except ZeroDivisionError:
                pass
            finally:
                job.aqi24_snapshots = fails
        job.answer_epoch(df, i, where, stores, PARAMS)
        sizes[i] = {t: sum(len(f) for _, _, f in os.walk(f"{out}/{t}")) for t in job.TABLES}
    assert all(sizes[i][t] <= 1.5 * sizes[14][t] + 4 for i in range(15, 30) for t in job.TABLES), sizes
    compare(spark, out, spark.createDataFrame(rows, BATCH), where)


def test_watermark_sums_combine_before_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        readings = spark.createDataFrame([(0, 0, "A", "current", 5 * MINUTE, 1.0, 1.0)], "seq long, pos long, city string, period string, ts_ms long, p1 double, p2 double")
        slices = slice_sums(readings)
        probes = spark.createDataFrame([(0, 7 * MINUTE + DAY, "A", "current")], "seq long, wm long, city string, period string")
        plan = aqi24_at_watermark(readings, slices, probes, unseen=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :].split("\n")
    scan = next(i for i, line in enumerate(lines) if "p1#" in line and "Scan" in line)
    above = [line for line in lines[:scan] if "Exchange" in line or "partial_" in line]
    assert "partial_" in above[-1] and "Exchange" in above[-2]


def plan_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :].split("\n")


def moved(df):
    """Shuffles and sorts of a plan whose rows have the readings in them."""
    found = []
    for line in plan_of(df):
        kind = next((k for k in ("Exchange", "Sort ", "Window") if k in line), None)
        if kind:
            found.append(kind)
    return found


def test_batches_that_come_once_are_not_shuffled(spark, tmp_path):
    """Only copies of a number meet; a plan of batches without copies has no shuffle and no sort of readings."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        single = [(i, False, *pair(i * 1800, 10.0)) for i in range(20)]
        for rows, name in ((single, "once"), (single + single[3:5], "twice")):
            spark.createDataFrame(rows, BATCH).repartition(4).write.parquet(f"{tmp_path}/{name}")
        once, twice = (S.read_batches(spark, f"{tmp_path}/{name}") for name in ("once", "twice"))
        taken = B.ingest(once, n=15)
        assert moved(taken) == [] and sorted(r.seq_id for r in taken.select("seq_id").collect()) == list(range(15))
        assert not any("Join" in line for line in plan_of(B.limit_batches(once, 4))) and B.limit_batches(once, 4).count() == 4
        both = B.ingest(twice)
        lines = plan_of(both)
        shuffle = next(i for i, line in enumerate(lines) if "Exchange" in line)
        below = "\n".join(lines[shuffle:])
        assert " IN (3,4)" in below  # what is shuffled has passed the look at its number
        assert "\n".join(lines).count("Exchange") == 1
        assert rows_of(both) == rows_of(taken.unionByName(once.where("seq_id >= 15")))
        assert rows_of(B.without_repeats(twice, listed=1)) == rows_of(both)  # too many copied numbers for a list
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_held_batches_are_written_once(spark, tmp_path):
    """Number 0 comes last, after a gap of thirty micro-batches: each early batch is in one file until then."""
    where, out = places(spark), f"{tmp_path}/out"
    stores = job.Stores(out)
    stores.create(spark)
    rows = [(i, False, *pair(i * 1800, 10.0 + i)) for i in range(31)]
    files = lambda: {f: os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{out}/held") for f in names if f.endswith(".parquet")}
    seen = files()
    for i in range(1, 31):
        job.answer_epoch(spark.createDataFrame([rows[i]], BATCH).coalesce(1), i, where, stores, PARAMS)
        now = files()
        assert {f: now[f] for f in seen} == seen and len(now) == len(seen) + 1
        seen = now
    assert spark.read.parquet(f"{out}/held").count() == 30
    job.answer_epoch(spark.createDataFrame([rows[0]], BATCH), 31, where, stores, PARAMS)
    compare(spark, out, spark.createDataFrame(rows, BATCH), where)
    job.answer_epoch(spark.createDataFrame([(31, True, *pair(31 * 1800, 9.0))], BATCH), 32, where, stores, PARAMS)
    assert stores.read(spark, "held").count() == 0 and len(os.listdir(f"{out}/held")) < 6
