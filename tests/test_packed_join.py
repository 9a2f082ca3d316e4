"""The streamed interval join keeps and meets chunks of rows, so state and what is written follow the rows and not their pairs."""

import random

from pyspark.sql import functions as F

from hazemeter.operators.improve import interval_join
from hazemeter.streaming import joins
from tests.helpers import rows_of

SCHEMA = "city string, pos long, ts_ms bigint, at timestamp"


def test_dense_streams_meet_in_chunks(spark, tmp_path):
    rng, sides, n = random.Random(4), [], 1500
    for side in ("left", "right"):
        rows = [(rng.choice("ab") if i % 100 else None, i, rng.randrange(22_000)) for i in range(n)]
        df = spark.createDataFrame(rows, "city string, pos long, ts_ms long").withColumn("at", F.timestamp_millis("ts_ms"))
        df.coalesce(1).write.parquet(f"{tmp_path}/{side}")
        sides.append(spark.read.parquet(f"{tmp_path}/{side}"))
    want = interval_join(*sides, ["city"], -900, 3_101)
    arriving = [spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{side}") for side in ("left", "right")]
    query = joins.run_interval_join(*arriving, ["city"], -900, 3_101, f"{tmp_path}/out", packed=True)
    query.awaitTermination()
    packed = spark.read.parquet(f"{tmp_path}/out/packed")
    got = joins.expanded(packed, ["city"], -900, 3_101)
    assert rows_of(got.select(want.columns)) == rows_of(want)
    assert want.count() > 100 * n > 100 * packed.count()
    assert max(p["numRowsTotal"] for b in query.recentProgress for p in b["stateOperators"]) < n / 3


def test_full_chunks_are_cut(spark):
    n = 2 * joins.CHUNK + 5
    df = spark.range(n).selectExpr("'a' as city", "id as pos", "id % 7 as ts_ms", "timestamp_millis(id % 7) as at").coalesce(1)
    chunks = joins._chunks(df, ["city"], "ts_ms", "at", 400).collect()
    assert sorted(r["pos"] for c in chunks for r in c["rows"]) == list(range(n))
    assert sorted(len(c["rows"]) for c in chunks) == [5, joins.CHUNK, joins.CHUNK]
    assert all(c["at"] == max(r["at"] for r in c["rows"]) for c in chunks)
