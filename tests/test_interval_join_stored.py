"""A result of the range join far larger than its input, whose times never repeat, is stored in few bytes."""

import glob
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq

from hazemeter.plans.catalog import QUERIES
from hazemeter.session import configure

N = 1_200
MINUTE = 60_000


def encodings(folder, column):
    found = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    chunks = [m.row_group(g).column(m.schema.names.index(column)) for m in found for g in range(m.num_row_groups)]
    return {e for c in chunks for e in c.encodings}, sum(c.total_compressed_size for c in chunks)


def test_differences_of_times_take_few_bytes(spark, tmp_path):
    rng = random.Random(5)
    times = [rng.sample(range(35 * MINUTE), N) for _ in range(2)]
    start = datetime(2024, 1, 16)
    at = [start + timedelta(milliseconds=t) for t in times[0]] + [start + timedelta(days=-14, milliseconds=t) for t in times[1]]
    events = [(i, t, 20 * (i % 7), 1.0) for i, t in enumerate(at)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["interval_join_range"](spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
    want = {(i, N + j, b - a) for i, a in enumerate(times[0]) for j, b in enumerate(times[1]) if a - 10 * MINUTE <= b <= a + 25 * MINUTE}
    out = pq.read_table(f"{tmp_path}/out")
    assert out.num_rows == len(want) > 500_000
    assert set(zip(*(out[c].to_pylist() for c in ("pos", "r_pos", "apart")), strict=True)) == want
    used, size = encodings(f"{tmp_path}/out", "apart")
    assert "DELTA_BINARY_PACKED" in used and size < 3 * len(want)
    # What a job writes after the next one has begun is as ever.
    configure(spark).range(200_000).write.parquet(f"{tmp_path}/other")
    assert "DELTA_BINARY_PACKED" not in encodings(f"{tmp_path}/other", "id")[0]
