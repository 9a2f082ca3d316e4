"""Batches of several feeds, released in order while they arrive, against the batch form."""

import os
import random

from pyspark.sql import functions as F

from hazemeter.operators.batches import ordered_prefix
from hazemeter.streaming import feeds
from tests.helpers import rows_of

SCHEMA = "feed string, seq_id bigint, v bigint"


def test_stream_releases_what_a_batch_job_would(spark, tmp_path):
    """Feeds in shuffled order with gaps and repeats; an epoch that is repeated; what waits is written once."""
    rng = random.Random(2)
    rows = [(f, s, 10 * s) for f, n in (("a", 9), ("b", 6), ("c", 4), (None, 2)) for s in range(n)]
    rng.shuffle(rows)
    rows = [r for r in rows if r[:2] not in (("b", 4),)]
    parts = [rows[i::4] for i in range(4)]
    parts[2] += parts[0][:2]  # once more
    out = {False: f"{tmp_path}/own", True: f"{tmp_path}/together"}
    so_far = []
    for epoch, part in enumerate(parts):
        so_far += part
        df = spark.createDataFrame(part, SCHEMA).coalesce(2)
        all_df = spark.createDataFrame(sorted(set(so_far), key=str), SCHEMA)
        for together, root in out.items():
            before = {f for _, _, names in os.walk(f"{root}/held") for f in names if f.endswith(".parquet")}
            for _ in range(1 + (epoch == 1)):
                feeds.release_epoch(df, epoch, root, "feed", together)
            after = {f for _, _, names in os.walk(f"{root}/held") for f in names if f.endswith(".parquet")}
            assert len(after - before) <= 2 + (epoch == 0)
            known = all_df.where("feed is not null")
            want = rows_of(ordered_prefix(known, feed="feed"))
            if together:
                ends = {f: sum(r[0] == f for r in want) for f in {r[0] for r in so_far if r[0]}}
                want = [r for r in want if r[1] < min(ends.values())]
            got = feeds.released(spark, root, all_df.schema).drop("epoch").where("feed is not null")
            assert rows_of(got) == want
    assert feeds.released(spark, out[False], all_df.schema).where("feed = 'b'").agg(F.max("seq_id")).first()[0] == 3
