"""Pairs of an interval join come out by the times of their rows, so a result far larger than its input is stored in few bytes."""

import random
from itertools import groupby

import pytest

from hazemeter.operators import improve
from hazemeter.operators.improve import interval_join
from hazemeter.plans.catalog import QUERIES
from tests.helpers import rows_of

SCHEMA = "city string, ts_ms bigint, id bigint"


def pairs_of(left, right, lo, hi):
    return [(c, i, j, u, t) for c, t, i in left for d, u, j in right if None not in (c, t, u) and c == d and t + lo <= u <= t + hi]


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_chunks_lose_and_repeat_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(improve, "CHUNK", chunk)
    monkeypatch.setattr(improve, "TASK_ROWS", 20)
    rng = random.Random(chunk)
    rows = lambda: [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-40, 41, 4)]), i % 70) for i in range(90)]
    left, right = rows(), rows()
    got = interval_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["city"], -9, 16, rows=180)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert rows_of(got) == sorted(pairs_of(left, right, -9, 16), key=str)


def test_keys_alone_and_odd_keys(spark):
    left = spark.createDataFrame([(0.0, 5), (-0.0, 6), (float("nan"), 5), (1.0, 5), (1.0, 5)], "k double, ts_ms bigint")
    right = spark.createDataFrame([(-0.0, 7), (float("nan"), 8), (1.0, 4), (1.0, 100)], "k double, ts_ms bigint")
    got = interval_join(left, right, ["k"], -1, 3)
    want = [(-0.0, 7, 6), (0.0, 7, 5), (float("nan"), 8, 5), (1.0, 4, 5), (1.0, 4, 5)]
    assert list(map(str, rows_of(got))) == sorted(map(str, want))


def test_pairs_of_two_times_lie_together(spark):
    """Left rows of few times among each other, right ones likewise: a run for every two times that meet."""
    n = 600
    side = spark.range(n).selectExpr("'a' as city", "(id * 7919 % 6) * 10 as ts_ms", "id").repartition(3)
    got = interval_join(side, side, ["city"], -100, 1_000).collect()
    assert len(got) == n * n
    runs = [k for k, _ in groupby((r["ts_ms"], r["r_ts_ms"]) for r in got)]
    assert len(runs) <= 6 * 6 * 9  # two buckets, and a time cut in two, at most


def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = QUERIES["interval_join_range"](spark, sf_dir)
    monkeypatch.setattr(improve, "TASK_ROWS", 50)
    many = QUERIES["interval_join_range"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in plan(many) and "REPARTITION_BY_NUM" not in plan(few)
    assert rows_of(many) == rows_of(few)
