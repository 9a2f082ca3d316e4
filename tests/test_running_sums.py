"""Running sums by whole numbers, and what is no longer done for rows of one block."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from hazemeter.functions import sums
from hazemeter.operators.scan import before, one_block, with_block_carry
from hazemeter.operators.slices import slice_sums
from hazemeter.operators.streaks import good_streak
from hazemeter.operators.windows import aqi5d, aqi24_snapshots
from tests.helpers import READING, as_df, random_readings
from tests.test_ingest import plan_of


def test_sums_are_whole_numbers_and_nearest_to_the_exact_sum(spark):
    rng = random.Random(3)
    groups = {str(g): [rng.choice([1, -1]) * 10 ** rng.uniform(-9, top) for _ in range(60)] for g, top in enumerate([1, 4, 6.8, 7, 9, 14.9])}
    rows = [(0, i, g, "current", 0, v, -v) for g, values in groups.items() for i, v in enumerate(values)]
    slices = slice_sums(spark.createDataFrame(rows, READING))
    assert {t for c, t in slices.dtypes if c in sums.SUMS} == {"bigint"}
    for r in slices.select("*", F.expr(sums.nearest(1)).alias("d1"), F.expr(sums.nearest(2)).alias("d2")).collect():
        want = sum(round(Decimal(v), 9) for v in groups[r.city])
        assert (r.s1, r.s2, r.d1, r.d2) == (want, -want, float(want), float(-want))
        assert max(map(abs, (r.o1, r.r1, r.o2, r.r2))) < sums.BASE


def test_running_sums_have_no_decimals_and_means_no_join(spark):
    slices = slice_sums(as_df(spark, random_readings(1))).drop("s1", "s2")
    snapshots = aqi24_snapshots(slices)
    windows = [line for line in plan_of(snapshots) if "Window" in line]
    assert len(windows) == 1 and "decimal" not in windows[0]
    asked = snapshots.withColumn("seq", F.lit(0).cast("bigint"))
    assert not any("Join" in line for line in plan_of(aqi5d(snapshots, asked)))
    assert sum("Window" in line for line in plan_of(good_streak(snapshots))) <= 3


def test_rows_of_one_block_are_not_joined_with_its_totals(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 2, 3), (None, 2, 3)], "k string, seq long, v long")
    block = F.floor(F.col("seq") / 8)
    assert one_block(rows, block) and not one_block(rows, F.col("seq"))
    carried = [
        with_block_carry(rows, ["k"], block, {"most": F.max("v")}, {"carry": lambda w: F.max("most").over(before(w))}, alone=alone)
        for alone in (False, True)
    ]
    assert carried[0].schema["carry"].dataType == carried[1].schema["carry"].dataType
    assert sorted(map(tuple, carried[0].collect())) == sorted(map(tuple, carried[1].select(carried[0].columns).collect()))
    assert [any("Join" in line for line in plan_of(df)) for df in carried] == [True, False]
