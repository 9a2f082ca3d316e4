import pytest

from hazemeter.operators import batches as B
from hazemeter.operators import probes as P
from hazemeter.params import Params
from tests.helpers import READING, as_df, kept_of, probes_of, random_readings, rows_of

PARAMS = Params(step_ms=60_000, window_ms=600_000, mean_ms=1_200_000, active_ms=120_000)


def run(spark, rows):
    readings = as_df(spark, rows)
    headers, arrived = B.flat_headers(readings), P.arrivals(readings)
    probes = P.active_probes(arrived, headers, PARAMS)
    late = P.late_bounds(arrived, probes, PARAMS)
    return probes, P.drop_late(readings, late)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_probes_and_late_readings_against_definition(spark, monkeypatch, seed):
    for module in (B, P):
        monkeypatch.setattr(module, "SEQ_BLOCK", 3)
    rows = random_readings(seed)
    probes, kept = run(spark, rows)
    want = probes_of(rows, PARAMS.active_ms)
    assert rows_of(probes) == sorted(((p["city"], p["period"], p["seq"], p["wm"]) for p in want), key=str)
    left = kept_of(rows, want, PARAMS.step_ms)
    assert 0 < len(left) < len(rows)
    assert sorted(r.pos for r in kept.select("pos").collect()) == sorted(r["pos"] for r in left)


def test_clock_ahead_keeps_a_city_active(spark):
    rows = [(0, 0, "a", "current", 900_000, 1.0, 1.0), (0, 1, "b", "current", 1_000, 1.0, 1.0)]
    rows += [(s, s + 1, "b", "current", s * 100_000, 1.0, 1.0) for s in range(1, 20)]
    readings = spark.createDataFrame(rows, READING)
    got = P.active_probes(P.arrivals(readings), B.flat_headers(readings), PARAMS)
    assert [r.seq for r in got.where("city = 'a'").orderBy("seq").collect()] == list(range(0, 11))
    assert got.where("city = 'b'").count() == 20
