import pytest

from hazemeter.operators.slices import slice_densify, slice_sums
from hazemeter.operators.streaks import good_streak, streak_at_watermark, streak_histogram
from hazemeter.operators.windows import aqi5d, aqi24_all, aqi24_at_watermark, aqi24_snapshots, sliding_aqi
from hazemeter.params import DAY, MINUTE, Params
from tests.helpers import PROBE, READING, as_df, index_of_means, random_readings

PARAMS = Params(step_ms=60_000, window_ms=600_000, mean_ms=1_200_000, active_ms=120_000)

# Arrivals of the 24-hour stage in seconds, per city, "W" marks probes.
ARRIVALS = (
    "P3 B99 B200 P250 B300 WB300 WP300 B511 WP600 WB600 WB950 B1501 P1531 B1601 B1001 P1561 B1551 "
    "B1611 WP1900 WB1900 B1611 B2001! P2000 P2100 P2030 P2110 P1999 P2000 WP2200 WB2200 B2201 WB2900"
)
# Expected values; "w" marks watermark values, "*" those with one huge P1.
EXPECTED = (
    "B300w P300w P600w B600w B900 B950w P1800 P1900w B1200 B1500 B1800 B1900w P2100 P2200w B2100* "
    "B2200w* B2400* B2700*"
)


def golden():
    """Readings and probes with one batch per run of probes."""
    readings, probes, seq, asked = [], [], 0, False
    for pos, item in enumerate(ARRIVALS.split()):
        probe = item.startswith("W")
        if asked and not probe:
            seq += 1
        asked = probe
        city, rest = item.lstrip("W")[0], item.lstrip("W")[1:]
        ts = int(rest.rstrip("!")) * 1000
        if probe:
            probes.append((seq, ts, city, "current"))
        else:
            readings.append((seq, pos, city, "current", ts, 1e8 if rest.endswith("!") else 1.0, 2.0))
    return readings, probes


def test_golden_24h_stage(spark):
    from hazemeter.operators.probes import arrivals, drop_late, late_bounds

    rows, asked = golden()
    readings, probes = spark.createDataFrame(rows, READING), spark.createDataFrame(asked, PROBE)
    kept = drop_late(readings, late_bounds(arrivals(readings), probes))
    assert kept.count() == len(rows) - 1
    slices = slice_sums(kept)
    values = aqi24_all(aqi24_snapshots(slices), aqi24_at_watermark(kept, slices, probes))
    last = {"B": 2_900_000, "P": 2_200_000}
    got = {
        (r.city, r.ts_ms // 1000, r.is_probe): (r.aqi, r.aqi_p1, r.aqi_p2)
        for r in values.collect() if r.ts_ms <= last[r.city]
    }
    want = {}
    for item in EXPECTED.split():
        name = item.rstrip("*").rstrip("w")
        key = (name[0], int(name[1:]), "w" in item)
        want[key] = (999, 999, 8) if item.endswith("*") else (8, 1, 8)
    assert {k: got[k] for k in want} == want
    assert sorted(set(got) - set(want)) == [(c, t, False) for c in "BP" for t in (300, 600)]


def test_golden_slice_sums(spark):
    seconds = [(3, 1.0), (250, 1.0), (350, 1000.0), (650, 1000.0), (1100, 1.0), (1400, 1.0), (1700, 1.0)]
    rows = [(0, i, "B", "current", s * 1000, p, 0.0) for i, (s, p) in enumerate(seconds)]
    slices = slice_sums(spark.createDataFrame(rows, READING))
    per_slice = {r.slice_end // 1000: (int(r.s1), r.n) for r in slices.collect()}
    window = lambda end: tuple(
        sum(x) for x in zip(*[v for e, v in per_slice.items() if end - 900 < e <= end])
    )
    assert [window(e) for e in (900, 1200, 1500)] == [(2002, 4), (2001, 3), (1002, 3)]


def test_golden_5d(spark):
    params = Params(mean_ms=15 * MINUTE)
    one = [(s * 1000, a) for s, a in ((300, 1), (600, 3), (900, 5), (1200, 1), (1500, 3))]
    snapshots = spark.createDataFrame(
        [("B", "current", t, a, 0, 0) for t, a in one], "city string, period string, ts_ms bigint, aqi int, aqi_p1 int, aqi_p2 int"
    )
    asked = spark.createDataFrame(
        [(i, "B", "current", s * 1000, 7, 3, 4) for i, s in enumerate((600, 950, 1250, 1850, 2500))],
        "seq bigint, city string, period string, ts_ms bigint, aqi int, aqi_p1 int, aqi_p2 int",
    )
    got = [r.aqi for r in aqi5d(snapshots, asked, params).orderBy("seq").collect()]
    assert got == [2.0, 3.0, 3.0, 2.0, 7.0]  # the last has no snapshot in reach


def test_golden_5d_cold_start(spark):
    cases = [("P", 8000, 1), ("B", 16000, 1), ("P", 16000, 1), ("P", 24000, 4), ("B", 24000, 1), ("B", 36000, 4)]
    schema = "seq bigint, city string, period string, ts_ms bigint, aqi int, aqi_p1 int, aqi_p2 int"
    asked = spark.createDataFrame([(0, c, "current", t * 1000, a, 0, 0) for c, t, a in cases], schema)
    got = {(r.city, r.ts_ms // 1000): r.aqi for r in aqi5d(asked.where("seq > 0").drop("seq"), asked).collect()}
    assert got == {(c, t): float(a) for c, t, a in cases}


def test_golden_streak(spark):
    cases = [("P", 8000), ("P", 16000), ("P", 24000), ("B", 16000), ("B", 24000), ("B", 36000)]
    schema = "seq bigint, city string, period string, ts_ms bigint, aqi int, aqi_p1 int, aqi_p2 int, is_probe boolean"
    values = spark.createDataFrame([(i, c, "current", t, 3, 0, 0, True) for i, (c, t) in enumerate(cases)], schema)
    got = {(r.city, r.ts_last): r.good_since for r in streak_at_watermark(values).collect()}
    assert got == {(c, t): 8000 if c == "P" else 16000 for c, t in cases}


@pytest.mark.parametrize("seed", [11, 12])
def test_windows_against_raw_readings(spark, seed):
    rows = random_readings(seed, n=300)
    readings, step = as_df(spark, rows), PARAMS.step_ms
    asked = [
        {"seq": i, "wm": wm, "city": c, "period": p}
        for i, wm in enumerate([0, 61_000, 600_000, 777_777, 1_500_000, 1_500_000, 2_999_999, 9_000_000])
        for c in ("hot", "c0", "c1", "nowhere") for p in ("current", "lastyear")
    ]
    slices = slice_sums(readings, PARAMS)
    key = lambda r: (r["city"], r["period"])

    def inside(k, lo, hi):
        return [r for r in rows if key(r) == k and lo <= r["ts_ms"] < hi]

    want = set()
    for r in rows:
        for e in (r["ts_ms"] - r["ts_ms"] % step + step, r["ts_ms"] - r["ts_ms"] % step + 2 * step):
            want.add((*key(r), e, *index_of_means(inside(key(r), e - PARAMS.window_ms, e))))
    snapshots = aqi24_snapshots(slices, PARAMS)
    got = {(r.city, r.period, r.ts_ms, r.aqi, r.aqi_p1, r.aqi_p2) for r in snapshots.collect()}
    assert got == want and snapshots.count() == len(want)

    want = set()
    for p in asked:
        window = inside(key(p), p["wm"] - PARAMS.window_ms, p["wm"])
        seen = [r for r in rows if key(r) == key(p) and r["seq"] <= p["seq"]]
        if inside(key(p), p["wm"] - PARAMS.active_ms, p["wm"]):
            want.add((p["seq"], *key(p), p["wm"], *index_of_means(window)))
        if not seen:
            want.add((p["seq"], *key(p), p["wm"], -1, 0, 0))
    at = aqi24_at_watermark(readings, slices, as_df(spark, asked, PROBE), PARAMS)
    got = [(r.seq, r.city, r.period, r.ts_ms, r.aqi, r.aqi_p1, r.aqi_p2) for r in at.collect()]
    assert len(got) == len(want) and set(got) == want

    snaps = snapshots.collect()
    for r in aqi5d(snapshots, at, PARAMS).collect():
        mine = [s.aqi for s in snaps if (s.city, s.period) == (r.city, r.period)
                and r.ts_ms - PARAMS.mean_ms < s.ts_ms <= r.ts_ms]
        own = [g[4] for g in got if g[:3] == (r.seq, r.city, r.period)]
        assert r.aqi == (sum(mine) / len(mine) if mine else float(own[0]))


def test_streaks_against_a_walk(spark):
    import random

    rng, rows = random.Random(5), []
    for city in ("a", "b"):
        t = 0
        for i in range(120):
            t += rng.choice([0, MINUTE, DAY // 3, DAY * 2])
            rows.append((i, city, "current", t, 0, 0, 0, True))
    aqi = {}
    for i, r in enumerate(rows):  # equal times carry equal values
        aqi.setdefault((r[1], r[3]), rng.choice([10, 20, 49, 50, 51, 300, -1]))
    rows = [(*r[:4], aqi[(r[1], r[3])], *r[5:]) for r in rows]
    schema = "seq bigint, city string, period string, ts_ms bigint, aqi int, aqi_p1 int, aqi_p2 int, is_probe boolean"
    values = spark.createDataFrame(rows, schema)
    want, since = set(), {}
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        good = 0 <= r[4] <= 50
        since[r[1]] = (since.get(r[1]) if since.get(r[1]) is not None else r[3]) if good else None
        want.add((r[0], r[1], r[3], since[r[1]]))
    got = good_streak(values)
    assert {(r.seq, r.city, r.ts_ms, r.good_since) for r in got.collect()} == want


def test_histogram_counts_every_city_once(spark):
    params = Params(histogram_origin_ms=0)
    wm = 30 * DAY
    streaks = spark.createDataFrame(
        [(0, "a", wm, None), (0, "b", wm, wm - DAY), (0, "c", wm, 0), (1, "a", 14, None)],
        "seq bigint, city string, ts_last bigint, good_since bigint",
    )
    headers = spark.createDataFrame([(0, wm), (1, 14), (2, wm), (3, None)], "seq bigint, wm bigint")
    got = streak_histogram(headers, streaks, params).collect()
    by = {(r.batch_seq_id, r.bucket_from): r.bucket_percent for r in got if r.bucket_percent}
    half = DAY // 2
    assert by == {(0, 0): 333, (0, 2 * half): 333, (0, 13 * half): 333, (1, 0): 1000}
    assert len(got) == 3 * 14
    capped = streak_histogram(headers, streaks, Params(histogram_origin_ms=0, legacy_overflow=True))
    assert sum(r.bucket_percent for r in capped.where("batch_seq_id = 0").collect()) == 666


def test_dense_slices_and_custom_window(spark):
    rows = [(0, 0, "a", "current", 0, 1.0, 1.0), (0, 1, "a", "current", 16 * MINUTE, 1.0, 1.0)]
    readings = spark.createDataFrame(rows, READING)
    dense = slice_densify(slice_sums(readings)).orderBy("slice_end").collect()
    assert [(r.slice_end // MINUTE, r.n) for r in dense] == [(5, 1), (10, 0), (15, 0), (20, 1)]
    ends = [r.ts_ms // MINUTE for r in sliding_aqi(readings, 30 * MINUTE, 15 * MINUTE, MINUTE).orderBy("ts_ms").collect()]
    assert ends == [1, 16, 31, 46]
