"""Small data builders and plain-Python definitions to check against."""

from __future__ import annotations

import math
import random

import numpy as np

from hazemeter.functions.aqi import PM10_BREAKPOINTS, PM25_BREAKPOINTS

READING = "seq BIGINT, pos BIGINT, city STRING, period STRING, ts_ms BIGINT, p1 DOUBLE, p2 DOUBLE"
PROBE = "seq BIGINT, wm BIGINT, city STRING, period STRING"


def rows_of(df):
    """Rows as sorted tuples, columns by name."""
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def index(value, breakpoints):
    value = np.float32(value)
    if value <= np.float32(breakpoints[0][0]):
        return breakpoints[0][1]
    for (x0, y0), (x1, y1) in zip(breakpoints, breakpoints[1:]):
        x0, x1 = np.float32(x0), np.float32(x1)
        if value <= x1:
            slope = np.float32(y1 - y0) / (x1 - x0)
            return math.floor(float(slope * (value - x0) + np.float32(y0)) + 0.5)
    return breakpoints[-1][1]


def index_of_means(readings):
    """(aqi, p1 index, p2 index) of reading dicts."""
    n = len(readings)
    m1 = np.float32(sum(round(r["p1"] * 10000) for r in readings) / 10000.0 / n)
    m2 = np.float32(sum(round(r["p2"] * 10000) for r in readings) / 10000.0 / n)
    a1 = index(np.float32(math.floor(m1)), PM10_BREAKPOINTS)
    tenths = np.float32(math.floor(m2 * np.float32(10))) / np.float32(10)
    a2 = index(tenths, PM25_BREAKPOINTS)
    return max(a1, a2), a1, a2


def random_readings(seed, n=400, cities=3, span=3_000_000, batches=12, hot=0.4):
    """Readings over a few cities, one of which holds a large share; times jitter."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        city = "hot" if rng.random() < hot else f"c{rng.randrange(cities)}"
        base = span * i // n
        rows.append({
            "seq": i * batches // n, "pos": i, "city": city,
            "period": rng.choice(["current", "lastyear"]),
            "ts_ms": max(0, base + rng.randrange(-120_000, 120_000)),
            "p1": round(rng.random() ** 3 * 300, 2), "p2": round(rng.random() ** 3 * 80, 2),
        })
    return rows


def as_df(spark, rows, schema=READING):
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def headers_of(rows):
    """{seq: watermark} from the last-positioned current reading, else the last of all."""
    out = {}
    for seq in {r["seq"] for r in rows}:
        mine = [r for r in rows if r["seq"] == seq]
        now = [r for r in mine if r["period"] == "current"] or mine
        out[seq] = max(now, key=lambda r: r["pos"])["ts_ms"]
    return out


def advancing_of(headers):
    best, out = None, {}
    for seq in sorted(headers):
        if best is None or headers[seq] >= best:
            best = headers[seq]
            out[seq] = best
    return out


def probes_of(rows, active):
    heads = advancing_of(headers_of(rows))
    keys = {(r["city"], r["period"]) for r in rows}
    out = []
    for seq, wm in heads.items():
        for city, period in keys:
            seen = [r["ts_ms"] for r in rows if (r["city"], r["period"]) == (city, period) and r["seq"] <= seq]
            if seen and max(seen) >= wm - active:
                out.append({"seq": seq, "wm": wm, "city": city, "period": period})
    return out


def kept_of(rows, probes, step):
    out = []
    for key in {(r["city"], r["period"]) for r in rows}:
        mine = [r for r in rows if (r["city"], r["period"]) == key]
        first = min(mine, key=lambda r: (r["seq"], r["pos"]))["ts_ms"]
        for r in mine:
            asked = [p["wm"] for p in probes if (p["city"], p["period"]) == key and p["seq"] < r["seq"]]
            if r["ts_ms"] >= max([first - first % step, *asked]):
                out.append(r)
    return out
