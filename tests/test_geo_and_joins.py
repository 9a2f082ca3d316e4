import random

import numpy as np
import pytest

from hazemeter.operators.geo import locate, point_in_polygon, polygon_cells, polygon_rings, ring_edges, with_city
from hazemeter.operators.improve import interval_join, nested_top, top_improvements
from hazemeter.schema import LOCATION
from tests.helpers import rows_of


def location(zipcode, city, *rings):
    return (zipcode, city, 1.0, 0, [([(x, y) for x, y in ring],) for ring in rings])


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
NOTCHED = [(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (6.0, 1.0), (4.0, 4.0)]  # open ring, concave


def test_interior_only_concave_and_several_rings(spark):
    places = spark.createDataFrame([
        location("2", "Square", SQUARE, [(10.0, 10.0), (11.0, 10.0), (10.0, 11.0)]),
        location("1", "Notch", NOTCHED), location("3", "Shadowed", SQUARE),
    ], LOCATION)
    points = {
        (1.0, 1.0): "Square", (0.0, 1.0): None, (2.0, 2.0): None, (1.0, 2.0): None,
        (10.25, 10.25): "Square", (10.5, 10.5): None, (11.0, 11.0): None,
        (6.0, 0.5): "Notch", (6.0, 1.0): None, (6.0, 2.0): None, (4.5, 3.0): "Notch", (7.5, 1.0): "Notch",
        (-1.0, 1.0): None, (3.0, 0.0): None,
    }
    df = spark.createDataFrame([(y, x) for x, y in points], "lat float, lon float")
    got = {(r.lon, r.lat): r.city for r in point_in_polygon(df, places).collect()}
    assert got == {p: c for p, c in points.items() if c}


def test_locate_drops_outside_and_keeps_repeats(spark):
    places = spark.createDataFrame([location("1", "A", SQUARE)], LOCATION)
    rows = [(i, i * 10, "x", 1.0, 1.0) for i in range(100)] + [(100, 0, "x", 50.0, 50.0)]
    readings = spark.createDataFrame(rows, "pos bigint, ts_ms bigint, city string, lat float, lon float")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = locate(readings, places)
        assert got.where("city = 'A'").count() == got.count() == 100
        lookup = point_in_polygon(readings, places)
        assert with_city(readings, lookup).where("city = 'A'").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_small_rings_where_one_large_cell_was(spark):
    """400 small squares and one that holds them all, thousands of points: a point meets few rings."""
    small = [location(f"{i:03}", f"c{i}", [(x := 10 + i % 20 / 100, y := 50 + i // 20 / 100), (x + 0.008, y), (x + 0.008, y + 0.008), (x, y + 0.008)]) for i in range(400)]
    places = spark.createDataFrame([*small, location("999", "all", [(9.0, 49.0), (12.0, 49.0), (12.0, 52.0), (9.0, 52.0)]), location("998", "none", [])], LOCATION).repartition(4)
    points = spark.range(5000).selectExpr("cast(50 + (id % 70) / 350.0 + 0.0003 as float) as lat", "cast(10 + (id div 70) / 360.0 + 0.0003 as float) as lon")
    found = {(r.lat, r.lon): r.city for r in point_in_polygon(points, places).collect()}
    assert len(found) == 5000
    for (lat, lon), city in found.items():
        i, j = int((lon - 10) * 100 + 1e-9), int((lat - 50) * 100 + 1e-9)
        inside = (lon - 10) * 100 - i < 0.8 and (lat - 50) * 100 - j < 0.8 and i < 20 and j < 20
        assert city == (f"c{20 * j + i}" if inside else "all")
    rings = polygon_rings(places)
    assert ring_edges(rings).count() <= 2 * 4 * 401
    assert polygon_cells(rings).count() <= 4 * rings.count() == 4 * 401


@pytest.mark.parametrize("lo, hi", [(0, 0), (-5, 12), (3, 4), (-20, -10), (7, 7)])
def test_interval_join_against_pairs(spark, lo, hi):
    rng = random.Random(lo * 31 + hi)
    rows = lambda: [(rng.choice("ab"), rng.randrange(-60, 60), i) for i in range(80)]
    left, right = rows(), rows()
    schema = "city string, ts_ms bigint, id bigint"
    got = interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["city"], lo, hi)
    want = [
        (c, i, j, u, t) for c, t, i in left for d, u, j in right if c == d and t + lo <= u <= t + hi
    ]
    assert rows_of(got) == sorted(want, key=str)


def test_ranking(spark):
    rows = [(0, c, 0, imp, 1, 2) for c, imp in (("b", 1.5), ("a", 1.5), ("c", -1.0), ("d", 0.0), ("e", 9.0))]
    schema = "seq bigint, city string, ts_ms bigint, improvement double, aqi_p1 int, aqi_p2 int"
    top = top_improvements(spark.createDataFrame(rows, schema), 3)
    assert [(r.position, r.city, r.avg_improvement) for r in top.orderBy("position").collect()] == [
        (1, "e", 9000), (2, "a", 1500), (3, "b", 1500)
    ]
    headers = spark.createDataFrame([(0, 1), (1, 2)], "seq bigint, wm bigint")
    nested = {r.batch_seq_id: [e.city for e in r.topkimproved] for r in nested_top(headers, top).collect()}
    assert nested == {0: ["e", "a", "b"], 1: []}


def test_a_ring_of_very_many_vertices(spark):
    """A star of 100,000 vertices and 10,000 points, beside a square of four."""
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = np.where(np.arange(n) % 2, 0.75, 0.7501) + 0.3 * np.sin(7 * angle)
    x, y = 20 + far * np.cos(angle), 40 + far * np.sin(angle)
    places = spark.createDataFrame([location("1", "star", list(zip(x.tolist(), y.tolist()))), location("2", "square", [(18.0, 38.0), (22.0, 38.0), (22.0, 42.0), (18.0, 42.0)])], LOCATION)
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(18.5, 21.5, 10_000).astype(np.float32), rng.uniform(38.5, 41.5, 10_000).astype(np.float32)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat, lon)], "lat float, lon float").repartition(4)
    rings = polygon_rings(places)
    edges = ring_edges(rings)
    assert edges.count() <= 2 * (n + 4)
    most = edges.groupBy("number", "level", "strip").count().agg({"count": "max"}).first()[0]
    assert most < n / 8  # no strip has many of the edges
    got = {(r.lat, r.lon): r.city for r in point_in_polygon(points, places).collect()}
    assert len(got) == len(set(zip(lat.tolist(), lon.tolist())))
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    for a, b in list(zip(lat.astype(float), lon.astype(float)))[:400]:
        over = (y > a) != (y1 > a)
        hits = b < (x1[over] - x[over]) * (a - y[over]) / (y1[over] - y[over]) + x[over]
        assert got[a, b] == ("star" if hits.sum() % 2 else "square")
