"""Centroid clustering against plain loops and SQL."""

import hashlib
import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from hazemeter.llm import centroids

duckdb = pytest.importorskip("duckdb")


def plain(rows, dimensions, clusters, rounds, scale=64):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda: [min(range(len(means)), key=lambda c: (far(v, means[c]), c)) for _, v in kept]
    for _ in range(rounds):
        got = nearest()
        for c in set(got):
            mine = [v for (_, v), g in zip(kept, got, strict=True) if g == c]
            means[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = nearest()
    cost = [far(v, means[c]) for (_, v), c in zip(kept, got, strict=True)]
    sums = [sum(d for d, c in zip(cost, got, strict=True) if c == k) for k in range(len(means))]
    return sorted((str(i), c, d, sums[c], sum(cost), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, got, cost, strict=True))


def found(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


@pytest.mark.parametrize(("seed", "size", "clusters"), [(1, 4, 5), (2, 256, 16), (3, 1, 3)])
def test_clusters(spark, monkeypatch, seed, size, clusters):
    """Clouds, ties, many copies, odd vectors, ids that repeat or are null."""
    monkeypatch.setattr(centroids.blocks, "__defaults__", (64, size))
    rng = random.Random(seed)
    cloud = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in cloud[i % 4]]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5]) for i in range(60)] + [(7, [0.0, -0.0, 0.25])] * 3 + [(None, [1.0, 2.0, 3.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, 2.0, 3.0, 4.0]), (904, [1.0, None, 2.0]), (905, [1.0, float("nan"), 2.0]), (906, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, row int").repartition(5)
    got = centroids.clustered(table, dimensions=3, clusters=clusters, rounds=3)
    assert found(got) == plain(rows, 3, clusters, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [-0.3, 7.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(centroids.clustered(table, dimensions=2)) == plain(rows, 2, 16, 3)
    for none in (table.limit(0), table.where("vec_id = 1").selectExpr("vec_id", "cast(null as array<float>) as embedding")):
        empty = centroids.clustered(none, dimensions=2)
        assert empty.count() == 0 and empty.columns == centroids.clustered(table, dimensions=2).columns


def test_huge_components_are_held_within_the_limit(spark):
    table = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>")
    rows = centroids.clustered(table, dimensions=2, clusters=1, rounds=0).collect()
    assert sorted(r["distance"] for r in rows) == [0, 4 * centroids.LIMIT**2]


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_goes_from_neighbour_to_neighbour(axes, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
    keys = centroids.curve(cells, bits)
    path = cells[sorted(range(len(cells)), key=lambda i: bytes(keys[i]))]
    assert len({bytes(k) for k in keys}) == len(cells)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_box_bounds_keep_every_nearest_centroid():
    rng = np.random.default_rng(3)
    pruned = 0
    for _ in range(200):
        v = rng.integers(-20, 20, (6, 4)) // rng.integers(1, 9)
        c = rng.integers(-20, 20, (8, 4))
        kept = centroids.candidates(v.min(axis=0), v.max(axis=0), c)
        assert set(((v[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)) <= set(kept)
        pruned += len(c) - len(kept)
    assert pruned > 200


def test_registered_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{os.path.join(sf_dir, 'embeddings.parquet')}'")
    got = entry.queries()["op12_centroid_clustering"](spark, sf_dir)
    want = con.sql(entry.oracle_sql()["op12_centroid_clustering"])
    assert got.columns == want.columns
    assert found(got) == sorted((str(r[0]), *r[1:]) for r in want.fetchall())
