"""Clustering around centroids, with blocks of vectors along a Hilbert curve and a box around each block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import written

DIMENSIONS = 64
#: A component counts in so many parts of one, rounded down.
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Whole numbers are held within this bound, so that distances are exact in 53 bits.
LIMIT = 1 << 22
#: Bits of a component that make its place on the curve.
CURVE_BITS = 4
#: Vectors in a block.
BLOCK = 256


def vectors(table: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``(id, v)`` of the rows that have so many components, none null or not finite: components as whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    kept = table.where((F.size(vector_col) == dimensions) & F.forall(vector_col, finite))
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, whole).alias("v"))


def curve(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``points`` (rows of whole numbers of so many bits) on a Hilbert curve, as rows of bytes whose order is the curve's.

    Skilling's transposition: from the highest bit down, a set bit turns the lower bits of the first axis over, a clear one exchanges
    them with its own axis; a Gray code over the axes follows.
    """
    x = points.astype(np.uint32).T.copy()
    axes = len(x)
    for low in ((1 << k) - 1 for k in range(bits - 1, 0, -1)):
        for i in range(axes):
            turned = (x[i] & (low + 1)) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            x[i] ^= swap.astype(np.uint32) if i else np.uint32(0)
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for low in ((1 << k) - 1 for k in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & (low + 1), low, 0).astype(np.uint32)
    x ^= flip
    planes = np.stack([(x >> k) & 1 for k in range(bits - 1, -1, -1)]).reshape(bits * axes, -1)
    return np.packbits(planes.T.astype(np.uint8), axis=1)


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def blocks(vecs: DataFrame, dimensions: int = DIMENSIONS, size: int = BLOCK) -> DataFrame:
    """``(ids, v, lo, hi)``: vectors in the order of the curve, ``size`` a row, as packed whole numbers, and the box around them.

    Equal vectors are one place on the curve; a row number parts them, so any number of copies is dealt over several tasks.
    """
    ends = vecs.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    low, width = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    kind = vecs.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dimensions).astype(np.int64)
            key = curve(((v - low) << CURVE_BITS) // width, CURVE_BITS) if len(v) else v
            packed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(v.astype("<i4")), packed(key), batch.column(2)], names=["id", "v", "key", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            v += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block(batch.column(0).type, ids[:size], v[:size])
                ids, v = ids[size:], v[size:]
            kept = batch.column(0).type
        if ids:
            yield block(kept, ids, v)

    def block(ids_kind: pa.DataType, ids: list, v: list) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(v), "<i4").reshape(-1, dimensions)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (m, m.min(axis=0), m.max(axis=0))]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(ids_kind)), *packed], names=["ids", "v", "lo", "hi"])

    placed = vecs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, f"id {kind}, v binary, key binary, row long")
    ordered = placed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return ordered.select("id", "v").mapInArrow(cut, f"ids array<{kind}>, v binary, lo binary, hi binary")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be the nearest of some vector in the box from ``lo`` to ``hi``.

    No vector is nearer to a centroid than the box, or farther than its farthest corner: centroids whose box is beyond
    the nearest such corner are out. Those that may tie stay.
    """
    near = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def _assigned(part: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, clusters and squared distances of every block; a smaller number wins a tie."""
    dimensions = centroids.shape[1]
    exact = centroids.astype(np.float64)
    for i in range(len(part)):
        v, lo, hi = (np.frombuffer(part.column(k)[i].as_py(), "<i4").reshape(-1, dimensions).astype(np.float64) for k in (1, 2, 3))
        which = candidates(lo[0], hi[0], exact)
        c = exact[which]
        distance = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        best = distance.argmin(axis=1)
        yield part.column(0)[i].values, v.astype(np.int64), which[best], distance[np.arange(len(v)), best].astype(np.int64)


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the vectors nearest to each centroid: a row per task and cluster, then one per cluster."""
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = held.value
        n, total = np.zeros(len(here), np.int64), np.zeros(here.shape, np.int64)
        for batch in batches:
            for _, v, cluster, _ in _assigned(batch, here):
                n += np.bincount(cluster, minlength=len(here))
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "total": pa.array(list(total[some]), pa.list_(pa.int64())),
        })

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(each.collect()):  # a row per centroid and dimension
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["x"])
    return out


def start(vecs: DataFrame, clusters: int) -> np.ndarray:
    """The vectors of the smallest digests of their ids, in that order; a null id counts as an empty text, equal ids go by their vectors."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vecs.withColumn("digest", digest).orderBy("digest", "v").limit(clusters).select("v").collect()], np.int64)


def clustered(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
    scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector.

    Kept are rows with ``dimensions`` components, none null or not finite; components count as floor(scale * x), held within
    LIMIT. Vectors go to the nearest centroid by squared distance, to the smaller number of equals; centroids then become the
    floored means of their vectors, ``rounds`` times, empty ones staying, and vectors are assigned once more. Fewer
    vectors than ``clusters`` make as many centroids. Repeated rows are vectors of their own. An inertia that no long can
    hold is null. No kept vectors, no rows.

    Vectors are put in order along the curve once. What the driver holds is a row per centroid and dimension.
    """
    vecs = vectors(table, id_col, vector_col, dimensions, scale)
    spark = table.sparkSession
    kind = vecs.schema["id"].dataType.simpleString()
    centroids = start(vecs, clusters)
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = written(blocks(vecs, dimensions), "blocks", compression="zstd")
    for _ in range(rounds):
        for c, (n, total) in _sums(stored, centroids).items():
            centroids[c] = [x // n for x in total]
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in _assigned(batch, held.value):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    last = written(stored.mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    by = {r["cluster"]: int(r["x"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, str(x), str(sum(by.values())), digest[c]) for c, x in by.items()]
    ends = spark.createDataFrame(rows, "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    long = lambda c: F.col(c).try_cast("long").alias(c)
    return last.join(F.broadcast(ends), "cluster").select("id", "cluster", "distance", long("cluster_inertia"), long("inertia"), "centroid_sha256")
