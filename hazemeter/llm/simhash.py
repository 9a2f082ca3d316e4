"""SimHash fingerprints, their near pairs by BK-trees, and the groups those links make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import mapped, written
from hazemeter.llm.components import components

WORDS = 3
RADIUS = 3
#: A fingerprint is cut into so many blocks; RADIUS changed bits leave BLOCKS - RADIUS of them as they were.
BLOCKS = 5
#: Mean number of nodes of a shard tree: about 1 MB, whatever the input.
SHARD = 8192
#: (fingerprint, node) pairs looked at in one step.
STEP = 1 << 18
SEED = 42
BITS = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of ``text`` as a signed integer; 0 for null or no words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False))
    ones, n = np.zeros(BITS, np.int64), 0
    while part := [xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(1 << 16), shingles)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        lambda b: {"id": b.column(0), "fp": pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())},
        f"id {kind}, fp long",
    )


class Forest:
    """BK-trees over several groups of fingerprints, searched together.

    A node's child hangs on an edge labelled with its Hamming distance to the node. Children lie next to each
    other in order of their labels, so the edges a search follows are one range.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray) -> None:
        values, parent, label, roots, edges = points.tolist(), [], [], {}, {}
        for i, (x, g) in enumerate(zip(values, group.tolist(), strict=True)):
            at = roots.setdefault(g, i)
            up, d = -1, 0
            while at != i:
                d = (x ^ values[at]).bit_count()
                up, at = at, edges.setdefault((at, d), i)
            parent.append(up)
            label.append(d)
        parent, label = np.array(parent, np.int64), np.array(label, np.int64)
        self.points, self.roots = points, roots
        self.order = np.lexsort((label, parent))
        #: first[v * (BITS + 2) + d]: where v's children with labels of d and more begin in ``order``.
        wanted = np.arange(len(points) * (BITS + 2))
        self.first = np.searchsorted((parent * (BITS + 2) + label)[self.order], wanted)

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at ``radius`` or fewer bits, along edges whose label lies within the radius of the query's distance."""
        root = np.array([self.roots.get(g, -1) for g in group.tolist()], np.int64)
        stack = [(q, root[q]) for q in np.array_split(np.flatnonzero(root >= 0), max(1, len(root) // 256))]
        while stack:
            q, v = stack.pop()
            if len(q) > STEP:
                half = len(q) // 2
                stack += [(q[:half], v[:half]), (q[half:], v[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.points[v]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], v[near]
            low = self.first[v * (BITS + 2) + np.maximum(d - radius, 0)]
            n = self.first[v * (BITS + 2) + np.minimum(d + radius + 1, BITS + 1)] - low
            if total := int(n.sum()):
                ends = np.cumsum(n)
                child = self.order[np.arange(total) + np.repeat(low - (ends - n), n)]
                stack.append((np.repeat(q, n), child))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after uniting the sets of a[i] and b[i]; the smallest index of a set is its root."""
    while True:
        x, y = root[a], root[b]
        if (open_ := x != y).sum() == 0:
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (root := root[root])).any():
            pass


def _cells(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of whole cells as (cell number, is in the tree, is a query, fingerprint); rows come sorted by cell."""
    kept: list[np.ndarray] = []
    for batch in rows:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
        if not len(now):
            continue
        kept.append(now)
        ends = np.flatnonzero((now[:, :4] != now[-1, :4]).any(axis=1))
        if len(ends):
            yield from _cut(np.concatenate([*kept[:-1], now[: ends[-1] + 1]]))
            kept = [now[ends[-1] + 1 :]]
    if kept:
        yield from _cut(np.concatenate(kept))


def _cut(x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    cell = np.cumsum(np.r_[0, (x[1:, :4] != x[:-1, :4]).any(axis=1)])
    yield cell, x[:, 4] == x[:, 2], x[:, 4] == x[:, 3], x[:, 5].view(np.uint64)


def _near(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each cell: every link's ends are joined by some path, and no cell gives more rows than it has fingerprints."""
    for cell, tree, query, fp in _cells(batches):
        t, q = np.flatnonzero(tree), np.flatnonzero(query)
        root = np.arange(len(fp))
        for i, v in Forest(fp[t], cell[t]).search(fp[q], cell[q], radius):
            root = _joined(root, q[i], t[v])
        linked = np.flatnonzero(root != np.arange(len(fp)))
        if len(linked):
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": signed[linked], "b": signed[root[linked]]})


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(fp)`` that join all pairs at ``radius`` or fewer bits.

    Two such fingerprints agree in ``blocks - radius`` whole blocks. So for every choice of that many blocks,
    fingerprints with equal ones meet and no others do. Where more than ``shard`` meet, they are dealt into
    shards; each shard's tree goes to every block of queries (a cell), and a cell is one bounded piece of work
    for one task. Every fingerprint is searched against every one it meets; the rows given are a spanning
    forest per cell, which keeps all components.
    """
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [
        sum((1 << edge[i + 1]) - (1 << edge[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)
    ]
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = prints.select(
        "fp",
        F.explode(F.array(*(
            F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)
        ))).alias("at"),
    ).select("fp", "at.way", "at.key")
    shared = keyed.groupBy("way", "key").agg(F.count("fp").alias("n")).where("n > 1")
    met = keyed.join(shared, ["way", "key"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    cells = (
        met.select("way", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
        .select("way", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp")
        .repartition("way", "key", "lo", "hi").sortWithinPartitions("way", "key", "lo", "hi")
    )
    return cells.mapInArrow(lambda rows: _near(rows, radius), "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """``(id, fp, component)`` for every row: its fingerprint and the smallest id reachable over links of ``radius`` or fewer bits.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. Texts of
    fewer than ``words`` words are one shingle. Equal fingerprints are one node, so copies cost nothing. Rows
    that share an id are in a group each by their own text. Null ids are never the smallest unless a group has
    no other. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    reached = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, with all their columns."""
    stays = near_groups(docs, id_col, text_col, **how).where(F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["id"]), "left_semi")
