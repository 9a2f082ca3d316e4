"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hazemeter.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, ``root`` being the smallest node it reaches.

    A round hangs every larger neighbour of a node below the smallest one (large star), then every
    smaller neighbour (small star). Minima are aggregates and the rows they apply to come by a join, so a
    node with very many neighbours is never gathered in one place. Each round is a written table, which
    cuts the lineage; rounds end when a table equals the one before.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = _round(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        edges, now = _round(small)
        if now == before:
            break
        before = now
    # One star per component is left, and its centre is the smallest node.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with a digest of them."""
    seen = Observation()
    edges = written(edges.observe(seen, F.count("u").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return edges, (seen.get["n"], seen.get["x"])
