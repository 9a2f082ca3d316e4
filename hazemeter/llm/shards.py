"""Contiguous shards of equal bytes, cut by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import written

SHARDS = 8


def byte_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row, with the whole row as ``doc`` if ``carry``.

    Rows are taken in order of their id (nulls first, ties by checksum and size). ``size`` is the text's UTF-8 bytes
    plus 1; null counts as empty. Total bytes are cut at equal targets, and a row goes where its middle byte lies: no
    cut is off its target by more than half a row. ``slot`` numbers the rows of a shard from 0.

    Range partitioning orders the rows. Each partition gives two totals, and their running sums (one row per
    partition, however many rows) are where the sums within partitions start. An id that very many rows share is spread by
    checksum and, of equal rows, by row number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"), *[F.struct("*").alias("doc")] * carry,
    )
    order = ["id", "text_crc32", "size", "row"]
    blocks = written(rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "blocks")
    so_far = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("size").alias("n"))
    starts = totals.select(
        "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n")
    )
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    numbered = blocks.join(starts, "block").select(
        "id", "size", "text_crc32", *["doc"] * carry,
        (F.col("bytes") + F.coalesce(F.sum("size").over(so_far), F.lit(0))).alias("before"),
        (F.col("n") + F.count("size").over(so_far)).alias("nth"),
    )
    cut = written(numbered.withColumn("shard", F.expr(f"(2 * before + size) * {shards} div (2 * {total})").cast("int")), "cut")
    first = cut.groupBy("shard").agg(F.min("nth").alias("first"))
    # One row per shard.
    return cut.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"), *["doc"] * carry)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of ``docs`` as Parquet, a folder per shard, with their ``slot``."""
    cut = byte_shards(docs, shards, id_col, text_col, carry=True)
    cut.select("doc.*", F.col("slot").alias("shard_slot"), F.col("shard").alias("shard_number")).write.partitionBy("shard_number").parquet(path)
