"""Batches of several feeds, released in the order of their numbers while they arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from hazemeter.operators.batches import feed_bounds
from hazemeter.session import configure, folders, remove, temporary_tables, written
from hazemeter.sources.tables import write_epoch


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the stream, made empty if there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release_epoch(arrived: DataFrame, epoch: int, root: str, feed: str, together: bool) -> None:
    """Releases what a micro-batch makes releasable; repeating it changes nothing. A batch without feed or number is none.

    What comes too early is written once, beside the micro-batch it came with. Until it is released only feeds and numbers are
    looked at; a folder goes when nothing in it is waiting.
    """
    spark = configure(arrived.sparkSession)
    arrived = arrived.where(F.col(feed).isNotNull() & F.col("seq_id").isNotNull())
    kind = arrived.schema[feed].dataType.simpleString()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrived.schema)
    due_path, held_path = f"{root}/due", f"{root}/held"
    with temporary_tables(spark):
        states = _read(spark, due_path, f"`{feed}` {kind}, due BIGINT, epoch BIGINT").where(F.col("epoch") < epoch)
        last = states.agg(F.max("epoch")).first()[0]
        due = states.where(F.col("epoch") == F.lit(last)).drop("epoch")
        held = _read(spark, held_path, f"{columns}, epoch BIGINT").where(F.col("epoch") < epoch)
        # a feed that is new begins at 0
        start = F.coalesce("due", F.lit(0).cast("bigint"))
        waiting = held.select(feed, "seq_id", "epoch").join(due, feed, "left").where(F.col("seq_id") >= start)
        numbers = written(
            arrived.select(feed, "seq_id", F.lit(epoch).cast("bigint").alias("epoch")).join(due, feed, "left")
            .where(F.col("seq_id") >= start).drop("due").unionByName(waiting.drop("due")), "numbers",
        )
        bounds = written(feed_bounds(numbers.select(feed, "seq_id").distinct(), due, feed, together), "bounds")
        used = [r[0] for r in numbers.where(F.col("epoch") < epoch).select("epoch").distinct().collect()]  # a row per folder
        inbox = arrived.unionByName(held.where(F.col("epoch").isin(used)).drop("epoch")).join(bounds, feed)
        free = inbox.where((F.col("seq_id") >= F.col("first")) & (F.col("seq_id") < F.col("end")))
        write_epoch(free.select(*arrived.columns).dropDuplicates([feed, "seq_id"]), f"{root}/released", epoch)
        early = arrived.join(bounds, feed).where(F.col("seq_id") >= F.col("end"))
        write_epoch(early.select(*arrived.columns), held_path, epoch)
        write_epoch(bounds.select(feed, F.col("end").alias("due")), due_path, epoch)
        for folder in folders(spark, held_path):
            at = folder.removeprefix("epoch=")
            if at.isdigit() and int(at) < epoch and int(at) not in used:
                remove(spark, f"{held_path}/{folder}")
        if last is not None:
            for folder in folders(spark, due_path):
                at = folder.removeprefix("epoch=")
                if at.isdigit() and int(at) < last:
                    remove(spark, f"{due_path}/{folder}")


def run_release(batches: DataFrame, root: str, feed: str = "feed", together: bool = False) -> StreamingQuery:
    """Starts the release of a stream of numbered batches, which goes on where an earlier call with the same ``root`` ended.

    Each feed's batches are released in order, without a gap. With ``together`` no feed gets ahead of another: number n
    goes when every feed that has shown up has its numbers up to n. Released batches are below ``root``/released.
    """
    return (
        batches.writeStream.foreachBatch(partial(release_epoch, root=root, feed=feed, together=together))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )


def released(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """What has been released so far of batches of a ``schema``, with the ``epoch`` that did."""
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(f"{root}/released")
