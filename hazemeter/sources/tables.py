"""Batches, locations, archives and result tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazemeter.functions.timegrid import bucket_of
from hazemeter.schema import BATCH, LOCATION
from hazemeter.session import exists, folders, remove

# Batches per directory of an archive: one directory per batch
# would leave more directories than data.
BATCHES_PER_FOLDER = 1_000
# Versions a result table may have before the earlier ones become one.
VERSIONS = 16


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Numbered batches at rest (Parquet or JSON)."""
    return spark.read.schema(BATCH).format(fmt).load(path)


def stream_batches(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1
) -> DataFrame:
    """Numbered batches as files arrive, oldest first."""
    return (
        spark.readStream.schema(BATCH).format(fmt)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def load_locations(
    spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """The location table at ``path``, built and stored there on first use.

    No broadcast is forced on it: Spark broadcasts it in a join if the stored
    table is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    try:
        return spark.read.schema(LOCATION).parquet(path)
    except AnalysisException as missing:
        if build is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("ignore").parquet(path)
    return spark.read.schema(LOCATION).parquet(path)


def _folder(seq: Column) -> Column:
    return bucket_of(seq, BATCHES_PER_FOLDER)


def archive_batches(batches: DataFrame, path: str, mode: str = "append") -> None:
    """Stores batches for replay, in folders of consecutive numbers."""
    batches.withColumn("folder", _folder(F.col("seq_id"))).sortWithinPartitions(
        "folder", "seq_id"
    ).write.mode(mode).partitionBy("folder").parquet(path)


def read_archive(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Archived batches ``first`` to ``last``; only their folders are read."""
    out = spark.read.schema(f"{BATCH}, folder BIGINT").parquet(path)
    if first is not None:
        out = out.where((F.col("folder") >= first // BATCHES_PER_FOLDER) & (F.col("seq_id") >= first))
    if last is not None:
        out = out.where((F.col("folder") <= last // BATCHES_PER_FOLDER) & (F.col("seq_id") <= last))
    return out.drop("folder")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """``(number, level)`` of the folders of a result table, in order. One of a level above 0 stands for several up to its number."""
    if not exists(spark, path):
        return []
    names = [f.removeprefix("version=") for f in folders(spark, path) if f.startswith("version=")]
    return sorted(tuple(map(int, n.split("-"))) for n in names if exists(spark, f"{path}/version={n}/_SUCCESS"))


def write_results(
    results: DataFrame, path: str, fmt: str = "parquet", version: int | None = None, versions: int = VERSIONS
) -> None:
    """Appends result rows of many batches as one version of the table at ``path``: a folder, sorted by batch.

    A version replaces what earlier ones say of the batches in it, and says nothing of others. A batch whose result is empty is
    replaced if it occurs with a row of nulls, as ``for_every_batch`` makes them. The next number is taken, or ``version``,
    which is written anew if it is there: so a repeated call changes nothing. Every ``versions`` earlier ones become one, and as many of
    those again, so rows are copied a logarithmic number of times. One job at a time writes to a table.
    """
    known = _versions(results.sparkSession, path)
    number = (known[-1][0] + 1 if known else 0) if version is None else version
    _write_sorted(results, f"{path}/version={number}-0", fmt)
    compact_results(results.sparkSession, path, results.schema, fmt, versions, before=number)


def _write_sorted(rows: DataFrame, path: str, fmt: str) -> None:
    rows.repartitionByRange(F.col("batch_seq_id")).sortWithinPartitions("batch_seq_id").write.mode("overwrite").format(fmt).save(path)


def _latest(rows: DataFrame) -> DataFrame:
    """Of each batch the rows of its last version. The versions of the batches are a row each; rows of one batch meet no others."""
    last = rows.groupBy("batch_seq_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["batch_seq_id", "version"], "left_semi")


def _stored(spark: SparkSession, path: str, schema: StructType, fmt: str, some: list[tuple[int, int]]) -> DataFrame:
    """Rows of some versions, with their place in the order."""
    rows = [
        spark.read.schema(schema).format(fmt).load(f"{path}/version={n}-{level}").withColumn("version", F.lit(i)) for i, (n, level) in enumerate(some)
    ]
    return reduce(DataFrame.unionByName, rows, spark.createDataFrame([], schema).withColumn("version", F.lit(-1)))


def read_results(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", first: int | None = None, last: int | None = None
) -> DataFrame:
    """What the last version of every batch says, for batches ``first`` to ``last``.

    A version is sorted by batch, so files outside the bounds are passed over. A table of one version needs no look at others.
    """
    some = _versions(spark, path)
    rows = _stored(spark, path, spark.createDataFrame([], schema).schema, fmt, some)
    if first is not None:
        rows = rows.where(F.col("batch_seq_id") >= first)
    if last is not None:
        rows = rows.where(F.col("batch_seq_id") <= last)
    return (_latest(rows) if len(some) > 1 else rows).drop("version")


def compact_results(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", versions: int = VERSIONS, before: int | None = None
) -> None:
    """Makes one folder of the next level of every ``versions`` folders of a level (of those before version ``before``).

    A new folder counts once it is complete, and says what those it stands for say; they go after that. A job that ends
    in between leaves a table that reads the same.
    """
    level = 0
    while True:
        some = [v for v in _versions(spark, path) if v[1] == level and (before is None or v[0] < before)]
        if len(some) < versions:
            break
        _write_sorted(_latest(_stored(spark, path, schema, fmt, some)).drop("version"), f"{path}/version={some[-1][0]}-{level + 1}", fmt)
        for n, _ in some:
            remove(spark, f"{path}/version={n}-{level}")
        level += 1


def write_epoch(rows: DataFrame, path: str, epoch: int, *partitions: str) -> None:
    """Rows of one micro-batch; repeating the micro-batch replaces them.

    The epoch is a folder of its own below the ``partitions`` columns.
    """
    rows.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partitions, "epoch").parquet(path)
