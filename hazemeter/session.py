"""Session settings and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Hadoop's name for the version of the Parquet files written.
FILE_VERSION = "parquet.writer.version"


def configure(spark: SparkSession) -> SparkSession:
    """Applies the run-time settings every job here relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.unset(FILE_VERSION)
    return spark


def stored_by_differences(spark: SparkSession) -> SparkSession:
    """Until the next ``configure``, Parquet written in this session holds numbers too many for a dictionary by their differences.

    That is version 2 of the files. It is for results far larger than their input whose rows come in order.
    """
    spark.conf.set(FILE_VERSION, "v2")
    return spark


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a folder of its own, because there one machine is the cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="hazemeter-")
    return _own_folders[application]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system Spark can reach, if it is there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of any file system Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [f.getPath().getName() for f in found if f.isDirectory()]


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables written inside, at its end. What is to be kept must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder, with the writer's ``options``, and reads it back.

    Used where one intermediate result feeds several branches of a plan: the
    table cuts the lineage, survives lost executors, and gives the optimizer the
    real size, so that it broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return counted(df, name, **options)[0]


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more, before its scope ends."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def together(*jobs: Callable[[], T]) -> list[T]:
    """Results of jobs that do not need each other, run side by side with the caller's local properties."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def counted(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, int]:
    """``written``, with the number of rows seen while writing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]
