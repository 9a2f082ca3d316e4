"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazemeter.session import configure, counted, written

#: Rows handed to Python at once; texts can be long, so far fewer than Spark's own 10,000.
BATCH_ROWS = "1000"

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither letters nor digits.
ASCII_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any non-ASCII characters, in order; null and empty texts have none."""
    plain = F.translate(text, UPPER + ASCII_OTHER, LOWER + " " * len(ASCII_OTHER))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " +"), "")


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; it returns the columns of ``schema``, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


__all__ = ["ASCII_OTHER", "LOWER", "SPACES", "UPPER", "counted", "mapped", "prepared", "table", "whole_words", "written"]
