"""Interval joins of two streams whose state the engine keeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hazemeter.functions.timegrid import bucket_of
from hazemeter.operators.improve import interval_join

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a key within a share of the interval are kept as state, and meet, together: so many at most.
CHUNK, SHARES = 1024, 8
#: Rows a task holds before it makes chunks of them.
HELD = 1 << 17


@contextmanager
def _state_in(spark: SparkSession, provider: str) -> Iterator[None]:
    """Queries started inside keep their state with ``provider``; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _chunks(side: DataFrame, on: Sequence[str], ts: str, event_time: str, width: int) -> DataFrame:
    """``(on, bucket, event_time, rows)``: rows of one key, bucket of ``width`` and share of it, by time; the event time is their latest."""
    others = [c for c in side.columns if c not in on]
    known = side.where(" and ".join(f"`{c}` is not null" for c in (*on, ts)))
    known = known.withColumn("bucket", bucket_of(F.col(ts), width))
    known = known.withColumn("share", F.floor((F.col(ts) - F.col("bucket") * width) / -(-width // SHARES)).cast("int"))
    keys = [*on, "bucket", "share"]
    made = T.StructType([*(known.schema[c] for c in (*on, "bucket", event_time)), T.StructField("rows", T.ArrayType(T.StructType([side.schema[c] for c in others])))])

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (*keys, ts)])).combine_chunks()
        whole = {c: table[c].chunk(0) for c in table.column_names}
        new = np.zeros(len(table), bool)
        for c in keys:
            new[1:] |= pc.not_equal(whole[c][1:], whole[c][:-1]).to_numpy(zero_copy_only=False)
        new[0] = True
        first = np.flatnonzero(new)
        first = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(first, [*first[1:], len(new)], strict=True)])
        ends = np.r_[first[1:], len(new)]
        rows = pa.StructArray.from_arrays([whole[c] for c in others], names=others)
        out = {c: whole[c].take(pa.array(first)) for c in (*on, "bucket")} | {event_time: whole[event_time].take(pa.array(ends - 1))}
        return pa.RecordBatch.from_pydict(out | {"rows": pa.ListArray.from_arrays(pa.array(np.r_[first, len(new)].astype(np.int32)), rows)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch] if len(batch) else held, n + len(batch)
            if n > HELD:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    return known.repartition(*keys).mapInArrow(run, made)


def expanded(packed: DataFrame, on: Sequence[str], lo_ms: int, hi_ms: int, ts: str = "ts_ms") -> DataFrame:
    """The pairs in pairs of chunks ``packed(on, rows, r_rows)``; right columns get the prefix ``r_``."""
    each = packed.select(*on, F.explode("rows").alias("l"), "r_rows").select(*on, "l", F.explode("r_rows").alias("r"))
    near = each.where(F.col(f"r.{ts}").between(F.col(f"l.{ts}") + lo_ms, F.col(f"l.{ts}") + hi_ms))
    left, right = (packed.schema[c].dataType.elementType.names for c in ("rows", "r_rows"))
    return near.select(*on, *[F.col(f"l.{c}").alias(c) for c in left], *[F.col(f"r.{c}").alias(f"r_{c}") for c in right])


def run_interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], lo_ms: int, hi_ms: int, root: str, ts: str = "ts_ms",
    event_time: str = "at", delay_ms: int = 0, provider: str = ROCKSDB, packed: bool = False,
) -> StreamingQuery:
    """Starts ``interval_join`` of two streams; pairs and progress are kept below ``root``.

    Both sides carry ``event_time`` (TIMESTAMP, the same times as ``ts``) and may be ``delay_ms`` out of order. Rows are kept as
    state, on disk and not in the workers' heaps, until no partner can come any more, by the watermark of the slower side. The query ends when
    all that is there is joined; a later call with the same ``root`` goes on from there, with the state as it was.

    Rows of a key that lie close together are one row of state, so the engine looks up chunks and not each pair. With ``packed``, pairs of chunks
    are kept in place of pairs, for ``expanded`` to read: what is written follows the rows, however many pairs they make.
    """
    late = f"{delay_ms} milliseconds"
    if lo_ms == hi_ms:
        if packed:
            raise ValueError("chunks need an interval")
        pairs = interval_join(left.withWatermark(event_time, late), right.withWatermark(event_time, late), on, lo_ms, hi_ms, ts, event_time)
    else:
        width = hi_ms - lo_ms
        span = -(-width // SHARES)  # no chunk lasts longer
        sides = (_chunks(x, on, ts, event_time, width).withWatermark(event_time, late) for x in (left, right))
        l, r = (side.select([F.col(c).alias(f"{x}_{c}") for c in side.columns]) for x, side in zip("lr", sides))
        # a left chunk meets the buckets that the intervals of its rows touch, a right chunk has one
        first, last = F.col("l_rows")[0][ts], F.element_at("l_rows", -1)[ts]
        l = l.withColumn("l_bucket", F.explode(F.sequence(bucket_of(first + lo_ms, width), bucket_of(last + hi_ms, width))))
        since = lambda ms: F.expr(f"l_{event_time} + interval {ms} milliseconds")
        met = l.join(r, [
            *(F.col(f"l_{c}") == F.col(f"r_{c}") for c in (*on, "bucket")),
            F.col(f"r_{event_time}") >= since(lo_ms - span), F.col(f"r_{event_time}") <= since(hi_ms + span),
        ])
        pairs = met.select(*[F.col(f"l_{c}").alias(c) for c in on], F.col("l_rows").alias("rows"), "r_rows")
        pairs = pairs if packed else expanded(pairs, on, lo_ms, hi_ms, ts)
    with _state_in(left.sparkSession, provider):
        return (
            pairs.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start(f"{root}/packed" if packed else f"{root}/pairs")
        )
