"""The driver's tables read as air-quality data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazemeter.functions.timegrid import bucket_of, ntz_to_epoch_ms
from hazemeter.params import DAY, HOUR
from hazemeter.schema import BATCH, CURRENT, LAST_YEAR, LOCATION

T0 = 1_705_276_800_000  # 2024-01-15 UTC: earlier events play last year
SHIFT = 14 * DAY
BATCH_MS = 6 * HOUR
BATCH_READINGS = 100  # per year in a nested batch
#: Readings no instrument gives, and small ones, by the event's number modulo ODD_EVERY: P1, P2.
ODD_EVERY = 211
ODD = {3: ("Infinity", "0.25"), 5: ("-Infinity", "1"), 7: ("1e16", "-1e16"), 11: ("0.000012345", "0.000000001"), 13: ("2", "Infinity"), 17: ("Infinity", "-Infinity")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", ntz_to_epoch_ms(F.col("ts")))


def readings(
    spark: SparkSession, sf_dir: str, wide: bool = False, late: bool = False, odd: bool = False
) -> DataFrame:
    """Located readings: city from the user, batches of six hours.

    ``wide`` makes every user a city; ``late`` delivers every 50th reading one
    batch late; ``odd`` puts readings of any size among them.
    """
    out = _as_readings(_events(spark, sf_dir), wide, late)
    return out.withColumns({"p1": _odd("p1", 0), "p2": _odd("p2", 1)}) if odd else out


def _odd(column: str, side: int) -> Column:
    value = F.col(column)
    for rest, cases in ODD.items():
        value = F.when(F.col("pos") % ODD_EVERY == rest, F.lit(cases[side]).cast("double")).otherwise(value)
    return value


def events_of_type(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Located readings made from one type of event."""
    return _as_readings(_events(spark, sf_dir).where(F.col("event_type") == event_type))


def _as_readings(events: DataFrame, wide: bool = False, late: bool = False) -> DataFrame:
    ms, user = F.col("ms"), F.col("user_id")
    ts_ms = F.when(ms >= T0, ms).otherwise(ms + F.lit(SHIFT))
    delay = F.when(F.col("event_id") % 50 == 7, 1).otherwise(0) if late else F.lit(0)
    return events.select(
        (bucket_of(ts_ms - F.lit(T0).cast("bigint"), BATCH_MS) + delay).alias("seq"),
        F.col("event_id").alias("pos"),
        (user if wide else user % 20).cast("string").alias("city"),
        F.when(ms >= T0, CURRENT).otherwise(LAST_YEAR).alias("period"),
        ts_ms.alias("ts_ms"),
        F.col("value").alias("p1"), (F.col("value") * 0.25).alias("p2"),
        latitude().alias("lat"), longitude().alias("lon"),
    )


def latitude() -> Column:
    return (F.lit(47.013) + F.col("event_id") % 80 / F.lit(10.0)).cast("float")


def longitude() -> Column:
    return (F.lit(6.017) + F.col("user_id") % 95 / F.lit(10.0)).cast("float")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested batches in the wire shape; the last one carries the flag.

    Batch number i holds the i-th ``BATCH_READINGS`` events of either year, so the
    number of batches grows with the data and their size does not.
    """
    ms = F.col("ms")
    now = ms >= T0
    reading = F.struct(
        F.struct(
            F.floor(ms / 1000).alias("seconds"), ((ms % 1000) * 1_000_000).cast("int").alias("nanos")
        ).alias("timestamp"),
        latitude().alias("latitude"), longitude().alias("longitude"),
        F.col("value").cast("float").alias("p1"), (F.col("value") * 0.25).cast("float").alias("p2"),
    )
    ordered = F.struct(F.col("event_id").alias("pos"), reading.alias("m"))

    def side(condition: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(condition, ordered))), lambda x: x["m"])

    events = _events(spark, sf_dir)
    first_now = events.where(now).agg(F.min("event_id")).scalar()
    number = F.when(now, F.col("event_id") - first_now).otherwise(F.col("event_id"))
    flat = events.withColumn("seq_id", bucket_of(number, BATCH_READINGS))
    last = flat.agg(F.max("seq_id")).scalar()
    nested = flat.groupBy("seq_id").agg(side(now).alias("current"), side(~now).alias("lastyear"))
    return nested.select("seq_id", (F.col("seq_id") == last).alias("last"), "current", "lastyear").to(
        spark.createDataFrame([], BATCH).schema
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per nation on a grid of five by five; odd ones are triangles.

    Nations 0 and 1 share a city name.
    """
    i = F.col("n_nationkey")
    south = F.lit(47.0) + F.lit(1.6) * F.floor(i / 5)
    west = F.lit(6.0) + F.lit(1.8) * (i % 5)

    def corner(lon: Column, lat: Column) -> Column:
        return F.struct(lon.alias("longitude"), lat.alias("latitude"))

    sw, se = corner(west, south), corner(west + 1.8, south)
    ne, nw = corner(west + 1.8, south + 1.6), corner(west, south + 1.6)
    ring = F.when(i % 2 == 0, F.array(sw, se, ne, nw, sw)).otherwise(F.array(sw, se, nw, sw))
    return table(spark, sf_dir, "nation").select(
        F.format_string("%05d", i).alias("zipcode"),
        F.when(i == 1, "NATION_0").otherwise(F.col("n_name")).alias("city"),
        F.lit(1.0).alias("qkm"), F.lit(0).alias("population"),
        F.array(F.struct(ring.alias("points"))).alias("polygons"),
    ).to(spark.createDataFrame([], LOCATION).schema)
