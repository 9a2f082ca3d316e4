"""URL filters: captures joined with the list entries that were in force when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import written

#: Longer host names are none.
HOST_CHARS = 253
#: Validity intervals are cut into pieces of so many days, so a capture meets only those of its own piece.
PIECE_DAYS = 32
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user, port or dot behind it; null where there is none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    name = F.rtrim(name, F.lit("."))
    return F.when((F.char_length(name) > 0) & (F.char_length(name) <= HOST_CHARS), name)


def section(url: Column) -> Column:
    """First segment of a URL's path, empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def patterns(url: Column) -> Column:
    """What list entries can say about a URL: its host, every parent domain of two labels or more, each with its first path segment too."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    with_path = F.when(section(url) == "", F.array().cast("array<string>")).otherwise(F.transform(domains, lambda d: F.concat(d, F.lit("/"), section(url))))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(domains, with_path))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``(list, pattern, since, until)`` from dated entries ``(list, pattern, day, listed)``; ``until`` is exclusive.

    An entry holds until the next one of its list and pattern. Of several on a day, one that lists wins. Entries without
    a pattern or a day say nothing; one without ``listed`` ends an interval.
    """
    days = entries.where("pattern is not null and day is not null").groupBy("list", "pattern", "day").agg(
        F.max(F.coalesce("listed", F.lit(False))).alias("listed")
    )
    after = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return days.select("list", "pattern", F.col("day").alias("since"), F.coalesce(after, F.lit(FOREVER).cast("date")).alias("until"), "listed").where("listed").drop("listed")


def _piece(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PIECE_DAYS).cast("int")


def in_force(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` as a struct ``capture``, with ``n_entries``, ``lists`` and the most specific ``pattern`` in force that day, and ``blocked``.

    Equi-join on the pattern and the piece of time, then a comparison of days: a pattern that changed often does not
    meet its whole history, and a capture under a much-used host meets the few entries of that host. A capture without a day, or whose
    URL is null or has no host, has no entry. Patterns rank by length, then by name. Repeated captures count each by itself.
    """
    rows = written(captures.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("capture")), "captures")
    asked = rows.select("row", F.col(f"capture.{day_col}").alias("day"), F.explode(patterns(F.col(f"capture.{url_col}"))).alias("pattern")).where("day is not null")
    span = rows.agg(F.min(f"capture.{day_col}").alias("a"), F.max(f"capture.{day_col}").alias("b")).first()
    cut = validity(entries).where((F.col("since") <= F.lit(span["b"])) & (F.col("until") > F.lit(span["a"]))).withColumn(
        "piece", F.explode(F.sequence(_piece(F.greatest("since", F.lit(span["a"]))), _piece(F.least(F.date_sub("until", 1), F.lit(span["b"])))))
    )
    met = asked.withColumn("piece", _piece(F.col("day"))).join(cut, ["pattern", "piece"]).where("day >= since and day < until")
    best = F.max(F.struct(F.char_length("pattern").alias("n"), "pattern", "since"))
    per = met.groupBy("row").agg(F.count("*").alias("n_entries"), F.sort_array(F.collect_set("list")).alias("lists"), best.alias("best"))
    return rows.join(per, "row", "left").select(
        "capture", F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"), F.col("n_entries").isNotNull().alias("blocked"),
    )
