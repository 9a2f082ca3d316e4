"""Line deduplication: repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import written

#: A run of so many lines counts as repeated.
RUN = 3
#: So does a single line of so many words.
LONG_LINE = 20
EDGES = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame) -> DataFrame:
    """``rows`` with ``marks``: a struct per line that is not blank, in order.

    ``at`` is the line's number from 0, ``h`` and ``g`` are independent hashes of the line without white space at its
    edges, ``long`` tells whether it counts alone.
    """
    mark = lambda x, i: F.struct(
        i.alias("at"), F.xxhash64(F.btrim(x, F.lit(EDGES))).alias("h"), F.xxhash64(F.lit(1), F.btrim(x, F.lit(EDGES))).alias("g"),
        (F.char_length(F.btrim(x, F.lit(EDGES))) > 0).alias("full"),
        (F.char_length(F.btrim(x, F.lit(EDGES))) - F.char_length(F.replace(F.btrim(x, F.lit(EDGES)), F.lit(" "), F.lit(""))) >= LONG_LINE - 1).alias("long"),
    )
    return docs.select("row", "id", F.filter(F.transform(_lines(F.col("text")), mark), lambda m: m["full"]).alias("marks"))


def _windows(hashed: DataFrame, run: int) -> DataFrame:
    """``(row, id, ats, key)`` per window of ``run`` lines around a fingerprint that occurs more than once.

    A window's fingerprint is its least line hash. A repeated window repeats its fingerprint, so windows without a
    repeated one are done with before they meet any other. ``key`` is a digest of 128 bits of all hashes of the window.
    """
    starts = F.when(F.size("marks") >= run, F.sequence(F.lit(0), F.greatest(F.size("marks") - run, F.lit(0)))).otherwise(F.array())
    window = lambda i: F.struct(
        F.least(*(F.struct(F.get("marks", i + j)["h"].alias("h"), F.get("marks", i + j)["at"].alias("at")) for j in range(run))).alias("pick"),
        F.array(*(F.get("marks", i + j)["at"] for j in range(run))).alias("ats"),
        F.array(*(F.xxhash64(F.lit(seed), *(F.get("marks", i + j)[h] for j in range(run) for h in "hg")) for seed in (1, 2))).alias("key"),
    )
    windows = hashed.select("row", "id", F.explode(F.transform(starts, window)).alias("w"))
    windows = written(windows.select("row", "id", F.col("w.pick.h").alias("pick"), F.col("w.pick.at").alias("at"), "w.ats", "w.key"), "windows")
    # Windows next to each other mostly share their pick: a fingerprint occurs again if it does at another place.
    place = F.struct("row", "at")
    again = windows.groupBy("pick").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("pick")
    return windows.join(again, "pick", "left_semi").select("row", "id", "ats", "key")


def _later(windows: DataFrame) -> DataFrame:
    """``(row, at)`` of lines in windows whose key occurred before, in order of id (nulls last), row and line."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "ats")
    first = windows.groupBy("key").agg(F.min(order).alias("first"))
    return windows.join(first, "key").where(order > F.col("first")).select("row", F.explode("ats").alias("at"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``(id, text, n_lines, n_deleted)`` for every row: its text without lines of runs that came before.

    Lines end at line feeds and are compared without white space at their edges; blank ones take no part and stay. A
    run of ``run`` or more lines that stood in an earlier document (by id, null ids last, then in table order), or earlier
    in the same one, is deleted; so is a repeated line of LONG_LINE or more words. The first occurrence of any line always
    stays; of a line repeated over and over in one run that is its first. Null texts stay null and have no lines,
    empty ones have one. Repeated rows count as documents of their own. An empty table gives an empty one.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows")
    hashed = _hashed(rows)
    alone = hashed.select("row", "id", F.explode(F.filter("marks", lambda m: m["long"])).alias("m")).select(
        "row", "id", F.array("m.at").alias("ats"), F.array("m.h", "m.g").alias("key")
    )
    gone = _later(_windows(hashed, run)).unionByName(_later(alone)).distinct()
    gone = gone.groupBy("row").agg(F.collect_list("at").alias("gone"))
    out = rows.join(gone, "row", "left").select("id", "text", _lines(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return out.select(
        "id", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"),
    )
