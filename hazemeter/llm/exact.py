"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import SPACES, written

#: Runs merged into one per round: four rounds of a binomial tree at a time.
FAN_IN = 16


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _told(text_col: str) -> list[Column]:
    """What tells a text: its length, and two hashes of it without white space."""
    text = squeezed(F.col(text_col))
    points = F.coalesce(F.char_length(text_col), F.lit(0)).alias("points")
    return [points, F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("proof")]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, run, id, points, digest, proof)``: a row's number, its partition's run, and what identifies its text.

    ``proof`` is a second, independent hash: texts count as equal when both agree.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), F.col(id_col).alias("id"), *_told(text_col)
    )


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``(digest, proof, n, best)`` per text: how many rows have it and which stays.

    Every partition first sorts its rows by digest and combines equal neighbours: a run (the sort aggregate before
    an exchange). A round then merges every ``fan_in`` runs that follow each other into one, so there are as many rounds
    as it takes until one run is left: log2(fan_in) rounds of a binomial tree at a time. Each merge
    keeps the count and the smallest identifier, so a text never has more rows than runs left, and a
    round deals digests over all tasks. The work per round does not depend on how often a text occurs.
    """
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    # Most code points, then the smallest id, null ids last, then the first row.
    best = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")
    runs = rows.select("run", "digest", "proof", F.lit(1).cast("long").alias("n"), best.alias("best"))
    while True:
        left = -(-left // fan_in)
        keys = [F.floor(F.col("run") / fan_in).cast("int").alias("run")] if left > 1 else []
        runs = runs.groupBy(*keys, "digest", "proof").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        if left == 1:
            return runs


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, keep_id, group_size, kept, digest)`` for every row of ``docs``.

    Of texts that are equal without white space, the one with the most code points stays, then the smallest
    id (null ids last). Null and empty texts, and texts of white space, are one group. Of repeated rows exactly
    one is kept. An empty table gives an empty one; columns of other names are not touched.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    ends = written(merged_runs(rows), "ends")
    return rows.join(ends, ["digest", "proof"]).select(
        "row", "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), "digest",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    No copy of the texts is written: the row that stays is found again by its id, length and hashes. Only where several rows agree in
    all of these are they numbered, and the first one stays.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    best = merged_runs(rows).select("digest", "proof", (-F.col("best.less")).alias("points"), F.col("best.id").alias("id"))
    same = ["digest", "proof", "points"]

    def agreeing(left: DataFrame, id: Column, right: DataFrame) -> DataFrame:
        return left.join(right, [*(left[c] == right[c] for c in same), id.eqNullSafe(right["id"])], "left_semi")

    stays = written(agreeing(rows, rows["id"], best).groupBy(*same, "id").agg(F.count(F.lit(1)).alias("rows")), "stays")
    told = docs.select(F.struct("*").alias("doc"), *_told(text_col))
    found = lambda some: agreeing(told, told[f"doc.{id_col}"], some)
    several = stays.where("rows > 1")
    if several.isEmpty():
        return found(stays).select("doc.*")
    first = Window.partitionBy(*same).orderBy("number")
    numbered = found(several).withColumn("number", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(first))
    return found(stays.where("rows = 1")).select("doc.*").unionByName(numbered.where("place = 1").select("doc.*"))
