"""Secret scans with a ledger: every distinct text is scanned once per version of a rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters or more; the others are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = 0
    #: A text without any of these, in lower case, has no match. None: always look.
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group, int(self.flags))).encode()).hexdigest()[:16]

    def spans(self, text: str, lower: str) -> Iterator[tuple[int, int]]:
        if not self.hints or any(h in lower for h in self.hints):
            for m in re.finditer(self.pattern, text, self.flags):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.start(), m.end()


# The kinds of secrets, in the order in which they are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hints=("akia",)),
    # A run is matched as a whole, so asking for 16 characters at once finds the runs that have them.
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
SPAN = "struct<start: long, place: int, kind: string, end: long>"
LEDGER = f"blob string, version string, spans array<{SPAN}>"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, made empty if there is none: a row per blob and rule version scanned."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {r.version: (n, r) for n, r in enumerate(rules)}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for blob, text, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lower = text.lower()
                for version in todo:
                    n, rule = place[version]
                    spans = [{"start": a, "place": n, "kind": rule.kind, "end": b} for a, b in rule.spans(text, lower)]
                    for to, x in zip(out, (blob, version, spans), strict=True):
                        to.append(x)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], kind)], names=["blob", "version", "spans"])

    return blobs.mapInArrow(run, LEDGER)


def scan(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, blob, spans)`` for every row of ``docs``: its findings by start, then in the order of ``rules``.

    A blob is a text by its SHA-256; null counts as empty. Rows are historical versions or paths, and many can share a
    blob. Only pairs of blob and rule version that the ledger at ``path`` lacks are scanned, each once, and appended to it in one
    commit: a scan that fails leaves the ledger as it was, and one run again finds what others finished. Findings then go
    back to all paths. A changed rule has another version, so it alone is scanned anew. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    versions = [r.version for r in rules]
    done = ledger(docs.sparkSession, path).where(F.col("version").isin(versions)).groupBy("blob").agg(F.collect_set("version").alias("done"))
    # Equal texts are one before they are shuffled as far as a task sees them, and one in all after it.
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text")).join(done, "blob", "left")
    every = F.array(*map(F.lit, versions))
    todo = blobs.select("blob", "text", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    _scanned(todo.where(F.size("todo") > 0), rules).write.mode("append").parquet(path)
    hits = ledger(docs.sparkSession, path).where(F.col("version").isin(versions) & (F.size("spans") > 0))
    found = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.select("id", "blob").join(found, "blob", "left").select("id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
