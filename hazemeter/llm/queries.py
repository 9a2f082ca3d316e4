"""The corpus operators as registered queries over the driver's tables, one per operator, and their plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazemeter.llm import align, centroids, decontaminate, exact, html_text, langid, lines, ngram_join, packing, secrets, shards, simhash, sql, urls
from hazemeter.llm.common import table
from hazemeter.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark items contain, and of how many items."""
    hit = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of equal bytes."""
    return shards.byte_shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.rendered(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stands for every document's text."""
    return exact.verdicts(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of lines that came before."""
    return lines.repeated_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger that begins empty."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
    found = secrets.scan(table(spark, sf_dir, "documents"), path)
    span = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *(count(r.kind) for r in secrets.RULES), F.sha2(span, 256).alias("base_sha256"), span.alias("spans")
    )


def _number(text: Column | str) -> Column:
    """0 to 65535 from a text's digest, alike in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """``(page_id, url, day)``: the pages have no time of fetching, so the URL's digest gives each a day of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number("url") % 366).alias("day"))


def entries(pages: DataFrame) -> DataFrame:
    """Dated list entries ``(list, pattern, day, listed)`` made from the pages' own hosts, about two of five of them.

    A host, or its parent domain, is listed on a day of its digest and unlisted 90 days later; every third is listed once
    more after 200 days. A second list has hosts with their first path segment, for good.
    """
    hosts = pages.select(urls.host(F.col("url")).alias("host"), urls.section(F.col("url")).alias("section")).where("host is not null")
    names = hosts.select("host").distinct().select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.([^.]+\.)", "$1"))).alias("pattern")).distinct()
    names = names.withColumn("n", _number("pattern")).where("n % 5 < 2").withColumn("day", F.date_add(F.lit("2023-11-01").cast("date"), F.col("n") % 300))
    steps = F.array(
        F.struct("day", F.lit(True).alias("listed")), F.struct(F.date_add("day", 90).alias("day"), F.lit(False).alias("listed")),
        F.struct(F.when(F.col("n") % 3 == 0, F.date_add("day", 200)).alias("day"), F.lit(True).alias("listed")),
    )
    dated = names.select(F.lit("hosts").alias("list"), "pattern", F.explode(steps).alias("s")).select("list", "pattern", "s.*").where("day is not null")
    paths = hosts.where("section <> ''").select(F.concat("host", F.lit("/"), "section").alias("pattern")).distinct().withColumn("n", _number("pattern"))
    paths = paths.where("n % 7 = 0").select(F.lit("paths").alias("list"), "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") % 300).alias("day"), F.lit(True).alias("listed"))
    return dated.unionByName(paths)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the list entries in force when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.in_force(captures(pages), entries(pages)).select(
        "capture.*", "n_entries", F.array_join("lists", ",").alias("lists"), "pattern", "since", "blocked"
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(langid.learnable(docs), langid.learn(docs), columns=["doc_id", "held_out"])


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document into common groups, and how often linked ids are linked in all documents."""
    return align.alignments(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds of sixteen centroids."""
    return centroids.clustered(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of five-word shingles, and the group of those whose sets are similar."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def queries() -> dict[str, Query]:
    """Query name → ``(spark, sf_dir) -> DataFrame``."""
    own = (
        op1_simhash_near_dedup, op2_decontamination, op3_sharding, op4_html_extraction, op5_exact_dedup, op6_line_dedup,
        op7_secret_scans, op8_url_filters, op9_best_fit_packing, op10_language_id, op11_cross_tokenizer_alignment,
        op12_centroid_clustering, op13_ngram_jaccard_join,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Query name → the same answer as DuckDB SQL, where SQL can say it."""
    return sql.STATEMENTS
