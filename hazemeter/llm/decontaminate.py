"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import whole_words, written

#: A shared span of so many words is a hit.
SPAN = 10
#: Words of a k-gram. A span holds SPAN - GRAM + 1 of them; the one of the least hash is its fingerprint.
GRAM = 5
#: A pick is a hash above a place; no text has 2 ** PLACE_BITS words.
PLACE_BITS = 31


def _print(hashed: Column) -> Column:
    """The lower bits of a hash: all that fits into a pick above the place."""
    return F.shiftright(F.shiftleft(hashed, PLACE_BITS), PLACE_BITS)


def _hash(words: str, at: Column, gram: int) -> Column:
    return F.xxhash64(*(F.get(words, at + (i - 1)) for i in range(gram)))


def winnowed(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``texts``, which has its ``words`` and their number ``n``, with ``picks``.

    Winnowing: every window of ``span`` words picks its k-gram of the least hash, the leftmost of equal ones. Equal
    windows pick equal k-grams at the same place, so every shared span shares a fingerprint. A pick is one long, the
    hash above the k-gram's place from 1, so that the least pick is the window's.
    """
    width = span - gram + 1
    places = lambda n: F.when(F.col("n") >= span, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array())
    grams = F.transform(
        places(F.col("n") - gram + 1),
        lambda i: F.shiftleft(_hash("words", i, gram), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    texts = texts.withColumn("grams", grams)
    if width == 1:
        return texts.withColumnRenamed("grams", "picks")
    least = F.transform(places(F.col("n") - span + 1), lambda i: F.least(*(F.get("grams", i + (j - 1)) for j in range(width))))
    return texts.withColumn("picks", F.array_distinct(least)).drop("grams")


def _picked(winnows: DataFrame, *keep: str) -> DataFrame:
    """A row per pick: its ``print`` and its place ``at``."""
    return winnows.select(*keep, F.explode("picks").alias("pick")).select(
        *keep, F.shiftright("pick", PLACE_BITS).alias("print"),
        F.col("pick").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"),
    )


def _around(gram: int, reach: int) -> tuple[Column, Column]:
    """Up to ``reach`` words before the k-gram at ``at``, last first; the k-gram and up to ``reach`` words behind it."""
    first = F.greatest(F.col("at") - reach, F.lit(1))
    return F.reverse(F.slice("words", first, F.col("at") - first)).alias("back"), F.slice("words", F.col("at"), F.lit(gram + reach)).alias("on")


def _same(a: str, b: str) -> Column:
    """How many words two lists share from their beginning on."""
    end = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(end > 0, end - 1).otherwise(F.size(a)).cast("int")


def _spans(docs: DataFrame, index: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """``(key, item, lo, hi)``: words lo to hi of a text lie in windows of ``span`` words that the item has too.

    Fingerprints are joined, then the texts that share any are read again, and each match is extended both ways word
    by word as far as a window with the fingerprint in it can reach. Longer spans have further fingerprints.
    """
    reach = span - gram
    prints = written(_picked(items, "item", "words").select("print", "item", *_around(gram, reach)).distinct(), "prints")
    met = _picked(index, "key").join(prints.select("print").distinct(), "print", "left_semi")
    places = written(met.groupBy("key").agg(F.collect_set("at").alias("places")), "places")
    words = docs.join(places, "key").select("key", whole_words(F.col("text")).alias("words"), "places")
    ways = words.select("key", "words", F.explode("places").alias("at")).select(
        "key", "at", _print(_hash("words", F.col("at"), gram)).alias("print"), *(c.alias(x) for c, x in zip(_around(gram, reach), ("mine", "more"), strict=True))
    ).join(prints, "print")
    met = ways.select("key", "item", "at", _same("mine", "back").alias("before"), _same("more", "on").alias("after"))
    return met.where((F.col("after") >= gram) & (F.col("before") + F.col("after") >= span)).select(
        "key", "item", (F.col("at") - F.col("before")).alias("lo"), (F.col("at") + F.col("after") - 1).alias("hi")
    ).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM,
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` for every row of ``docs``.

    A word is hit inside any occurrence of a window of an item: ``span`` consecutive words, or the whole item if it
    has fewer, but not none. ``n_hit`` counts hit words, ``items`` lists the ids of items with occurring windows as
    sorted strings. Null and empty texts have no words. Equal texts have equal hits, whatever their ids are, and are
    told apart by a digest, so repeated rows and ids do no harm. Items that repeat an id count once, a null
    item id as an empty string. No items: no hits; no documents: no rows.

    Items of fewer words than ``span`` take part by their length: their only k-gram is the whole item.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), whole_words(F.col(item_text)).alias("words"))
    items = written(items.select("item", "words", F.size("words").alias("n")).where("n > 0"), "items")
    sizes = [r[0] for r in items.select(F.least("n", F.lit(span))).distinct().collect()]  # span values at most
    found, index = [], None
    for size in sorted({span, *sizes}, reverse=True):
        k = gram if size == span else size
        split = texts.select("id", "key", whole_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
        winnows = written(winnowed(split, size, k).drop("words"), "winnows")
        index = index or winnows
        own = items.where(F.col("n") >= span if size == span else F.col("n") == size)
        found.append(_spans(texts.select("key", "text"), winnows, winnowed(own, size, k), size, k))
    spans = written(reduce(DataFrame.unionByName, found), "spans")
    order = Window.partitionBy("key").orderBy("lo", "hi")
    seen = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.col("hi") - F.greatest(F.col("lo") - 1, seen), F.lit(0))
    hits = spans.select("key", "lo", "hi").distinct().select("key", new.alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    listed = spans.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return index.select("id", "key", "n").join(hits.join(listed, "key"), "key", "left").select(
        "id", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` no word of which is hit, with all their columns."""
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("digest")).alias("id"), F.col(text_col).alias("text"))
    bad = contamination(named, benchmark, "id", "text", **how).where("n_hit > 0").select("id.*").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id"]) & (F.md5(docs[text_col]) == bad["digest"]), "left_anti")
