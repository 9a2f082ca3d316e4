"""Jaccard self-join of texts by word n-grams: adaptive prefixes that ask for several shared n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import counted, mapped, written
from hazemeter.llm.components import components
from hazemeter.llm.exact import squeezed
from hazemeter.llm.shingles import shingle_sets
from hazemeter.session import discard

WORDS = 5
#: Sets link if their Jaccard similarity is OVER / UNDER or more.
OVER, UNDER = 4, 5
#: Prefixes are lengthened by up to so many shared n-grams.
LONGEST = 8
#: Cost of comparing two sets, per n-gram, against meeting in one posting.
COMPARE = 0.1
#: Characters of text whose n-grams are matched in one piece of work.
BUCKET_CHARS = 1 << 23
#: N-grams are told apart by 64 bits less these bytes.
LOW = 1
#: N-grams held back by a task before it sends them, and n-grams per row sent.
HELD, SENT = 1 << 20, 1 << 11
#: Texts looked at to find n-grams so frequent that they need no matching: those in one of FREQUENT texts, HOT at most.
LOOKED_AT, FREQUENT, HOT = 4000, 128, 100_000
EVERYWHERE = 1 << 40
#: Sets are compared with hubs for another round if more than this share of the last one's were similar.
WORTH = 0.1
#: Sets with one n-gram that are paired in one piece of work.
BLOCK = 1024


def _packed(x: np.ndarray, low: int = 0) -> bytes:
    """Values byte plane by byte plane without the ``low`` lowest, so that sorted ones compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T[low:].tobytes()


def _unpacked(data: list[bytes], low: int = 0) -> np.ndarray:
    parts = [np.frombuffer(d, np.uint8).reshape(8 - low, -1).T for d in data]
    whole = np.zeros((sum(map(len, parts)), 8), np.uint8)
    whole[:, low:] = np.concatenate(parts)
    return whole.view(np.uint64).ravel()


def _hot(docs: DataFrame, rows: int, words: int) -> np.ndarray:
    """Sorted n-grams that a bounded sample shows to be in one of FREQUENT texts or more. They decide how the others are matched, not what is found."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // LOOKED_AT))) == 0).select("text")
    flat = lambda b: {"h": pa.array(np.concatenate([np.zeros(0, np.uint64), *_sets(b.column(0), words)]).view(np.int64))}
    often = mapped(some, flat, "h long").groupBy("h").agg(F.count("h").alias("n")).where(F.col("n") > max(16, min(rows, LOOKED_AT) // FREQUENT))
    return np.sort(often.orderBy(F.desc("n"), "h").limit(HOT).toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of every text its different n-grams, sorted, without their LOW lowest bytes."""
    low = np.uint64(8 * LOW)
    return [np.unique(s >> low << low) for s in shingle_sets(texts, words)]


def _described(docs: DataFrame, words: int) -> DataFrame:
    """``(row, id, n, d1, d2)``: the size of every text's set of n-grams, and a digest of it."""
    names = ["row", "id", "n", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(2), words)
            digest = np.frombuffer(b"".join(hashlib.md5(s.tobytes()).digest() for s in sets), np.int64).reshape(-1, 2)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, n long, d1 long, d2 long")


def _sent(docs: DataFrame, words: int, bits: int, hot: np.ndarray) -> DataFrame:
    """Packed n-grams of one bucket with their texts' rows; ``hot`` tells those that are known to be frequent."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def flush(grams: list[np.ndarray], rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, row = np.concatenate(grams), np.concatenate(rows)
        known = np.isin(h, held.value)
        # What is frequent for sure is shared: it is dealt by its text and only carried along.
        bucket = np.where(known, row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), h) >> np.uint64(64 - bits)
        by = np.lexsort((h, known, bucket))
        h, row, bucket, known = h[by], row[by], bucket[by], known[by]
        edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (known[1:] != known[:-1])])
        cuts = np.concatenate([np.arange(a, b, SENT) for a, b in zip(edge, [*edge[1:], len(h)], strict=True)])
        ends = np.r_[cuts[1:], len(h)]
        for some in np.array_split(np.arange(len(cuts)), len(cuts) // 256 + 1):
            packed = lambda x, low=0: pa.array([_packed(x[a:b], low) for a, b in zip(cuts[some], ends[some], strict=True)], pa.binary())  # noqa: B023, E731
            at = cuts[some]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at].astype(np.int32)), "hot": pa.array(known[at]), "grams": packed(h, LOW), "rows": packed(row)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, size = [], [], 0
        for batch in batches:
            sets = _sets(batch.column(1), words)
            n = np.array([len(s) for s in sets], np.int64)
            grams += sets
            rows.append(np.repeat(batch.column(0).to_numpy(), n))
            size += int(n.sum())
            if size > HELD:
                yield from flush(grams, rows)
                grams, rows, size = [], [], 0
        if size:
            yield from flush(grams, rows)

    return docs.select("row", "text").mapInArrow(run, "bucket int, hot boolean, grams binary, rows binary")


def _matched(sent: DataFrame) -> DataFrame:
    """``(row, h, df)``: a row per n-gram of a text that another text has too.

    ``df`` is the number of texts that have it, or EVERYWHERE if it is known to be frequent.
    """

    def shared(grams: list[bytes], rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        if grams:
            h, row = _unpacked(grams, LOW), _unpacked(rows).view(np.int64)
            by = np.argsort(h, kind="stable")
            h, row = h[by], row[by]
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            df = np.repeat(np.diff(edge), np.diff(edge))
            keep = df > 1
            yield out(row[keep], h[keep], df[keep])

    def out(row: np.ndarray, h: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array(row), "h": pa.array(h.view(np.int64)), "df": pa.array(df)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, now = [], [], None
        for batch in batches:
            for bucket, hot, g, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot:
                    row = _unpacked([r]).view(np.int64)
                    yield out(row, _unpacked([g], LOW), np.full(len(row), EVERYWHERE))
                    continue
                if bucket != now:
                    yield from shared(grams, rows)
                    grams, rows, now = [], [], bucket
                grams.append(g)
                rows.append(r)
        yield from shared(grams, rows)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "row long, h long, df long")


def _alike(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of ``a`` and ``b`` members, ``common`` of them shared, are similar enough."""
    return (OVER + UNDER) * common >= OVER * (a + b)


def _can(shared: Column, n: Column) -> Column:
    """Whether a set of ``n``, ``shared`` of them in other sets, can have a partner: a partner shares OVER / UNDER of them at least."""
    return UNDER * shared >= OVER * n


def prefixes(sets: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(h, pos, node, n, met, asked, common)``: the n-grams of each set's prefix, and how many of them a partner must share.

    ``sets(node, n, grams)`` has the n-grams that other sets have too, as ``(df, h)`` in the order of all prefixes: rare
    ones first, those of one set only before all others. Of two similar sets' common n-grams the first ``asked`` lie in both prefixes of
    ``n - least overlap + asked``, so the smaller ``asked`` of the two is a bound of what they share there. A longer prefix
    reads more postings and leaves fewer pairs to compare, at most the sum of its postings over ``asked``: each set takes the
    cheapest. ``pos`` is an n-gram's place in its set from 1, ``met`` how many n-grams a set has that others have;
    ``common`` tells how frequent a set's n-grams are: of a text and its edited copies the text has the most.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for node, n, df, h in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            least = -(-OVER * n // UNDER)
            first = len(h) - least
            often = np.array(df, float)
            postings = np.concatenate([[0.0], np.cumsum(often - 1)])
            asked = np.arange(1, min(longest, least) + 1)
            even = len(h) + 2 * OVER * n // -(OVER + UNDER)  # as far as a partner of the same size has to be looked for
            reach = postings[np.clip(even + asked, 0, len(h))]
            best = int(np.argmin(reach + COMPARE * n * reach / asked))
            part = h[: max(first + best + 1, 0)]
            for to, x in zip(out, (part, range(n - len(h) + 1, n - len(h) + 1 + len(part)), [node] * len(part), [n] * len(part), [len(h)] * len(part), [best + 1] * len(part), [float(np.log(often).sum() / n)] * len(part)), strict=True):
                to += x
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return {c: pa.array(x, k) for c, x, k in zip(("h", "pos", "node", "n", "met", "asked", "common"), out, kinds, strict=True)}

    split = sets.select("node", "n", F.transform("grams", lambda g: g["df"]).alias("df"), F.transform("grams", lambda g: g["h"]).alias("h"))
    return mapped(split, cut, "h long, pos long, node long, n long, met long, asked int, common double")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar by all their n-grams."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.transform("grams", lambda g: g["h"]).alias(f"{x}h"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_alike(F.size(F.array_intersect("ah", "bh")), F.col("an"), F.col("bn"))).select("a", "b")


def _fits(a: str, b: str) -> Column:
    """Whether an n-gram of two prefixes can be one of the first that two similar sets have in common.

    What they have in common, others have too, so neither has less of that than it takes; and no more of
    a set than its rest lies before its first common n-grams, as many as are asked for.
    """
    need = F.ceil(OVER * (F.col(f"{a}n") + F.col(f"{b}n")) / (OVER + UNDER))
    asked = F.least(f"{a}asked", f"{b}asked")
    early = lambda x: F.col(f"{x}pos") <= F.col(f"{x}n") - need + asked
    return (F.least(f"{a}met", f"{b}met") >= need) & early(a) & early(b)


def _top() -> Column:
    """Aggregate: the set of the most frequent n-grams."""
    return F.max(F.struct("common", "node", "n", "met", "asked", "pos", "label"))


def _labelled(near: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``near`` with each set's ``label``, and ``(h, held, hub)``: n-grams that sets of several labels have, how many have them, and their hub.

    The hub of an n-gram is its set of the most frequent n-grams.
    """
    named = near.drop("label")
    if links is None:
        named = named.withColumn("label", F.col("node"))
    else:
        label = written(components(links).withColumnRenamed("root", "label"), "labels")
        named = named.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = written(named, "labelled")
    ends = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("h").alias("held"), _top().alias("hub"))
    return named, written(ends.where("lo <> hi").select("h", "held", "hub"), "mixed")


def _hubs(named: DataFrame, mixed: DataFrame, tried: DataFrame | None) -> DataFrame:
    """``(a, b)``: every set with the one hub of another label it shares most n-grams of its prefix with, unless it was ``tried``.

    Sets of the hub's own label have the next such set of another one as theirs.
    """
    rival = written(_others(named, mixed), "rivals")
    hub = F.when(F.col("label") != F.col("hub.label"), F.col("hub")).otherwise(F.col("rival"))
    met = named.join(mixed.select("h", "hub"), "h").join(rival, "h").withColumn("hub", hub).where(_fits("", "hub."))
    stars = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("h").alias("shared"))
    stars = stars.select("node", "hub", "shared", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    if tried is not None:
        stars = stars.join(tried, ["a", "b"], "left_anti")
    return stars.groupBy("node").agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def _others(named: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(h, rival)``: of the sets that have not their hub's label, the one of the most frequent n-grams."""
    own = mixed.select("h", F.col("hub.label").alias("hub_label"))
    return named.join(own, "h").where("label <> hub_label").groupBy("h").agg(_top().alias("rival"))


def _candidates(near: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: all pairs of different labels that share as many n-grams of their prefixes as the less demanding asks for.

    Sets with an n-gram in common are dealt into blocks, and every two blocks are one piece of work.
    """
    dealt = near.withColumn("blocks", F.ceil(F.col("held") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "pos", "node", "n", "met", "asked", "label")
    a, b = (dealt.where(f"mine = {side}").select("h", "lo", "hi", *(F.col(c).alias(f"{x}{c}") for c in ("pos", "node", "n", "met", "asked", "label"))) for x, side in (("a", "lo"), ("b", "hi")))
    # Within one block every pair is met in both orders, of two blocks once.
    met = a.join(b, ["h", "lo", "hi"]).where(
        ((F.col("lo") != F.col("hi")) | (F.col("anode") < F.col("bnode"))) & (F.col("alabel") != F.col("blabel")) & _fits("a", "b")
    )
    pairs = met.groupBy(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).agg(
        F.count("h").alias("shared"), F.first(F.least("aasked", "basked")).alias("asked")
    )
    return pairs.where("shared >= asked").select("a", "b")


def set_links(sets: DataFrame, longest: int = LONGEST, block: int = BLOCK, *, first: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` between similar ones of the written ``sets(node, n, grams)`` that join all that are similar.

    Pairs of ``first(a, b)``, if there are any, are compared before all others. Then
    sets are compared with hubs, one each, round by round while more than WORTH of them are similar. Sets joined so far need not meet again, so many
    near copies of one text leave few pairs; all others that share enough of their prefixes are compared one by one.
    """
    named = written(prefixes(sets, longest), "prefixes")
    links, tried = (None, None) if first is None else (written(_confirmed(first, sets), "links"), first)
    while True:
        named, mixed = _labelled(named, links)
        pairs = written(_hubs(named, mixed, tried), "stars")
        compared = pairs.count()
        more, found = counted(_confirmed(pairs, sets), "links")
        links, tried = (more, pairs) if links is None else (links.union(more), tried.union(pairs))
        if found <= WORTH * compared:
            break
    if found:
        named, mixed = _labelled(named, links)
    rest = _candidates(named.join(mixed.select("h", "held"), "h"), block).join(tried, ["a", "b"], "left_anti")
    return links.union(_confirmed(written(rest, "pairs"), sets))


def _grouped(own: DataFrame, members: DataFrame, groups: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Pairs ``(a, b)``: the set of each row, and that of the smallest row that ``groups`` puts together with it."""
    found = groups(own.where(squeezed(F.col("text")) != ""), "row", "text").where("id <> component")
    set_of = lambda row, x: members.select(F.col("row").alias(row), F.col("node").alias(x))
    pairs = found.join(set_of("id", "a"), "id").join(set_of("component", "b"), "component").where("a <> b")
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "grouped")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, longest: int = LONGEST,
    groups: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """``(id, n_shingles, component)`` for every row: the size of its set of n-grams and the smallest id it is linked to, over any number of links.

    Texts are read twice. Equal sets, told by 128 bits, are one after the first time. Then every n-gram meets its equals once, in buckets of bounded size, and a text of which less than
    OVER / UNDER has any equal is done with: it can have no partner. A text of fewer
    words than ``words`` is one n-gram; null texts and texts without words have an empty set, linked with nothing. Rows that repeat an id are
    linked each by its own text; null ids are the smallest only where a group has no other. N-grams are told apart by 56 bits.

    ``groups(texts, id, text)`` is another operator that gives ``(id, component)`` of the texts that have words. What it puts together is compared first.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.char_length(text_col)), F.lit(0)).alias("chars")).first()
    bits = max(4, (size["chars"] // BUCKET_CHARS).bit_length())
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = written(own, "rows", compression="zstd")  # both passes must see the same row numbers
    texts = written(_described(own, words), "texts")
    same = ["n", "d1", "d2"]
    distinct = written(texts.where("n > 0").groupBy(*same).agg(F.min("row").alias("node"), F.count("row").alias("copies")), "distinct")
    members = written(texts.join(distinct, same).select("row", "node", "copies", "n"), "members")
    nodes = members.where("row = node").select("row", "copies", "n")
    marks = _matched(_sent(own, words, bits, _hot(own, size["rows"], words)))
    # An n-gram that more texts have than there are copies of a set is in other sets too.
    others = marks.join(nodes, "row").where("df > copies").groupBy(F.col("row").alias("node"), "n").agg(F.collect_list(F.struct("df", "h")).alias("grams"))
    ranked = others.where(_can(F.size("grams"), F.col("n"))).withColumn("grams", F.sort_array("grams"))
    ranked = written(ranked.select("node", "n", "grams"), "ranked")
    first = {"first": _grouped(own, members, groups)} if groups else {}
    discard(own)  # the texts are not read again
    roots = components(set_links(ranked, longest, **first))
    rooted = members.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted.join(texts.select("row", "id"), "row").select("row", "root", "id"), "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("id").alias("component")), "lowest")
    named = rooted.join(lowest, "root").select("row", "component", F.lit(True).alias("grouped"))
    return texts.join(named, "row", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id")).alias("component"))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, groups: Callable[[DataFrame, str, str], DataFrame] | None = None
) -> DataFrame:
    """The rows of ``docs`` without those linked, over any number of near copies, to one of a smaller id; null ids come last.

    What ``groups`` puts together is compared first (see ``near_groups``).

    Of rows that repeat an id the texts decide. Rows that repeat both id and text, told by 128 bits, stay or go together.
    """
    key = F.struct(*(F.xxhash64(F.lit(seed), docs[id_col].cast("string"), F.lit("\0"), docs[text_col]).alias(f"k{seed}") for seed in (1, 2)))
    own = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), key.alias("key"))
    named = near_groups(docs.select(own.alias("id"), docs[text_col].alias("text")), "id", "text", words, groups=groups)
    gone = named.where("id <> component").select(F.col("id.key").alias("own_key")).distinct()
    return docs.join(gone, key == gone["own_key"], "left_anti")
