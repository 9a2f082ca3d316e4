"""Language identification by prediction by partial matching: the language whose context tree codes a text shortest."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import mapped

#: The longest context, in bytes.
ORDER = 4
#: Documents learned from, per language at most: those of the smallest hash of their id, whole texts. Statistics are frozen then.
LEARN_ROWS = 500
SPARE = 4
UNKNOWN = "und"
#: Two to this power is the number of slots by which most grams are found at once.
SLOTS = 22
#: Bytes coded in one step.
BLOCK = 1 << 19


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``: whether crc32 of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2)


def learning_sample(docs: DataFrame, id_col: str = "doc_id", rows: int = LEARN_ROWS) -> DataFrame:
    """``(lang, text)`` of up to ``rows`` documents per language, none of them held out: those of the least hashes of their ids.

    A count per language, without any text, gives a bound of the hash below which some SPARE times as many are expected; only
    texts below it are ranked, so no task gets more however large a language is. Rows that repeat an id count once, with
    the least text. The label of an unknown language is none to learn.
    """
    usable = learnable(docs.select(id_col, "lang", "text"), id_col).where(f"not held_out and lang <> '{UNKNOWN}' and text is not null")
    usable = usable.select("lang", "text", F.xxhash64(id_col).alias("hash"))
    share = SPARE * rows / F.count("hash")
    bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + share * 2.0**64).cast("long"))
    # One row per language.
    near = usable.join(F.broadcast(usable.groupBy("lang").agg(bound.alias("bound"))), "lang").where(F.col("hash") <= F.col("bound"))
    single = near.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return single.withColumn("nth", nth).where(F.col("nth") <= rows).select("lang", "text")


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Keys of the (order + 1)-grams of ``data``, first byte lowest."""
    n = len(data) - order
    key = np.zeros(max(n, 0), np.int64)
    for i in range(order + 1):
        key |= data[i : i + n].astype(np.int64) << (8 * i)
    return key


def gram_counts(sample: DataFrame) -> DataFrame:
    """``(lang, ctx, gram, n)``: how often each context of up to ORDER bytes is followed by each byte."""

    def count(batch: pa.RecordBatch) -> dict:
        grams: dict[tuple[str, int], list[np.ndarray]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            for order in range(min(ORDER + 1, len(data))):
                grams[lang, order].append(_grams(data, order))
        # A batch's texts are counted together, so the shuffle gets a row per different gram.
        found = [(*key, *np.unique(np.concatenate(parts), return_counts=True)) for key, parts in grams.items()]
        column = lambda kind, parts: pa.array(np.concatenate(parts) if parts else [], kind)
        return {
            "lang": column(pa.string(), [np.full(len(n), lang, object) for lang, _, _, n in found]),
            "ctx": column(pa.int32(), [np.full(len(n), order, np.int32) for _, order, _, n in found]),
            "gram": column(pa.int64(), [keys for _, _, keys, _ in found]), "n": column(pa.int64(), [n for *_, n in found]),
        }

    counted = mapped(sample, count, "lang string, ctx int, gram long, n long")
    return counted.groupBy("lang", "ctx", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Context trees of all languages: a sparse table each of the (context, byte) counts and of the contexts' totals.

    A context is what a text shows before a byte, up to ORDER bytes; its parent is the context without its oldest byte. Every
    context of the counts is there unless ``least`` says otherwise: contexts seen less often in every language are then left out.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, ctx: np.ndarray, gram: np.ndarray, n: np.ndarray, least: int = 1) -> None:
        self.langs = langs
        if least > 1:
            context = gram & ((1 << (8 * ctx)) - 1)
            pairs, which = np.unique(np.stack([ctx, context, lang]), axis=1, return_inverse=True)
            often = pairs[:2, np.bincount(which.ravel(), n) >= least]
            code = lambda order, c: (c << 3) | order
            kept = (ctx == 0) | np.isin(code(ctx, context), code(*often))
            lang, ctx, gram, n = lang[kept], ctx[kept], gram[kept], n[kept]
        self.tables, self.keys = [], None
        for i in range(len(langs)):
            tables = [self._table(gram[own], n[own], k) for k in range(ORDER + 1) for own in [(lang == i) & (ctx == k)]]
            self.tables.append([(*t, self._excluded(tables, k) if k else None) for k, t in enumerate(tables)])

    @staticmethod
    def _table(gram: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
        """Of one language and order: sorted grams and their counts; sorted contexts, their totals and numbers of different bytes."""
        by = np.argsort(gram)
        gram, n = gram[by], n[by].astype(np.int64)
        contexts, which = np.unique(gram & ((1 << (8 * order)) - 1), return_inverse=True)
        return gram, n, contexts, np.bincount(which, n, len(contexts)), np.bincount(which, minlength=len(contexts))

    def _bits(self, tables: list[tuple[np.ndarray, ...]], order: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the others: by the longest context that has the byte, after an escape from each longer one.

        A context of T bytes and D different ones gives n / (T + D) to each and D / (T + D) to the escape; what a
        longer context had is excluded from shorter ones. In a context the language never showed there is nothing
        to escape from. At last, all 256 byte values not excluded are alike.
        """
        bits, todo = np.zeros(len(gram)), np.arange(len(gram))
        # What was seen after a context was seen after its parent, so what is excluded is just what the next longer context had.
        gone_n, gone_kinds = np.zeros(len(gram)), np.zeros(len(gram))
        for k in range(ORDER, -1, -1):
            grams, n, contexts, totals, kinds, excluded = tables[k]
            here = todo[order[todo] >= k]
            own = gram[here] >> (8 * (order[here] - k))
            context = own & ((1 << (8 * k)) - 1)
            known, at = _found(contexts, context)
            here, own, at = here[known], own[known], at[known]
            total, different = totals[at] - gone_n[here], kinds[at] - gone_kinds[here]
            has, place = _found(grams, own)
            bits[here[has]] -= np.log2(n[place[has]] / (total + different)[has])
            open_ = ~has & (total > 0)
            bits[here[open_]] -= np.log2(different[open_] / (total + different)[open_])
            gone_kinds[here] = kinds[at]
            if k:
                gone_n[here] = excluded[at]
            todo = np.setdiff1d(todo, here[has], assume_unique=True)
        bits[todo] += np.log2(np.maximum(256 - gone_kinds[todo], 1))
        return bits

    @staticmethod
    def _excluded(tables: list[tuple[np.ndarray, ...]], k: int) -> np.ndarray:
        """Per context of length ``k``: how often the bytes seen after it were seen after its parent."""
        grams, _, contexts, *_ = tables[k]
        _, at = _found(tables[k - 1][0], grams >> 8)
        where = np.searchsorted(contexts, grams & ((1 << (8 * k)) - 1))
        return np.bincount(where, tables[k - 1][1][at], len(contexts))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "tables": self.tables, "keys": None}

    def _prepare(self) -> None:
        """Code lengths of all grams of the counts, where texts are judged: what is sent there is the counts. A key is order and gram."""
        self.keys = np.unique(np.concatenate([t[0] | (k << 40) for tables in self.tables for k, t in enumerate(tables)]))
        self.bits = self._all_bits(self.keys)
        self.slots = np.zeros(1 << SLOTS, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)

    def _all_bits(self, key: np.ndarray) -> np.ndarray:
        order, gram = key >> 40, key & ((1 << 40) - 1)
        return np.stack([self._bits(tables, order, gram) for tables in self.tables], axis=1).astype(np.float32)

    def _coded(self, key: np.ndarray) -> np.ndarray:
        """Bits of each key and language: grams of the counts are looked up, others are worked out."""
        at = self.slots[self._slot(key)]
        bits = self.bits[at]
        if len(rest := np.flatnonzero(self.keys[at] != key)):
            other, which = np.unique(key[rest], return_inverse=True)
            known, at = _found(self.keys, other)
            new = self.bits[at]
            new[~known] = self._all_bits(other[~known])
            bits[rest] = new[which]
        return bits

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits per text and language."""
        if self.keys is None:
            self._prepare()
        starts = np.cumsum([0, *(len(t) for t in texts)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        last = int(starts[-1])
        for lo in range(0, last, BLOCK):
            hi = min(lo + BLOCK, last)
            low = max(lo - ORDER, 0)
            here = np.concatenate([np.zeros(ORDER - (lo - low), np.uint8), raw[low:hi]]).astype(np.int64)
            first, end = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
            text = np.repeat(np.arange(first, end), np.diff(np.clip(starts[first : end + 1], lo, hi)))
            order = np.minimum(np.arange(lo, hi) - starts[text], ORDER)
            key = np.zeros(hi - lo, np.int64)
            for i in range(ORDER + 1):
                key |= here[i : i + hi - lo] << (8 * i)
            bits = self._coded((key >> (8 * (ORDER - order))) | (order << 40))
            for i in range(len(self.langs)):
                out[first:end, i] += np.bincount(text - first, bits[:, i], end - first)
        return out


def _found(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``wanted`` is among the sorted ``values``, and where."""
    if not len(values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted, at


def _spelled(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter: what ``identify`` gives a language if any was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(map(_spelled, batch.column(text_col).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, id_col: str = "doc_id", rows: int = LEARN_ROWS) -> Trees | None:
    """Trees from a bounded sample of the labelled rows that are not held out; None if there are none."""
    table = gram_counts(learning_sample(docs, id_col, rows)).toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("lang", "ascending"), ("ctx", "ascending"), ("gram", "ascending")])
    names = table["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    return Trees(langs, np.array([place[x] for x in names]), *(table[c].to_numpy().astype(np.int64) for c in ("ctx", "gram", "n")))


def identify(docs: DataFrame, trees: Trees | None, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only the named ``columns``) with ``lang_pred`` and ``score``.

    The language of the shortest code length (on a tie the first by name); ``score`` is its share of the
    probability all languages give the text, from 0 to 1. Null and empty texts, texts without a letter, and all
    texts where nothing was learned, are ``und`` with 0. Columns named like the two new ones are replaced.
    """
    names = [c for c in columns or docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(trees)
    given = docs.select(F.col(text_col).alias("text to judge"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if _spelled(t)] if held.value else []
            if known:
                bits = held.value.lengths([texts[i].encode() for i in known])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for i, k, s in zip(known, best.tolist(), share.tolist(), strict=True):
                    pred[i], score[i] = held.value.langs[k], s
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = "".join(f"`{c}` {t}, " for c, t in given.dtypes[1:])
    return given.mapInArrow(run, f"{fields}lang_pred string, score double")
