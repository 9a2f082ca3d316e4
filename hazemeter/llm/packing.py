"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazemeter.llm.common import written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
ID_BYTES = 4
#: Words whose ids a worker remembers, about 60 MB, and as many older ones. Idle workers keep them.
REMEMBERED = 300_000
#: Pieces of one length are numbered within so many bits.
RANK_BITS = 48
#: The tokenizer does not count these as white space, Python does.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of such letters need nothing of the tokenizer but its merges: lower case is letter by letter, and they are composed as they are.
LATIN = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u024f]+")
#: How the vocabulary marks the end of a word, and the character that stands for it in words about to be merged.
WORD_END, MARK = "</w>", "\x01"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ids of Latin words by the vocabulary's merges alone. Its ids are in the order of merging, as ranks have to be."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        import tiktoken

        letters, ranks, self.last = _byte_letters(), {}, np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            word = token.removesuffix(WORD_END) if token != WORD_END else token
            if any(c not in letters for c in word):
                continue
            self.last[i] = word != token
            ranks[bytes(map(letters.__getitem__, word)) + MARK.encode() * (word != token)] = i
        self.encoding = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            text = " ".join(w + MARK for w in words[i : i + 1000]).lower()
            ids = np.array(self.encoding.encode_ordinary(text), "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ID_BYTES).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out


class WordIds:
    """Token ids of whole texts as little-endian 32-bit values, by way of the ids of their words.

    The vocabulary's pre-tokenizer drops white space and nothing it does looks across it, so the ids of a text are those
    of its words in a row. A word of letters with full stops or commas behind it is split there as well.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.bar = self._each(["|"])[0]
        self.merges = Merges(self.tok.get_vocab(with_added_tokens=False))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """For words of letters only: Latin ones by merges; of others, many are encoded as one text with bars between them."""
        latin = [w for w in words if LATIN.fullmatch(w)]
        if latin:
            known = dict(zip(latin, self.merges.encode(latin), strict=True))
            rest = [w for w in words if w not in known]
            known.update(zip(rest, self._letters(rest), strict=True))
            return [known[w] for w in words]
        out: list[bytes] = []
        bar = int(np.frombuffer(self.bar, "<u4")[0])
        for i in range(0, len(words), 200):
            part = words[i : i + 200]
            ids = np.array(self.tok.encode(" | ".join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == bar) * ID_BYTES
            buf = ids.tobytes()
            out += [buf[a:b] for a, b in zip([0, *(cut + ID_BYTES).tolist()], [*cut.tolist(), len(buf)], strict=True)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Adds words, and the parts they are made of, to those that are known."""
        split = [(w, s, w[len(s) :]) for w in words if (s := w.rstrip(".,")).isalpha()]
        plain = [s for s in {s for _, s, _ in split} if s not in self.known]
        self.known.update(zip(plain, self._letters(plain), strict=True))
        rest = [w for w in words.difference(w for w, _, _ in split) | {t for _, _, t in split if t} if w not in self.known]
        self.known.update(zip(rest, self._each(rest), strict=True))
        self.known.update((w, self.known[s] + self.known[t]) for w, s, t in split if t)

    def _lacking(self, words: set[str]) -> set[str]:
        """Words that are not known. When the store is full, it becomes the older one, from which words in use come back."""
        new = words.difference(self.known)
        if len(self.known) + 2 * len(new) > REMEMBERED:
            self.known, self.older, new = {}, self.known, words
        back = [w for w in new if w in self.older]
        self.known.update(zip(back, map(self.older.__getitem__, back), strict=True))
        return new.difference(back)

    @staticmethod
    def _words(text: str) -> list[str]:
        if any(c in text for c in NOT_SPACE):
            return re.findall(f"[\\S{NOT_SPACE}]+", text)
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken in groups, so that words new to a group are encoded together."""
        for i in range(0, len(texts), 100):
            split = [self._words(t) for t in texts[i : i + 100]]
            if new := self._lacking(set().union(*split)):
                self._learn(new)
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


_encoders: dict[str, WordIds] = {}


def _encoder(vocabulary: str) -> WordIds:
    """One encoder per worker process."""
    if vocabulary not in _encoders:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary] = WordIds(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """A row per piece of every document: ``id, piece, start, length, ids_crc32, block, nth`` and, if asked for, ``ids``.

    A document is its ids and then id 0. Only longer ones than ``capacity`` are cut. Null and empty texts are one
    piece of one id. ``block`` is the task that made a row, ``nth`` its number among those of its length there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "block", "nth", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, met = _encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in names[1:]]
            index = []
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids += bytes(ID_BYTES)
                for k, at in enumerate(range(0, len(ids), capacity * ID_BYTES)):
                    part = ids[at : at + capacity * ID_BYTES]
                    length = len(part) // ID_BYTES
                    index.append(i)
                    for to, x in zip(rows, (k, at // ID_BYTES, length, zlib.crc32(part), block, met[length], part), strict=False):
                        to.append(x)
                    met[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=False))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How sequences are filled, from nothing but how many pieces there are of each length.

    Rows ``(length, rank, uses, times, sequence, offset)``: of the pieces of a length, those numbered from ``rank``
    on go, ``uses`` at a time, into ``times`` sequences from ``sequence`` on, at ``offset`` and then one behind the other.

    A sequence is filled greedily: the longest piece that fits, again and again. If a gap is left when none fits,
    its shortest piece gives way to two others if they fill piece and gap better, as tightly as any two can. A
    filling is used as often as the counts allow, so fillings are at most a few per length, however many pieces there are.
    """
    left = {k: v for k, v in counts.items() if v}
    lengths = sorted(left)
    rank = dict.fromkeys(lengths, 0)
    rows, sequence = [], 0
    while lengths:
        fill, gap = Counter(), capacity
        while (i := bisect_right(lengths, gap)) > 0:
            k = next((j for j in range(i - 1, -1, -1) if left[lengths[j]] > fill[lengths[j]]), None)
            if k is None:
                break
            size = lengths[k]
            n = min(left[size] - fill[size], gap // size)
            fill[size] += n
            gap -= n * size
        if gap:
            out = min(fill)
            fill[out] -= 1
            two = _two(lengths, {x: left[x] - fill[x] - (x == out) for x in lengths}, gap + out)
            fill.update(two if sum(two) > out else [out])
        fill = +fill
        times = min(left[x] // n for x, n in fill.items())
        offset = 0
        for x in sorted(fill, reverse=True):
            n = fill[x]
            rows.append((x, rank[x], n, times, sequence, offset))
            offset += n * x
            rank[x] += n * times
            left[x] -= n * times
        sequence += times
        lengths = [x for x in lengths if left[x]]
    return rows


def _two(lengths: list[int], free: dict[int, int], room: int) -> tuple[int, ...]:
    """The two free pieces of the largest sum within ``room``; of equal sums the one with the longest piece."""
    best: tuple[int, ...] = ()
    usable = [x for x in lengths if free[x] and x < room]
    i, j = 0, len(usable) - 1
    while i <= j:
        a, b = usable[i], usable[j]
        if a + b > room or i == j and free[a] < 2:
            j -= 1
            continue
        if a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs`` (``ids`` if asked for).

    Texts are tokenized once, into a written table. What decides about sequences is the number of pieces of each
    length, at most ``capacity`` values: the plan comes from them and is as large for any number of documents.
    Pieces of equal length are interchangeable; each finds its place by its number among them, which is its number in
    its own block plus those of earlier blocks. No group is gathered. Repeated rows are packed each by
    itself; an empty table gives an empty one.
    """
    rows = written(pieces(docs, id_col, text_col, capacity, vocabulary, keep_ids), "pieces")
    blocks = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as blocks have different lengths: a summary of each task, not of each piece.
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The summary grows with the number of blocks and packs well on disk, so its size there does not make it small: no broadcast.
    ranked = rows.join(blocks.drop("n").hint("merge"), ["length", "block"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "block")
    return _placed(docs.sparkSession, ranked, plan(counts, capacity))


def _placed(spark: SparkSession, ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    steps = np.array(sorted(rows), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(steps)
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        key = (table[:, 0] << RANK_BITS) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length.astype(np.int64) << RANK_BITS) + rank, "right") - 1
            _, first, uses, _, sequence, offset = table[at].T
            done, slot = np.divmod(rank - first, uses)
            out = [batch.column(i) for i, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence + done), pa.array(offset + slot * length)], names=[*(c for c in names if c != "rank"), "sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
