"""Alignment of two tokenizers' tokens over the same bytes, by coalesced intervals."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import written

#: Vocabularies: ranks of byte-level tokens (A), pieces with byte fallback (B).
VOCABULARY_A = "byte_bpe_50k.tiktoken"
VOCABULARY_B = "piece_bpe_32k.model"
#: Text aligned in one step, in bytes.
STEP = 1 << 21
#: Id pairs whose counts a task holds before it hands them on.
HELD = 1 << 21
#: Id pairs whose counts go to every task, the most frequent ones: 13 bytes each. All others are looked up by a join.
FREQUENT = 1 << 21
#: A pair's code is B's id above so many bits of A's.
A_BITS = 16
_MARKS = (",", "|", ";", "")


class Tokenizers:
    """Ids, byte strings and lengths of both vocabularies."""

    def __init__(self, a: str, b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(a), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.byte_level = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{mark}" for mark in _MARKS for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A over a space and the text, and of B over the text; none where either's bytes are not those of the text."""
        for text, b in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1), strict=True):
            whole = f" {text}"
            a = self.byte_level.encode_ordinary(whole) if text else []
            raw = whole.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            yield (a, b) if same else ([], [])


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a: str, b: str) -> Tokenizers:
    """Loaded once per worker process."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Tokenizers(a, b)
    return _loaded[a, b]


class Tokens(NamedTuple):
    """Tokens of several texts by one tokenizer, in order: ids, and where each begins and ends; texts follow each other without a gap."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(ids: np.ndarray, sizes: np.ndarray) -> Tokens:
    size = sizes[ids]
    end = np.cumsum(size)
    return Tokens(ids, end - size, end)


def coalesced(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens by group, A's first: ids, which are B's, and group numbers.

    A group ends where the next token, by its start, begins at or behind every end so far: there A and B both end.
    """
    start, end = np.r_[a.start, b.start], np.r_[a.end, b.end]
    other = np.arange(len(start)) >= len(a.ids)
    by = np.lexsort((other, start))
    reach = np.maximum.accumulate(end[by])
    group = np.cumsum(np.r_[False, start[by][1:] >= reach[:-1]])
    order = np.argsort(2 * group + other[by], kind="stable")
    by = by[order]
    return np.r_[a.ids, b.ids][by], other[by], group[order]


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all pairs of an A and a B token that share bytes, and how many of them each A token has."""
    first = np.searchsorted(b.end, a.start, "right")
    n = np.searchsorted(b.start, a.end, "left") - first
    ends = np.cumsum(n)
    other = np.arange(int(n.sum())) + np.repeat(first - (ends - n), n)
    return (b.ids[other].astype(np.uint32) << np.uint32(A_BITS)) | np.repeat(a.ids, n).astype(np.uint32), n


def _steps(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of STEP characters or one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > STEP:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    yield slice(first, len(texts))


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between each two of ``cuts``."""
    return np.diff(np.r_[0, np.cumsum(values)][cuts])


def _cuts(parts: list) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)])


def _ids(parts: list) -> np.ndarray:
    return np.fromiter((i for p in parts for i in p), np.int64, sum(map(len, parts)))


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each, which = np.unique(np.concatenate(codes), return_inverse=True)
    return each, np.bincount(which, np.concatenate(counts), len(each)).astype(np.int64)


def _tokenized(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per text with both tokenizers' ids and what its groups are; and rows of a pair's ``code`` and ``count`` within a task."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = {
        "row": pa.int64(), "id": None, "a": pa.binary(), "b": pa.binary(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
        "n_links": pa.int64(), "groups_sha256": pa.string(), "code": pa.int64(), "count": pa.int64(),
    }

    def out(ids: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, k or ids)) for c, k in fields.items()], names=list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ids = _tokenizers(a, b), None
        codes, counts, held = [], [], 0
        for batch in batches:
            ids = batch.column(1).type
            texts = batch.column(2).to_pylist()
            for step in _steps(texts):
                pairs = list(both.encode(texts[step]))
                if not pairs:
                    continue
                of_a, of_b = ([p[k] for p in pairs] for k in (0, 1))
                x, y = tokens(_ids(of_a), both.size_a), tokens(_ids(of_b), both.size_b)
                link, n = overlaps(x, y)
                shown, other, group = coalesced(x, y)
                cut_a, cut_b = _cuts(of_a), _cuts(of_b)
                cuts = cut_a + cut_b
                last = np.zeros(len(shown), bool)
                last[cuts[1:][np.diff(cuts) > 0] - 1] = True
                new = np.r_[group[1:] != group[:-1], True][: len(shown)]
                mark = np.where(last, 3, np.where(new, 2, np.r_[other[1:] != other[:-1], False][: len(shown)].astype(int)))
                named = (mark * (len(both.shown) // len(_MARKS)) + shown).tolist()
                sha = [hashlib.sha256("".join([both.shown[i] for i in named[p:q]]).encode()).hexdigest() if q > p else "" for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                ids_of = lambda t, cut: pa.array([part.tobytes() for part in np.split(t.ids.astype("<u2"), cut[1:-1])], pa.binary())
                yield out(
                    ids, row=batch.column(0)[step.start : step.stop], id=batch.column(1)[step.start : step.stop], a=ids_of(x, cut_a), b=ids_of(y, cut_b),
                    n_a=pa.array(np.diff(cut_a)), n_b=pa.array(np.diff(cut_b)), n_groups=pa.array(_per_text(new, cuts)),
                    n_links=pa.array(_per_text(n, cut_a)), groups_sha256=pa.array(sha, pa.string()),
                )
                each, often = np.unique(link, return_counts=True)
                codes.append(each)
                counts.append(often)
                held += len(each)
                if held > HELD:
                    each, often = _counted(codes, counts)
                    codes, counts, held = [each], [often], len(each)
                    if held > HELD // 2:
                        yield out(ids, code=pa.array(each.astype(np.int64)), count=pa.array(often))
                        codes, counts, held = [], [], 0
        if held:
            each, often = _counted(codes, counts)
            yield out(ids, code=pa.array(each.astype(np.int64)), count=pa.array(often))

    columns = f"row long, id {kind}, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, code long, count long"
    return docs.select("row", "id", "text").mapInArrow(run, columns)


def pair_counts(marks: DataFrame) -> DataFrame:
    """``(code, count, best)`` of every id pair that is linked anywhere; ``best`` if no pair with its B id is linked more often."""
    counts = written(marks.where("code is not null").groupBy("code").agg(F.sum("count").alias("count")), "pair_counts")
    other = F.shiftright("code", A_BITS).alias("other")
    # A row per id of B's vocabulary at most.
    highest = F.broadcast(counts.groupBy(other).agg(F.max("count").alias("highest")))
    return counts.join(highest, other == F.col("other")).select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def _weighed(texts: DataFrame, often: pa.Table, a: str, b: str) -> DataFrame:
    """``(row, code, n_best, count_sum)``: a text's sums over its links of frequent pairs, and a row per link of any other pair, with its ``code``."""
    table = often.sort_by("code")
    held = texts.sparkSession.sparkContext.broadcast((table["code"].to_numpy().astype(np.uint32), table["count"].to_numpy(), table["best"].to_numpy(zero_copy_only=False).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (codes, counts, best) = _tokenizers(a, b), held.value
        for batch in batches:
            size = np.r_[0, np.cumsum(batch.column(3).to_numpy())]
            edges = np.unique([*np.searchsorted(size, np.arange(0, size[-1], STEP // 4)), 0, len(batch)])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                row = part.column(0).to_numpy()
                x, y = (tokens(np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").astype(np.int64), s) for i, s in ((1, both.size_a), (2, both.size_b)))
                link, n = overlaps(x, y)
                own = np.repeat(np.arange(len(part)), _per_text(n, np.r_[0, np.cumsum(part.column(3).to_numpy())]))
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, link), len(codes) - 1)
                    known = codes[at] == link
                    at, whose = at[known], own[known]
                    sums = (np.bincount(whose, best[at], len(part)).astype(np.int64), _whole_sums(whose, counts[at], len(part)))
                    link, own = link[~known], own[~known]
                else:
                    sums = (np.zeros(len(part), np.int64),) * 2
                yield pa.RecordBatch.from_pydict({"row": pa.array(row), "code": pa.nulls(len(part), pa.int64()), "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})
                if len(link):
                    none = pa.nulls(len(link), pa.int64())
                    yield pa.RecordBatch.from_pydict({"row": pa.array(row[own]), "code": pa.array(link.astype(np.int64)), "n_best": none, "count_sum": none})

    return texts.select("row", "a", "b", "n_a").mapInArrow(run, "row long, code long, n_best long, count_sum long")


def _whole_sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by index; the index is sorted."""
    return np.diff(np.r_[0, np.cumsum(values)][np.searchsorted(index, np.arange(n + 1))])


def _frequent(pairs: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The least count of those pairs that go to every task, ``most`` at most, and the pairs."""
    sizes = pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("code").alias("n")).collect()  # 64 rows at most
    least, n = 64, 0
    for r in sorted(sizes, reverse=True):
        n += r["n"]
        if n > most:
            break
        least = r["power"]
    return 1 << min(least, 62), pairs.where(F.col("count") >= (1 << min(least, 62))).toArrow()


def alignments(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B, frequent: int = FREQUENT
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    Both tokenizers' ids of a text are cut into groups where both end. A link is a pair of an A and a B token
    that share bytes; ``n_best`` counts links of the pairs of ids that occur most often for their B id in all of ``docs``, ties
    included, ``count_sum`` adds up how often each link's pair occurs. The digest is over the groups as text. Null and
    empty texts, and texts that a tokenizer changes, have no tokens: zeros and an empty digest. Rows that repeat are counted each;
    an empty table gives an empty one.

    Texts are tokenized once. Counts of the pairs most texts consist of go to every task, at most ``frequent`` of them,
    whatever the size of ``docs``; links of all other pairs find theirs by a join.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = written(_tokenized(own, a, b), "tokens", compression="zstd")
    pairs = written(pair_counts(marks), "pairs")
    least, often = _frequent(pairs, frequent)
    texts = marks.where("code is null")
    weighed = written(_weighed(texts, often, a, b), "weighed")
    rare = weighed.where("code is not null").groupBy("row", "code").agg(F.count("code").alias("k"))
    rare = rare.join(pairs.where(F.col("count") < least), "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rare_best"), F.sum(F.col("k") * F.col("count")).alias("rare_sum")
    )
    sums = weighed.where("code is null").select("row", "n_best", "count_sum").join(rare, "row", "left")
    return texts.join(sums, "row").select(
        "id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """``(id, start, end, a, b)``: a row per group, its bytes of a space and the text, and both tokenizers' ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a, b)
        for batch in batches:
            for i, (p, q) in enumerate(both.encode(batch.column(1).to_pylist())):
                if not p:
                    continue
                x, y = tokens(np.array(p), both.size_a), tokens(np.array(q), both.size_b)
                ids, other, group = coalesced(x, y)
                n = int(group[-1]) + 1
                lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(group[of], minlength=n))].astype(np.int32), ids[of].astype(np.int32)) for of in (~other, other)]
                end = np.cumsum(np.bincount(group, np.where(other, 0, both.size_a[np.where(other, 0, ids)]), n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), pa.array(np.r_[0, end[:-1]]), pa.array(end), *lists], names=["id", "start", "end", "a", "b"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, end long, a array<int>, b array<int>")
