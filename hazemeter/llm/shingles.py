"""Hashes of word shingles, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that part words: space, tab to carriage return.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LANE = 8
#: Words of more bytes are hashed one by one.
_LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(_LANE + 1)], np.uint64)


def _mixed(z: np.ndarray) -> np.ndarray:
    """Every bit of a value spread over all 64, one to one; ``z`` is overwritten."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and where each text's words begin; one more entry says where the last ones end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    data = np.concatenate([_LOWER[data], np.zeros(_LANE, np.uint8)])
    gap = _GAP[data[:-_LANE]]
    cuts = offsets - first
    inner = cuts[(cuts > 0) & (cuts < len(gap))]
    before, behind = np.r_[True, gap[:-1]], np.r_[gap[1:], True]
    before[inner] = True
    behind[inner - 1] = True
    start = np.flatnonzero(before & ~gap)
    size = np.flatnonzero(behind & ~gap) + 1 - start
    lanes = np.ndarray((len(data) - _LANE + 1,), "<u8", data, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left, which = start, size, None
    for lane in range(_LONG // _LANE):
        x = lanes[at] & _MASK[np.minimum(left, _LANE)]
        if which is None:
            out = _mixed(out ^ x)
        else:
            out[which] = _mixed(out[which] ^ x)
        more = np.flatnonzero(left > _LANE)
        if not len(more):
            break
        which = more if which is None else which[more]
        at, left = at[more] + _LANE, left[more] - _LANE
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out, np.searchsorted(start, cuts)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of every text the sorted hashes of its different shingles of ``words`` words. Fewer words are one shingle, none or null none."""
    each, bounds = word_hashes(texts)
    runs: dict[int, np.ndarray] = {}

    def run(k: int) -> np.ndarray:
        """Hashes of ``k`` words from every word on."""
        out = np.full(len(each) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mixed(out + each[j : len(each) - k + 1 + j])
        return out

    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k = min(words, b - a)
        if k and k not in runs:
            runs[k] = run(k)
        sets.append(np.unique(runs[k][a : b - k + 1]) if k else np.zeros(0, np.uint64))
    return sets
