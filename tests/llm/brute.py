"""The operators' contracts in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACE = "\x20\x09-\x0d"


def groups(ids, linked):
    """Smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text, words=3):
    tokens = re.findall(f"[^{SPACE}]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not tokens:
        return 0
    size = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + size]).encode(), 42) for i in range(len(tokens) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, radius=3):
    prints = {i: simhash(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    root = groups(ids, links)
    return {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def contamination(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if got := windows.get(tuple(w[at : at + n])):
                    found |= got
                    hit.update(range(at, at + n))
        listed = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


def exact(docs):
    same = defaultdict(list)
    for i, text in docs.items():
        same[re.sub(f"[{SPACE}]", "", text or "")].append(i)
    out = {}
    for text, ids in same.items():
        keep = min(ids, key=lambda i: (-len(docs[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def secrets(text):
    """Base spans (start, kind order, kind, end)."""
    text = text or ""
    out = []
    rule = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rule, text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for n, (kind, rule, least) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(rule, text) if len(m[0]) >= least]
    return sorted(out)


def pieces(docs, encode, capacity=2048):
    """(id, piece) → (start, length, crc)."""
    out = {}
    for i, text in docs.items():
        ids = [*encode(text or ""), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[i, k] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
