"""The n-gram join against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from hazemeter.llm import ngram_join
from hazemeter.llm.shingles import shingle_sets, word_hashes
from tests.llm import brute
from tests.llm.test_operators import DOCS


def shingles(text, words=5):
    tokens = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    size = min(words, len(tokens))
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if size else set()


def groups(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute.groups(sorted(sets), near)
    return {i: (len(sets[i]), root[i]) for i in sets}


def found(df):
    return {r["id"]: (r["n_shingles"], r["component"]) for r in df.collect()}


def test_sets_of_odd_texts():
    texts = [*DOCS.values(), "x" * 63, "x" * 64 + " y", "y" * 65, "y" * 300, "a", "A", "a b", "ab", "a  b", "é\x0bÀ\x0c\r b", "\x85a b c d e f"]
    sets = shingle_sets(pa.array(texts), 5)
    want = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for (a, x), (b, y) in combinations(zip(sets, want, strict=True), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)
    part = pa.array(["zz", *texts, "zz"]).slice(1, len(texts))
    assert all((a == b).all() for a, b in zip(shingle_sets(part, 5), sets, strict=True))
    assert word_hashes(pa.array([], pa.string()))[0].size == 0 and shingle_sets(pa.array([None, ""], pa.string()), 5)[1].size == 0


def test_registered_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op13_ngram_jaccard_join"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == groups(docs)


@pytest.mark.parametrize(("edits", "longest", "block"), [(1, 1, 4), (3, 8, 1024), (6, 3, 2)])
def test_texts_near_the_bound(spark, monkeypatch, edits, longest, block):
    """Copies with a few edits, templates that share much but not enough, and phrases in many texts."""
    monkeypatch.setattr(ngram_join, "HELD", 500)
    monkeypatch.setattr(ngram_join, "SENT", 16)
    monkeypatch.setattr(ngram_join.set_links, "__defaults__", (longest, block))
    rng, docs = random.Random(edits), {}
    word = lambda: f"w{rng.randrange(3000)}"
    phrases = [" ".join(word() for _ in range(12)) for _ in range(6)]
    for _ in range(10):
        base = [word() for _ in range(rng.choice([4, 9, 30, 160, 400]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = word()
            docs[len(docs)] = " ".join(copy)
    for _ in range(60):
        docs[len(docs)] = " ".join([rng.choice(phrases), *(word() for _ in range(rng.randrange(20))), *rng.sample(phrases, 3)])
    docs |= {1000: None, 1001: "", 1002: "one", 1003: "One", 1004: "a b c d e", 1005: "a b c d", 1006: " \t"}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert found(ngram_join.near_groups(table, longest=longest)) == groups(docs)


def test_frequent_shingles_are_carried_along(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 1 << 30)
    rng = random.Random(4)
    head = " ".join(f"h{i}" for i in range(40))
    docs = {i: f"{head} {' '.join(f'x{rng.randrange(9)}' for _ in range(8))}" for i in range(150)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert len(ngram_join._hot(table.withColumnRenamed("doc_id", "id"), 150, 5)) >= 36
    assert found(ngram_join.near_groups(table)) == groups(docs)


def test_odd_rows(spark):
    names = "row long, h long, n long, node long, label long, own_key int, component int, key int, grams int, bucket int, id string"
    rows = [(i, t, *[None] * 11) for i, t in DOCS.items()] + [(None, DOCS[5], *[None] * 11)] * 2 + [(5, DOCS[5], *[None] * 11)]
    table = spark.createDataFrame(rows, f"doc_id long, text string, {names}").repartition(3)
    got = ngram_join.near_groups(table).collect()
    assert len(got) == len(rows)
    want = groups(DOCS)
    assert {(r["id"], r["n_shingles"], r["component"]) for r in got if r["id"] is not None} == {(i, *w) for i, w in want.items()}
    assert {r["component"] for r in got if r["id"] is None} == {5}
    kept = ngram_join.near_dedup(table)
    assert kept.columns == table.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted({w[1] for w in want.values()})
    assert ngram_join.near_groups(table.limit(0)).count() == 0 and ngram_join.near_dedup(table.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.near_groups(nobody).collect()] == [(None, 2, None)] * 2


def test_sets_of_frequent_ngrams_ask_for_more(spark):
    rows = [(1, 150, [(100, h) for h in range(150)]), (2, 150, [(2 if h < 17 else 10**6, h) for h in range(150)]), (3, 3, [(9, 1), (9, 2), (9, 3)])]
    near = ngram_join.prefixes(spark.createDataFrame(rows, "node long, n long, grams array<struct<df: long, h: long>>"))
    asked = {}
    for r in near.orderBy("node", "pos").collect():
        asked.setdefault(r["node"], []).append((r["pos"], r["asked"]))
    assert {a for _, a in asked[1]} == {8} and len(asked[1]) == 38
    assert {a for _, a in asked[2]} == {1} and [p for p, _ in asked[2]] == list(range(1, 32))
    assert {a for _, a in asked[3]} <= {1, 2, 3}


def test_pairs_compared_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies of one text too different to be alike, and texts of phrases many others have."""
    seen = {}
    kept = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name, **o: seen.setdefault(name, []).append(0) or _count(kept(df, name, **o), seen[name]))
    for n in (150, 300):
        rng = random.Random(n)
        base, phrases = [f"b{i}" for i in range(150)], [" ".join(f"p{i}_{j}" for j in range(14)) for i in range(20)]
        docs = {}
        for i in range(n):
            copy = list(base)
            for at in rng.sample(range(150), 12):
                copy[at] = f"e{rng.randrange(40)}"
            docs[i] = " ".join(copy)
            docs[n + i] = " ".join(rng.sample(phrases, 9))
        seen.clear()
        got = found(ngram_join.near_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)))
        assert got == groups(docs)
        assert sum(seen["stars"]) + sum(seen["pairs"]) <= 8 * n


def _count(df, into):
    into[-1] = df.count()
    return df
