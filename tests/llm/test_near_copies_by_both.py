"""The pipeline's near-dedup stage compares what SimHash puts together, and joins what SimHash misses."""

import random
from itertools import combinations

import corpus_pipeline
from hazemeter.llm import ngram_join
from tests.llm import brute
from tests.llm.test_near_copies import links, shingles


def by_bits(docs):
    prints = {i: brute.simhash(t) for i, t in docs.items() if shingles(t)}
    return [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]


def made():
    """Chains of copies, and pairs that are alike by their bits only."""
    rng, docs = random.Random(8), {}
    for edits in (1, 4, 15, 26):
        text = [f"w{rng.randrange(3000)}" for _ in range(800)]
        for _ in range(6):
            docs[len(docs)] = " ".join(text)
            for at in rng.sample(range(len(text)), edits):
                text[at] = f"w{rng.randrange(3000)}"
    for _ in range(5):
        # A line again and again decides all bits (an odd number of shingles); most shingles are of what else there is.
        line = " ".join(f"v{rng.randrange(3000)}" for _ in range(11))
        for _ in range(2):
            docs[len(docs)] = " ".join([line] * 40 + [f"u{rng.randrange(3000)}" for _ in range(30)])
    ids = random.Random(2).sample(range(len(docs)), len(docs))  # the smallest id is not the first row
    return {i: docs[n] for n, i in enumerate(ids)} | {1000: None, 1001: "", 1002: " \t", 1003: "one"}


def kept(spark, docs, sf_dir):
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, table, sf_dir).collect())


def test_simhash_alone_and_with_the_join(spark, sf_dir, monkeypatch):
    docs = made()
    near, bits = set(links(docs)), set(by_bits(docs))
    assert near - bits and bits - near and bits & near
    want = sorted(set(brute.groups(sorted(docs), near).values()))
    assert kept(spark, docs, sf_dir) == want
    # Without what the join finds, copies that SimHash finds still go, and none that are not similar.
    for step in ("_hubs", "_candidates"):
        monkeypatch.setattr(ngram_join, step, lambda *a, f=getattr(ngram_join, step): f(*a).limit(0))
    by_simhash = kept(spark, docs, sf_dir)
    assert set(want) < set(by_simhash) < set(docs)
    root = brute.groups(sorted(docs), bits)
    assert all(root[i] != i or any(i in pair for pair in bits & near) for i in set(docs) - set(by_simhash))
