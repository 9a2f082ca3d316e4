"""The registered corpus queries and the pipeline over the driver's tables, against SQL or brute force."""

import hashlib
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hazemeter.llm import packing
from tests.llm import brute
from tests.llm.test_near_copies import survivors
from tests.llm.test_operators import sequences_hold

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    return con


def run(spark, sf_dir, n):
    name = next(x for x in entry.queries() if x.startswith(f"op{n}_"))
    return entry.queries()[name](spark, sf_dir)


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_each_operator_has_one_query():
    assert [x.split("_")[0] for x in entry.queries() if x.startswith("op")] == [f"op{n}" for n in range(1, 14)]
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("n", [2, 5, 6, 8])
def test_query_equals_its_sql(spark, duck, sf_dir, n):
    got = run(spark, sf_dir, n)
    name = next(x for x in entry.oracle_sql() if x.startswith(f"op{n}_"))
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: str(v)
    as_rows = lambda names, data: sorted([cell(r[names.index(c)]) for c in sorted(names)] for r in data)
    assert as_rows(got.columns, [tuple(r) for r in got.collect()]) == as_rows(want.columns, want.fetchall())


def test_near_dedup(spark, sf_dir, docs):
    assert rows(run(spark, sf_dir, 1), "fingerprint", "component_id") == brute.near_groups(docs)


def test_decontamination(spark, sf_dir, docs, items):
    assert rows(run(spark, sf_dir, 2), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(docs, items)


def test_exact(spark, sf_dir, docs):
    assert rows(run(spark, sf_dir, 5), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(docs)


def test_secrets(spark, sf_dir, docs):
    want = {}
    for i, text in docs.items():
        spans = brute.secrets(text)
        listed = ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in spans)
        want[i] = (*(sum(kind == k for _, _, kind, _ in spans) for k in ("assign", "access", "hex")), hashlib.sha256(listed.encode()).hexdigest(), listed)
    assert rows(run(spark, sf_dir, 7), "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want


def test_shards(spark, sf_dir, docs):
    got = sorted(run(spark, sf_dir, 3).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == sorted(docs) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got)


def test_packing(spark, sf_dir, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    got = run(spark, sf_dir, 9).collect()
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = brute.pieces(docs, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    total = sum(n for _, n, _ in want.values())
    assert -(-total // 2048) <= sequences_hold(got) <= total // 2048 * 1.02 + 2


def test_language(spark, sf_dir, docs):
    label = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = rows(run(spark, sf_dir, 10), "held_out", "lang_pred", "score")
    assert {i: g[0] for i, g in got.items()} == {i: brute.held_out(i) for i in docs}
    assert all((g[1] == "und") == (not letters(docs[i])) and 0 <= g[2] <= 1 for i, g in got.items())
    asked = [i for i, g in got.items() if g[0] and label[i] and letters(docs[i])]
    assert sum(got[i][1] == label[i] for i in asked) >= 0.95 * len(asked)


def letters(text):
    return any(c.isalpha() for c in text or "")


def test_pipeline(spark, sf_dir, docs, items):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    got = corpus_pipeline.run(spark, sf_dir).collect()
    left = {i: t for i, t in docs.items() if letters(t)}
    left = {i: left[i] for i, w in brute.exact(left).items() if w[2]}
    left = {i: left[i] for i in survivors(left)}
    left = {i: left[i] for i, w in brute.contamination(left, items).items() if not w[4]}
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = brute.pieces(left, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    total = sum(n for _, n, _ in want.values())
    assert -(-total // 2048) <= sequences_hold(got) <= total // 2048 * 1.02 + 2


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    odd = spark.createDataFrame(
        [(1, None, "en", "s", 0, 7), (2, "", "en", None, 0, 7), (3, "a b c d e f g", None, "s", 1, 7), (3, "a b c d e f g", None, "s", 1, 7), (None, "x y z", "de", "s", 1, 7), (None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, row int",
    )
    for table, left in ((odd, 2), (odd.limit(0), 0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf_dir)
            assert kept.columns == odd.columns
        assert kept.count() == left
        assert len({r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()}) == left
