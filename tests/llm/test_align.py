"""Token alignment against a plain walk over both tokenizers' spans."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("tiktoken")
pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
from hazemeter.llm import align  # noqa: E402
from tests.llm.test_operators import DOCS  # noqa: E402

ODD = {100: "▁a", 101: "\n", 102: " ", 103: "a  b\t\tc", 104: "<s> hi </s> <|endoftext|> <unk>", 105: "　x ﬁ\x00", 106: "😀 👩‍👩‍👧 𝒳", 107: "don't WE'LL", 108: "a" * 3000}


def spans(pieces):
    at, out = 0, []
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


@pytest.fixture(scope="module")
def tokenize():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    named = {i: s for s, i in a.get_vocab().items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if name.startswith("<0x") and len(name) == 6 else name.replace("▁", " ").encode()

    def run(text):
        raw = f" {text}".encode()
        x = [(i, bytes(letter[c] for c in named[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids] if text else []
        y = [(i, piece(i)) for i in b.encode(text)] if text else []
        same = b"".join(r for _, r in x) == raw == b"".join(r for _, r in y)
        return (spans(x), spans(y)) if same else ([], [])

    return run


def walked(docs, tokenize):
    """Contract rows by id."""
    links, shown, counts = {}, {}, Counter()
    for i, text in docs:
        a, b = tokenize(text)
        links[i] = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 4000 else None
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        lists, at = [], [0, 0]
        for end in ends:
            part = []
            for k, side in enumerate((a, b)):
                first = at[k]
                while at[k] < len(side) and side[at[k]][1] < end:
                    at[k] += 1
                part.append(",".join(str(t[0]) for t in side[first : at[k]]))
            lists.append("|".join(part))
        shown[i] = (len(a), len(b), len(ends), hashlib.sha256(";".join(lists).encode()).hexdigest() if a else "")
        counts.update(links[i])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {i: (*shown[i][:3], len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), shown[i][3]) for i, l in links.items()}


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize(("frequent", "held"), [(1 << 21, 1 << 21), (50, 100), (0, 1)])
def test_alignments(spark, tokenize, monkeypatch, frequent, held):
    monkeypatch.setattr(align, "HELD", held)
    monkeypatch.setattr(align, "STEP", 400 if held < 1000 else 1 << 21)
    docs = {i: t if t is None or len(t) < 4000 else t[:2500] for i, t in (DOCS | ODD).items()}
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in docs.items()], "doc_id long, text string, code long, row int, a string").repartition(3)
    assert found(align.alignments(table, frequent=frequent)) == walked(docs.items(), tokenize)
    assert align.alignments(table.limit(0), frequent=frequent).count() == 0


def test_repeated_rows_count_each(spark, tokenize):
    rows = [(1, "a bc-def"), (1, "a bc-def"), (None, "a bc"), (2, None)]
    got = align.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = walked(list(enumerate(t for _, t in rows)), tokenize)
    assert sorted(map(str, (tuple(r)[1:] for r in got))) == sorted(map(str, want.values()))


def test_registered_query(spark, sf_dir, tokenize):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if t is None or len(t) < 3000]
    got = entry.queries()["op11_cross_tokenizer_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got, want = found(got), walked(short, tokenize)
    assert set(got) == {i for i, _ in docs}
    pick = lambda rows: {i: (*rows[i][:4], rows[i][6]) for i, _ in short}
    assert pick(got) == pick(want)


def test_byte_level_ids_are_those_of_the_described_vocabulary(tokenize):
    """Every part of the first planes of Unicode, beside letters, digits, marks and spaces."""
    both = align.Tokenizers(align.VOCABULARY_A, align.VOCABULARY_B)
    for low in range(0, 0x3000, 16):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}  {chr(c)}\n" for c in range(low, low + 16))
        a, b = next(both.encode([text]))
        assert (a, b) == tuple([t[0] for t in side] for side in tokenize(text))


def test_groups_of_a_text(spark):
    rows = align.groups(spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None)], "doc_id long, text string")).orderBy("start").collect()
    both = align.Tokenizers(align.VOCABULARY_A, align.VOCABULARY_B)
    assert {r["id"] for r in rows} == {1} and [r["start"] for r in rows] == [0, *(r["end"] for r in rows[:-1])]
    for r in rows:
        part = b" unbelievable tokenizers"[r["start"] : r["end"]]
        assert part == b"".join(both.bytes_a[i] for i in r["a"]) == b"".join(both.bytes_b[i] for i in r["b"])
