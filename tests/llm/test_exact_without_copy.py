"""Exact dedup writes no copy of the texts, and finds the rows that stay again, repeated ones too."""

import pytest

from hazemeter.llm import exact

ROWS = [(1, "a b", "x"), (2, "ab", "y"), (3, "a  b", "z"), (4, "c", "x"), (None, "d", "x"), (None, None, "n"), (5, "", "e"), (6, " ", "s")]
KEPT = [(3, "a  b", "z"), (4, "c", "x"), (6, " ", "s"), (None, "d", "x")]
REPEATED = [(4, "c", "x"), (3, "a  b", "z"), (None, "d", "x"), (None, "d", "x"), (7, "c", "x")]


@pytest.mark.parametrize("more", [[], REPEATED])
def test_no_text_is_written(spark, monkeypatch, more):
    tables, written = [], exact.written
    monkeypatch.setattr(exact, "written", lambda df, name: tables.append(df) or written(df, name))
    docs = spark.createDataFrame(ROWS + more, "doc_id long, text string, id string").repartition(3)
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(KEPT, key=str)
    assert tables and all({kind for _, kind in t.dtypes} <= {"bigint", "int", "binary"} for t in tables)
