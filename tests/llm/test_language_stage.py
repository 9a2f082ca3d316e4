"""The pipeline's language stage drops texts without a letter and no others, whatever the labels are."""

import pytest

import corpus_pipeline
from hazemeter.llm import langid
from tests.llm import brute

TEXTS = [None, "", "12 !?", "one two", "été 1", "中文", "three"]


@pytest.mark.parametrize("labels", [[None], ["und"], ["und", "en"]])
def test_rows_with_letters_stay(spark, sf_dir, labels):
    held = [i for i in range(60) if brute.held_out(i)]
    free = [i for i in range(60) if not brute.held_out(i)]
    cases = [[(i, t, labels[k % len(labels)]) for k, (i, t) in enumerate(zip(ids, TEXTS * 4))] for ids in (free, held)]
    for rows in cases:
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        out = dict(corpus_pipeline.STAGES)["language ID"](spark, table, sf_dir)
        assert out.columns == table.columns
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, t, _ in rows if any(map(str.isalpha, t or "")))
        trees = langid.learn(table)
        assert trees is None or trees.langs == ["en"]
