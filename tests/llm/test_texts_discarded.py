"""The n-gram join's copy of the texts is gone when they are not read any more, and the groups are as they were."""

from hazemeter.llm import ngram_join


def test_texts_are_gone_before_links_are_looked_for(spark, monkeypatch):
    seen, discard, links = [], ngram_join.discard, ngram_join.set_links

    def gone(table):
        assert set(table.columns) == {"row", "id", "text"}
        files = table.inputFiles()
        discard(table)
        seen.extend(files)

    def after(*args):
        assert seen and not any(spark.sparkContext._jvm.java.io.File(f.removeprefix("file:").replace("//", "/")).exists() for f in seen)
        return links(*args)

    monkeypatch.setattr(ngram_join, "discard", gone)
    monkeypatch.setattr(ngram_join, "set_links", after)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words + " a"), (1, words + " b"), (2, "x y z"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component"] for r in ngram_join.near_groups(docs).collect()} == {3: 1, 1: 1, 2: 2, 4: 4}
