import os

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from hazemeter.plans import fixtures as fx
from hazemeter.session import counted, shared_dir, temporary_tables
from hazemeter.sources import tables as S
from tests.helpers import rows_of


def test_locations_are_built_once(spark, sf_dir, tmp_path):
    path, built = f"{tmp_path}/places", []

    def build():
        built.append(1)
        return fx.locations(spark, sf_dir)

    for _ in range(2):
        assert S.load_locations(spark, path, build).count() == 25
    assert built == [1]
    with pytest.raises(AnalysisException):
        S.load_locations(spark, f"{tmp_path}/nothing")


def test_archive_replays_a_range_of_batches(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BATCHES_PER_FOLDER", 10)
    batches = fx.batches(spark, sf_dir)
    S.archive_batches(batches, f"{tmp_path}/archive")
    replay = S.read_archive(spark, f"{tmp_path}/archive", 12, 34)
    assert rows_of(replay) == rows_of(batches.where("seq_id between 12 and 34"))
    assert len(replay.inputFiles()) > 0
    plan = replay._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan
    assert rows_of(S.read_archive(spark, f"{tmp_path}/archive")) == rows_of(batches)


def test_batches_from_json(spark, sf_dir, tmp_path):
    batches = fx.batches(spark, sf_dir).where("seq_id < 3")
    batches.write.json(f"{tmp_path}/json")
    assert rows_of(S.read_batches(spark, f"{tmp_path}/json", "json")) == rows_of(batches)


SCHEMA = "batch_seq_id bigint, v bigint"


def some(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_results_overwrite_only_their_batches(spark, tmp_path, fmt):
    path = f"{tmp_path}/out"
    assert S.read_results(spark, path, SCHEMA, fmt).count() == 0
    S.write_results(some(spark, (1, 1), (11, 1)), path, fmt)
    S.write_results(some(spark, (11, 2), (12, 2)), path, fmt)
    assert rows_of(S.read_results(spark, path, SCHEMA, fmt)) == [(1, 1), (11, 2), (12, 2)]
    assert rows_of(S.read_results(spark, path, SCHEMA, fmt, 2, 11)) == [(11, 2)]


def test_results_written_batch_by_batch_are_all_there(spark, tmp_path):
    """Rewritten and emptied batches, over several levels of folders, with a call that is repeated."""
    path, want = f"{tmp_path}/out", {}
    for i in range(9):
        rows = [(i % 4, i), (i % 4, None if i == 6 else 10 * i), (100 + i, i)]
        want |= {i % 4: rows[:2], 100 + i: rows[2:]}
        for _ in range(1 + (i == 5)):
            S.write_results(some(spark, *rows), path, version=i, versions=2)
    assert rows_of(S.read_results(spark, path, SCHEMA)) == rows_of(some(spark, *sum(want.values(), [])))
    assert len([f for f in os.listdir(path) if f.startswith("version=")]) <= 5


def test_a_million_batches_are_a_few_folders(spark, tmp_path):
    path = f"{tmp_path}/out"
    for part in range(3):
        S.write_results(spark.range(part * 400_000, 1_000_000).select(F.col("id").alias("batch_seq_id"), F.lit(part).cast("bigint").alias("v")), path, versions=2)
    assert sum(len(d) for _, d, _ in os.walk(path)) <= 3
    got = S.read_results(spark, path, SCHEMA).groupBy("v").count()
    assert rows_of(got) == [(200_000, 2), (400_000, 0), (400_000, 1)]


def test_a_compaction_that_ends_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    for i in range(2):
        S.write_results(some(spark, (1, i), (2 + i, i)), path)
    want = rows_of(S.read_results(spark, path, SCHEMA))
    monkeypatch.setattr(S, "remove", lambda *a: 1 / 0)  # the new folder is there, the old ones as well
    with pytest.raises(ZeroDivisionError):
        S.compact_results(spark, path, some(spark).schema, versions=2)
    monkeypatch.undo()
    assert rows_of(S.read_results(spark, path, SCHEMA)) == want
    S.compact_results(spark, path, some(spark).schema, versions=2)
    assert rows_of(S.read_results(spark, path, SCHEMA)) == want and len(os.listdir(path)) == 1


def test_repeated_epoch_replaces_itself(spark, tmp_path):
    for value in (1, 2):
        S.write_epoch(spark.createDataFrame([(value,)], "v bigint"), f"{tmp_path}/t", 7)
    S.write_epoch(spark.createDataFrame([(3,)], "v bigint"), f"{tmp_path}/t", 8)
    assert sorted((r.epoch, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(7, 2), (8, 3)]


class Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-{folder}"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})


def test_intermediate_tables_use_the_configured_folder(spark):
    assert shared_dir(Session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    assert shared_dir(Session("local[2]")) == shared_dir(Session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(Session("spark://host:7077"))
    table, rows = counted(spark.range(10), "ten")
    assert rows == table.count() == 10
    assert all(shared_dir(spark) in f for f in table.inputFiles())


def test_temporary_tables_are_removed(spark):
    kept, _ = counted(spark.range(3), "kept")
    with temporary_tables(spark):
        gone, rows = counted(spark.range(5), "gone")
        folders = {os.path.dirname(f.removeprefix("file://")) for f in gone.inputFiles()}
        assert rows == 5 and all(map(os.path.isdir, folders))
    assert not any(map(os.path.exists, folders))
    assert kept.count() == 3
