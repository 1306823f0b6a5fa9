"""Appending records by batches with a commit log."""

import os

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import readers, writers


def records(spark, spans):
    rows = spark.createDataFrame([(k, a, b) for k, a, b in spans], "k string, a int, b int")
    return rows.select(F.lit("d").alias("dataset"), F.col("k").alias("series_key"), F.array("a", "b").alias("indices"))


def out(spark, path):
    return sorted((r.series_key, *r.indices) for r in readers.read_records(spark, path).collect())


def test_batches_of_a_stream_read_nothing_earlier(spark, tmp_path, monkeypatch):
    path, seen, own = str(tmp_path / "out"), [], writers.read_records
    monkeypatch.setattr(writers, "read_records", lambda s, *paths: seen.append([p.rsplit("/", 1)[-1] for p in paths]) or own(s, *paths))
    for n in range(4):
        writers.append_records(records(spark, [(f"s{n}", 0, 9), ("shared", n, n + 9)]), path, "one", n)
    assert seen == [[f"batch-one-{n}"] for n in range(4)]  # its own rows, for the log
    assert len(out(spark, path)) == 8
    log = {r.folder: (r.rows, r.low, r.high, r.stream) for r in writers.committed(spark, path).collect()}
    assert log["batch-one-2"] == (2, "s2", "shared", "one")


def test_killed_batch_repeats_without_doubles(spark, tmp_path, monkeypatch):
    path, own = str(tmp_path / "out"), writers.read_records
    batch = records(spark, [("a", 0, 9), ("b", 0, 9)])
    writers.append_records(records(spark, [("z", 0, 9)]), path, "one", 0)

    def killed(*_):
        raise RuntimeError("killed between data and log")

    monkeypatch.setattr(writers, "read_records", killed)
    with pytest.raises(RuntimeError):
        writers.append_records(batch, path, "one", 1)
    monkeypatch.setattr(writers, "read_records", own)
    for _ in range(2):  # delivered again, twice
        writers.append_records(batch, path, "one", 1)
    assert out(spark, path) == [("a", 0, 9), ("b", 0, 9), ("z", 0, 9)]


def test_other_streams_are_compared_where_keys_meet(spark, tmp_path, monkeypatch):
    path, seen, own = str(tmp_path / "out"), [], writers.read_records
    writers.append_records(records(spark, [("a", 0, 9), ("c", 0, 9)]), path, "one", 0)
    writers.append_records(records(spark, [("x", 0, 9)]), path, "one", 1)
    monkeypatch.setattr(writers, "read_records", lambda s, *paths: seen.append([p.rsplit("/", 1)[-1] for p in paths]) or own(s, *paths))
    writers.append_records(records(spark, [("b", 0, 9), ("c", 0, 9), ("c", 1, 10)]), path, "two", 0)
    assert seen[0] == ["batch-one-0"]
    writers.append_records(records(spark, [("x", 0, 9), (None, 0, 9)]), path)
    writers.append_records(records(spark, []), path)
    assert sorted(map(repr, (tuple([r.series_key, *r.indices]) for r in own(spark, path).collect()))) == sorted(map(repr, [("a", 0, 9), ("b", 0, 9), ("c", 0, 9), ("c", 1, 10), ("x", 0, 9), (None, 0, 9)]))


def test_records_written_at_once_are_known(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_records(records(spark, [("a", 0, 9)]), path, partitioned=True)
    for _ in range(2):
        writers.append_records(records(spark, [("a", 0, 9), ("b", 0, 9)]), path)
    assert out(spark, path) == [("a", 0, 9), ("b", 0, 9)]
    assert {r.dataset for r in readers.read_records(spark, path).collect()} == {"d"}


def test_records_are_written_small_and_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_RECORDS", 100)
    rows = records(spark, [(f"s{i}", i, i + 9) for i in range(1000)]).coalesce(1)
    plain, small = f"{tmp_path}/plain", f"{tmp_path}/small"
    writers.write_records(rows, plain, compression="none")
    writers.write_records(rows, small)
    files = lambda path: sorted(f for f in os.listdir(path) if f.startswith("part-"))
    size = lambda path: sum(os.path.getsize(f"{path}/{f}") for f in files(path))
    assert len(files(small)) == 10 and size(small) * 4 < size(plain)
    assert readers.read_records(spark, small).exceptAll(readers.read_records(spark, plain)).count() == 0
    assert readers.read_records(spark, small).count() == 1000
