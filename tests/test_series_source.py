"""The data source against the readers of the formats, its tasks, its edge rows, and streams that go on."""

import math
import os

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import readers, series_source


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    series_source.register(spark)


def load(spark, path, **options):
    return spark.read.format("seriesloom").options(**options).load(str(path))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_wide_rows_are_those_of_the_reader(spark, tmp_path):
    put(tmp_path, "a.csv", " date ,x, y\n2020-01-01,1,2.5\n2020-01-02,bad,\n\n2020-01-03,3\n2020-01-04,1e2,-4,extra\n")
    wide = readers.read_wide_csv(spark, str(tmp_path), series_cols=["x", "y"])
    expected = rows(wide.unpivot(["date"], ["x", "y"], "k", "v"), "k", "date", "v")
    assert rows(load(spark, tmp_path, dataset="etth1"), "series_key", "time", "value") == expected
    assert rows(load(spark, tmp_path, dataset="etth1", series="y,gone"), "t", "value") == [(0, 2.5), (1, None), (2, None), (3, -4.0)]


def test_metric_rows_are_those_of_the_reader(spark, tmp_path):
    put(tmp_path, "g/one.csv", "timestamp,value\n2020-01-01 00:00:00,1\n2020-01-01T01:00:00Z,2\nnever,3\n2020-13-01,4\n2020-01-01 02:00:00,x\n2020-01-02,5.5\n")
    put(tmp_path, "g/h/two.csv", "timestamp,value\n2021-01-01 00:00:00,7\n")
    put(tmp_path, "g/notes.txt", "timestamp,value\n2021-01-01 00:00:00,7\n")
    put(tmp_path, "_log/three.csv", "timestamp,value\n2021-01-01 00:00:00,7\n")
    expected = [r for r in rows(readers.read_metrics(spark, str(tmp_path)), "series_key", "t", "value") if not r[0].startswith("_")]
    assert rows(load(spark, tmp_path, dataset="nab"), "series_key", "t", "value") == expected
    assert len(expected) == 4


@pytest.mark.parametrize(("text", "options"), [("1\t2\t\t4\nx\tNaN\t5\n\n-2.0\t7\n3\n", {}), ("1, 2 4\n3 5\n", {"separator": r"[\s,]+", "label_last": "true"})])
def test_labelled_rows_are_those_of_the_reader(spark, tmp_path, text, options):
    put(tmp_path, "a.tsv", text)
    own = readers.read_labelled(spark, str(tmp_path), "n", "TEST", options.get("separator", "\t"), "label_last" in options)
    expected = rows(own.select("series_key", "label", F.posexplode("values").alias("t", "value")), "series_key", "label", "t", "value")
    assert rows(load(spark, tmp_path, dataset="ucr2018", series="n", split="TEST", **options), "series_key", "label", "t", "value") == expected
    assert expected


def test_economic_rows_are_those_of_the_reader(spark, tmp_path):
    lines = ['{"index": "a", "cols": ["p", "q"], "timestamp": ["1", "2", "3"], "timeseries1": [1, null, 3.5], "timeseries2": [4]}', "{bad", "[]", '{"index": "b", "cols": [], "timestamp": ["1"]}', '{"index": "c", "cols": ["p"], "timestamp": ["1"]}']
    put(tmp_path, "a.jsonl", "\n".join(lines))
    own = readers.economic_points(readers.read_economic(spark, str(tmp_path)))
    expected = rows(own.select(F.concat_ws("/", "index", "name").alias("k"), "t", "time", "value"), "k", "t", "time", "value")
    assert rows(load(spark, tmp_path, dataset="fred"), "series_key", "t", "time", "value") == expected
    assert len(expected) == 7
    assert {r.series_key for r in load(spark, tmp_path, dataset="fred", target="q").collect()} == {"a/q"}


def test_small_files_share_tasks_and_long_files_come_in_steps(spark, tmp_path):
    n = 3 * series_source.ROWS + 5
    put(tmp_path, "long.csv", "date,x\n" + "\n".join(f"{i},{i}" for i in range(n)))
    for k in range(40):
        put(tmp_path, f"small/{k:02d}.csv", f"date,x\n{k},1\n")
    df = load(spark, tmp_path, dataset="d")
    assert df.rdd.getNumPartitions() == 1
    limit = 10 * (series_source.OPEN_BYTES + 20)
    cut = load(spark, tmp_path, dataset="d", task_bytes=limit)
    assert 4 <= cut.rdd.getNumPartitions() <= 6
    for read in (df, cut):
        one = read.where("file = 'long.csv'").agg(F.count("*"), F.sum("value"), F.max("t"), F.count_distinct("t")).first()
        assert tuple(one) == (n, n * (n - 1) / 2, n - 1, n)
        assert read.where("file <> 'long.csv'").count() == 40


def test_empty_folders_files_and_wrong_options(spark, tmp_path):
    assert load(spark, tmp_path, dataset="nab").collect() == []
    for layout in series_source.LAYOUTS:
        put(tmp_path / layout, "a.csv", "")
        assert load(spark, tmp_path / layout, layout=layout).collect() == []
    single = put(tmp_path, "one.csv", "date,x\n1,2\n")
    assert rows(load(spark, single, dataset="d"), "file", "value") == [("one.csv", 2.0)]
    for path, wrong in ((tmp_path, {"layout": "parquet"}), (tmp_path / "absent", {"dataset": "nab"})):
        with pytest.raises(Exception, match="none of|absent"):
            load(spark, path, **wrong).collect()


@pytest.mark.parametrize(("text", "good"), [("2020-01-01", True), ("2020-1-5 1:02", True), ("2020", True), ("2020-01-01T00:00:00.25+01:00", True), ("2020-02-30", False), ("12:00", False), ("", False), ("2020-01-01 25:00", False)])
def test_times(text, good):
    assert series_source.is_time(text) == good


def test_numbers():
    got = series_source.numbers([" 1.5 ", "-inf", "", None, "NA", "1_0", "x", "1e3"])
    assert [None if math.isnan(v) else v for v in got] == [1.5, -math.inf, None, None, None, None, None, 1000.0]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")

    def run(seen="seen", out=out, log=log):
        stream = spark.readStream.format("seriesloom").option("dataset", "nab").option("log", str(tmp_path / seen)).load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema(series_source.POINTS).parquet(out), "series_key", "value")

    put(source, "b.csv", "timestamp,value\n2020-01-01,1\n")
    first = put(source, "a.csv", "timestamp,value\n2020-01-01,2\n")
    assert run() == [("a.csv", 2.0), ("b.csv", 1.0)]
    assert run() == [("a.csv", 2.0), ("b.csv", 1.0)]  # nothing twice
    os.utime(put(source, "0.csv", "timestamp,value\n2020-01-01,3\n"), ns=(5, 5))  # came later, though written long ago
    first.unlink()  # done with
    assert run() == [("0.csv", 3.0), ("a.csv", 2.0), ("b.csv", 1.0)]
    assert run() == [("0.csv", 3.0), ("a.csv", 2.0), ("b.csv", 1.0)]
    other = run("new", str(tmp_path / "out2"), str(tmp_path / "log2"))
    assert other == [("0.csv", 3.0), ("b.csv", 1.0)]
    with pytest.raises(Exception, match="option log"):
        spark.readStream.format("seriesloom").option("dataset", "nab").load(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log3")).trigger(availableNow=True).start().awaitTermination()


def test_a_batch_that_comes_again_reads_its_own_files(tmp_path):
    options = {"path": str(tmp_path / "in"), "dataset": "nab", "log": str(tmp_path / "log")}
    put(tmp_path, "in/a.csv", "timestamp,value\n")
    before = series_source.SeriesStreamReader(options)
    assert before.latestOffset() == {"entry": 1} == before.latestOffset()
    put(tmp_path, "in/b.csv", "timestamp,value\n")
    put(tmp_path, "log/_left", "[[")  # of an entry that was never finished
    assert before.latestOffset() == {"entry": 2}
    after = series_source.SeriesStreamReader(options)  # the driver is lost and comes back
    assert [p.names for p in after.partitions({"entry": 0}, {"entry": 1})] == [("a.csv",)]
    assert [p.names for p in after.partitions({"entry": 1}, {"entry": 2})] == [("b.csv",)]
    assert after.latestOffset() == {"entry": 2}
