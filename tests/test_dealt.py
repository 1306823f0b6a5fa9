"""Windows are dealt to tasks by their number of points; results do not change with it."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import scan
from seriesloom.operators.windows import KEY
from seriesloom.plans.queries import ORACLE_SQL, QUERIES
from seriesloom.plans.views import supp_windows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_tasks_do_not_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_POINTS", 1000)
    windows = supp_windows(spark, SF, by_window=True)
    tasks = [r[0] for r in windows.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    longest = windows.groupBy(*KEY).count().agg(F.max("count")).first()[0]
    assert sum(tasks) == supp_windows(spark, SF).count()
    assert len(tasks) > 4 and max(tasks) <= 1000 + 10 * longest


@pytest.mark.parametrize("name", ["e2_slope_runs", "e7_ramps", "e8_phases", "e10_e11_target_segments", "l3_validated_phases", "l4_repaired_trend", "l5_amplitude_note", "t14_thinned_phases"])
def test_rows_of_dealt_windows(spark, monkeypatch, name):
    monkeypatch.setattr(scan, "TASK_POINTS", 1000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    df = QUERIES[name](spark, SF)
    out = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == sorted(out.fetchall(), key=repr)


def test_files_of_series_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from seriesloom.plans import q_files

    monkeypatch.setattr(q_files, "FILES", 4)
    names = [r[0] for r in spark.read.option("recursiveFileLookup", True).csv(q_files.metric_files(spark, SF)).select(F.col("_metadata.file_path")).distinct().collect()]
    users = spark.read.parquet(f"{SF}/events.parquet").agg(F.count_distinct("user_id")).first()[0]
    assert len(names) == users > 8  # one file a series
    assert len({n.rsplit("/", 1)[1].split("-")[1] for n in names}) > 2
