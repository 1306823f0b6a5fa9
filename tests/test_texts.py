"""Texts as the SQL of their queries has them, where the smallest tables hold no such case."""

import duckdb
import pytest

from seriesloom.plans.queries import ORACLE_SQL, QUERIES


def test_first_lines_keep_digits_and_lose_spaces(spark, tmp_path):
    texts = ["012 a\n10 b\n\n2 c 2\n3", "  x \n 　\n  y \n\tz\r\n", "a\r\n\r\nb\rc\nd", "", "\n \n", None, "0\n1\n2", "a b\n "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r["head"] for r in QUERIES["t6_first_lines"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLE_SQL["t6_first_lines"]).fetchall())
    assert got[0] == "012 a\n10 b\n2 c 2"


@pytest.mark.parametrize("name", ["t12_fact_captions", "k3_sft_rows"])
def test_numbers_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    """777 * 300 = 233100: a change of just under nothing is told as -0.00, a valley of under a half as -0.000."""
    rows = [(k, k, price) for k, price in enumerate([233098.0, 233100.0, 233102.0, 233099.99, 10.0, -10.0, 49.99, 0.0] * 22)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    out = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(out.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["k3_sft_rows", "t12_fact_captions", "b1_facts"])
def test_numbers_halfway_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """27.195 / 777 - 300 = -299.965: a hundredfold it is under the half as a double, and on it as the digits shown. Each
    key is odd and divisible by 7, so that k3_sft_rows tells the facts."""
    prices = [27.195, 73.815, 742178.745, -27.195, 233103.885, 233096.115, 233100.0, 125050.0, -125050.0, 49.995, 50.0, 1e17, 0.0, -0.0]
    rows = [(7 * (2 * i + 1), i, price) for i, price in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    out = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(out.fetchall(), key=repr)
