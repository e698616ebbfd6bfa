"""Opportunities linked by long chains of keys, against the query's SQL."""

import datetime as dt

import duckdb

from joblode.plans import all_queries, all_sql


def test_long_chain_is_one_opportunity_in_query_and_sql(spark, tmp_path):
    # ids 3 * a and 3 * a + 1 share a native id; ids 2288 apart on one day share title, place and company
    day = lambda k: dt.datetime(1996, 1, 1) + dt.timedelta(days=k)
    rows = [(2289 * k + i, 21, "O", 100.0, day(k + i), "5-LOW") for k in range(12) for i in (0, 1)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in all_queries()["a01_opportunities"](spark, str(tmp_path)).collect()]
    assert [r[:2] for r in got] == [(0, 24)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert con.execute(all_sql()["a01_opportunities"]).fetchall() == got
