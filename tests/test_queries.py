"""Every query of the reference's operators against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from joblode.plans import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None)).removesuffix(" 00:00:00")
    if type(v).__name__ in ("float", "Decimal"):
        return f"{float(v):.6g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, SF)
    values = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name in all_sql():
        rel = duck.sql(all_sql()[name])
        assert sorted(rel.columns) == sorted(got.columns)
        assert rows(got.columns, values) == rows(rel.columns, rel.fetchall())
