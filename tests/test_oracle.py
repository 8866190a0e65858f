"""Every registered query with a SQL counterpart gives its rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = os.environ.get("LOGLAKE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = contract.queries()[name](spark, DATA)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    rows = cursor.fetchall()
    at = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rows)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
