"""Every registered query against its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, plain
from lectern.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SURVEYED = {"a": 11, "b": 24, "c": 6, "d": 9, "e": 4, "f": 11, "g": 8, "h": 6, "i": 6, "j": 16, "k": 6}

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_operator_has_a_query():
    have = {re.match(r"([a-k]\d\d)_", name)[1] for name in catalog.QUERIES}
    assert have == {f"{area}{i:02d}" for area, n in SURVEYED.items() for i in range(1, n + 1)}
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["query_id", "rank", "score", "ref"] and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert got
        return
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
