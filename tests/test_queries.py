"""Every query that has an oracle returns what its SQL returns."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from tributary.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.4f}"
    return str(v)[:10] if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(tuple(shown(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(shown(dict(zip(want.columns, r, strict=True))[c]) for c in cols) for r in want.fetchall())
    assert a == b


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
