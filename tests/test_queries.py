"""Every query that has SQL against DuckDB, on the smallest tables."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{x:.6g}" if isinstance(x, float) and not x.is_integer() else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = db.execute(OWN[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
