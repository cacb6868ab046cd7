"""The queries of the subpackage that have SQL, held against DuckDB on whole tables."""

import duckdb
import pytest

from tidewatch.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    want = want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, want), key=repr) == sorted((plain(r[c] for c in columns) for r in got.collect()), key=repr)
