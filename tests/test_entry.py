"""Each query of the library against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations events"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in found.select(columns).collect()), key=str) == rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["domain", "pattern", "gpt_pmi", "claude_pmi", "model_gap", "gpt_deviation", "claude_deviation", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
